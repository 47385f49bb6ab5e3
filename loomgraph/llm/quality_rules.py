"""Quality rules: base counts per document, then robust multivariate outliers within each language and source.

Statistics of a document become a vector; in every (lang, source) group the minimum covariance determinant gives a
robust centre and scatter, and a document whose Mahalanobis distance passes a cut is rejected. The cut is a chi-square
quantile, brought to the scale of the group by the median of its distances.

The estimate is distributed: concentration steps run from several starts, the start of the least determinant goes on
until its determinant settles. A step is one pass over all distinct vectors (copies of a document count once), summed by
group and bin of distance, so no group is ever gathered, and only group-sized tables (centre, scatter) travel between
steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.scratch import staged
from loomgraph.llm.shipping import ship_package
from loomgraph.llm.words import BASE, BASE_INVERSE, SPACE, Words, mix, powers, rolling, word_runs

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
SIGNS = np.zeros(256, bool)
SIGNS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
NEAR = 50
STAT_SCHEMA = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_signs long, n_near long"


def _per_document(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _duplicates(keys: np.ndarray) -> np.ndarray:
    """True where a key equals an earlier one."""
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return again


def _line_counts(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Per document: lines that hold a word, and those of them equal to an earlier line of it."""
    data, n = w.data, len(w.data)
    cuts = np.union1d(np.flatnonzero(data == 10), w.bounds[1:] - 1) if n else np.zeros(0, np.int64)
    cuts = cuts[cuts >= 0]
    ends = np.where(data[cuts] == 10, cuts, cuts + 1) if n else cuts
    starts = np.concatenate(([0], cuts[:-1] + 1)) if n else cuts
    has = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends = starts[has], ends[has]
    total = np.zeros(n + 1, np.uint64)
    if n:
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=total[1:])
    own = mix((total[ends] - total[starts]) * powers(BASE_INVERSE, max(n, 1))[starts]) if len(starts) else np.zeros(0, np.uint64)
    doc = np.searchsorted(w.bounds, starts, "right") - 1
    again = _duplicates(mix(own ^ mix(doc.astype(np.uint64) + np.uint64(7))))
    return np.bincount(doc, minlength=w.n_docs)[: w.n_docs], np.bincount(doc[again], minlength=w.n_docs)[: w.n_docs]


def _repeated_words(w: Words, n: int = 3) -> np.ndarray:
    """Per document: words inside an n-word window that the document holds at least twice."""
    owner = w.owner
    if len(owner) < n:
        return np.zeros(w.n_docs, np.int64)
    inside = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
    keys = mix(rolling(w.hashes(), n)[inside] ^ mix(owner[inside].astype(np.uint64) + np.uint64(7)))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    covered = np.zeros(len(owner), bool)
    for k in range(n):
        covered[inside[twice] + k] = True
    return np.bincount(owner[covered], minlength=w.n_docs)


def _near_words(w: Words, span: int = NEAR) -> np.ndarray:
    """Per document: words equal to one of the `span` words before them."""
    owner = w.owner
    keys = mix(w.hashes() ^ mix(owner.astype(np.uint64) + np.uint64(7)))
    order = np.argsort(keys, kind="stable")
    near = (keys[order[1:]] == keys[order[:-1]]) & (order[1:] - order[:-1] <= span)
    return np.bincount(owner[order[1:][near]], minlength=w.n_docs)


def text_statistics(column: pa.Array) -> pa.StructArray:
    """The counts of STAT_SCHEMA for each text of a column."""
    out = []
    for _, _, w in word_runs(column):
        points = ((w.data & 0xC0) != 0x80) & ~SPACE[w.data]
        lines, again = _line_counts(w)
        out.append(np.stack([w.counts, _per_document(points, w.bounds), _per_document(SYMBOLS[w.data], w.bounds), lines, again, _repeated_words(w), _per_document(SIGNS[w.data], w.bounds), _near_words(w)]))
    table = np.concatenate(out, axis=1).astype(np.int64) if out else np.zeros((8, 0), np.int64)
    names = [f.split(" ")[0] for f in STAT_SCHEMA.split(", ")]
    return pa.StructArray.from_arrays([pa.array(x) for x in table], names)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        stats = text_statistics(b.column("text"))
        kept = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + stats.flatten(), kept + [f.name for f in stats.type])


FEATURES = ["f_length", "f_signs", "f_near", "f_lines"]
P = len(FEATURES)
COVER = 0.75
MEDIAN = 3.3567  # chi-square with four degrees of freedom, probability 0.5
CUT = 33.377  # and probability 0.999999
# Least variance in any direction: far below that of prose (its smallest is about 4e-4), so only exact fits meet it.
LEAST_VARIANCE = 1e-5
STARTS = 3
FIRST_STEPS = 2
MOST_STEPS = 30
SETTLED = 1e-3
MIN_GROUP = 100
BROADCAST_GROUPS = 20_000
MODELS_A_TASK = 8
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _consistency(cover: float) -> float:
    """Factor that makes the covariance of the inner `cover` of a four-dimensional normal unbiased."""
    low, high = 0.0, 100.0
    for _ in range(200):
        x = (low + high) / 2
        low, high = (x, high) if 1 - np.exp(-x / 2) * (1 + x / 2) < cover else (low, x)
    x = low / 2
    return cover / (1 - np.exp(-x) * (1 + x + x * x / 2))


def _features(df: DataFrame) -> DataFrame:
    """Logarithms of letters a word, signs a word, share of words just used and words a line, each drawn a little to what is usual."""
    words = F.col("n_words").cast("double")
    return df.withColumns(
        {
            "f_length": F.log((F.col("word_chars") + 600.0) / (words + 120.0)),
            "f_signs": F.log((F.col("n_signs") + 12.0) / (words + 120.0)),
            "f_near": F.log((F.col("n_near") + 12.0) / (words + 120.0)),
            "f_lines": F.log((words + 60.0) / (F.col("n_lines") + 6.0)),
        }
    )


def _with_groups(df: DataFrame, groups: DataFrame, size: int, keys: list[str] | None = None) -> DataFrame:
    return df.join(F.broadcast(groups) if size <= BROADCAST_GROUPS else groups, keys or ["grp"])


def _distance() -> Column:
    d = [F.col(f) - F.col(f"m{i}") for i, f in enumerate(FEATURES)]
    return sum((d[i] * d[j] * F.col(f"w{i}{j}") * (1.0 if i == j else 2.0) for i, j in PAIRS), F.lit(0.0))


MODEL_SCHEMA = "grp string, start int, det double, before double, " + ", ".join(f"m{i} double" for i in range(P)) + ", " + ", ".join(f"w{i}{j} double" for i, j in PAIRS)


def _models(grp, start, before, mean: np.ndarray, cov: np.ndarray, factor: float) -> pd.DataFrame:
    """Rows of MODEL_SCHEMA: determinants of the scatter and of the one before, centre, inverse of the scatter times `factor`."""
    size, axes = np.linalg.eigh(cov)
    size = np.maximum(size, LEAST_VARIANCE)
    inverse = np.einsum("nik,nk,njk->nij", axes, 1 / (size * factor), axes)
    out = {"grp": grp, "start": start, "det": size.prod(1), "before": before} | {f"m{i}": mean[:, i] for i in range(P)} | {f"w{i}{j}": inverse[:, i, j] for i, j in PAIRS}
    return pd.DataFrame(out)


def _from_moments(batches: Iterator[pd.DataFrame], factor: float) -> Iterator[pd.DataFrame]:
    for t in batches:
        n = t["n"].to_numpy(float)
        mean = np.stack([t[f"s{i}"].to_numpy(float) for i in range(P)], 1) / n[:, None]
        cov = np.zeros((len(t), P, P))
        for i, j in PAIRS:
            cov[:, i, j] = cov[:, j, i] = t[f"q{i}{j}"].to_numpy(float) / n - mean[:, i] * mean[:, j]
        yield _models(t["grp"], t["start"], t["before"], mean, cov, factor)


def _quantile_bin(counts: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The first bin at which a group's running count reaches `share` of it; counts has at most a fixed number of bins a key."""
    w = Window.partitionBy(*keys)
    run = F.sum("n").over(w.orderBy("bin"))
    return counts.withColumn("reached", run >= F.ceil(F.sum("n").over(w) * F.lit(share))).filter("reached").groupBy(*keys).agg(F.min("bin").alias("bin"))


def _binned(rows: DataFrame, model: DataFrame, size: int) -> DataFrame:
    """rows with the bin of their distance: 64 bins to a factor of e, 2048 in all."""
    return _with_groups(rows, model, size).select("grp", "start", "det", *FEATURES, F.least(F.floor((F.log(_distance() + 1e-9) + 21.0) * 64), F.lit(2047)).alias("bin"))


def _concentrated(rows: DataFrame, model: DataFrame, size: int, factor: float) -> DataFrame:
    """One concentration step: the moments of the COVER share of rows that are nearest to the model.

    Moments are summed by bin of distance in one pass over the rows; those of the inner bins, at most 2048 a model, are added,
    the last one by the part that makes up the share, so that determinants of steps compare.
    """
    sums = {f"s{i}": F.col(f) for i, f in enumerate(FEATURES)} | {f"q{i}{j}": F.col(FEATURES[i]) * F.col(FEATURES[j]) for i, j in PAIRS}
    bins = _binned(rows, model, size).groupBy("grp", "start", "bin").agg(F.count("*").alias("n"), F.max("det").alias("before"), *[F.sum(c).alias(k) for k, c in sums.items()])
    w = Window.partitionBy("grp", "start")
    within = F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = bins.withColumn("part", F.least((F.sum("n").over(w) * F.lit(COVER) - within) / F.col("n"), F.lit(1.0))).filter("part > 0")
    moments = inner.groupBy("grp", "start").agg(F.max("before").alias("before"), *[F.sum(F.col("part") * F.col(k)).alias(k) for k in ["n", *sums]])
    return moments.coalesce(max(1, -(-size // MODELS_A_TASK))).mapInPandas(lambda b: _from_moments(b, factor), MODEL_SCHEMA)


def _first_models(rows: DataFrame, size: int) -> DataFrame:
    """STARTS models a group, all from its medians and median deviations: no correlation, that of clipped values, that of signs."""
    middle = rows.groupBy("grp").agg(*[F.percentile_approx(f, 0.5, 2000).alias(f"m{i}") for i, f in enumerate(FEATURES)])
    middle = staged(middle, "medians")
    off = [F.abs(F.col(f) - F.col(f"m{i}")) for i, f in enumerate(FEATURES)]
    spread = _with_groups(rows, middle, size).groupBy("grp").agg(*[F.percentile_approx(d, 0.5, 2000).alias(f"d{i}") for i, d in enumerate(off)])
    scale = staged(middle.join(spread, "grp"), "spreads")
    least = LEAST_VARIANCE**0.5
    z = [(F.col(f) - F.col(f"m{i}")) / F.greatest(F.col(f"d{i}") * 1.4826, F.lit(least)) for i, f in enumerate(FEATURES)]
    clipped = [F.greatest(F.least(v, F.lit(1.5)), F.lit(-1.5)) for v in z]
    sums = [F.avg(clipped[i] * clipped[j]).alias(f"c{i}{j}") for i, j in PAIRS] + [F.avg(F.signum(z[i]) * F.signum(z[j])).alias(f"g{i}{j}") for i, j in PAIRS]
    seen = _with_groups(rows, scale, size).groupBy("grp").agg(*sums).join(scale, "grp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            mean = np.stack([t[f"m{i}"].to_numpy(float) for i in range(P)], 1)
            sd = np.maximum(np.stack([t[f"d{i}"].to_numpy(float) for i in range(P)], 1) * 1.4826, least)
            for start in range(STARTS):
                corr = np.tile(np.eye(P), (len(t), 1, 1))
                for i, j in PAIRS if start else []:
                    if i != j and start == 1:
                        r = t[f"c{i}{j}"] / np.sqrt(np.maximum(t[f"c{i}{i}"] * t[f"c{j}{j}"], 1e-12))
                    elif i != j:
                        r = np.sin(np.pi / 2 * t[f"g{i}{j}"])
                    else:
                        continue
                    corr[:, i, j] = corr[:, j, i] = np.clip(r, -0.99, 0.99)
                yield _models(t["grp"], np.full(len(t), start), np.full(len(t), np.inf), mean, corr * sd[:, :, None] * sd[:, None, :], 1.0)

    return staged(seen.mapInPandas(run, MODEL_SCHEMA), "mcd")


def _least(models: DataFrame, size: int) -> DataFrame:
    """The model of the least determinant of each group."""
    place = F.row_number().over(Window.partitionBy("grp").orderBy("det", "start"))
    return models.withColumn("place", place).filter("place = 1").drop("place").coalesce(max(1, -(-size // MODELS_A_TASK)))


def mcd_models(rows: DataFrame) -> DataFrame:
    """Per `grp`: centre, inverse scatter, its determinant before the consistency factor, and cut (rows: grp and FEATURES).

    A step keeps the COVER share of a group's distinct vectors that lie nearest to the present centre and takes their
    moments; all vectors take part in every step. Every start makes FIRST_STEPS of them, the one of the least
    determinant goes on until no group's determinant falls by more than the share SETTLED (MOST_STEPS at most). A step that
    raises a group's determinant, which bins can, is not taken, so that no group swings between two fits.
    """
    rows = staged(rows.distinct(), "vectors")
    size = rows.select("grp").distinct().count()
    factor = _consistency(COVER)
    model = _first_models(rows, size)
    for _ in range(FIRST_STEPS):
        model = staged(_concentrated(rows, model, STARTS * size, factor), "mcd")
    model = staged(_least(model, size), "mcd")
    for _ in range(MOST_STEPS):
        step = _concentrated(rows, model, size, factor)
        model = staged(_least(step.unionByName(model.withColumn("before", F.col("det"))), size), "mcd")
        moved = model.agg(F.max(F.abs(F.col("det") / F.col("before") - 1))).first()[0]
        if (moved or 0) <= SETTLED:
            break
    middle = _quantile_bin(_binned(rows, model, size).groupBy("grp", "bin").agg(F.count("*").alias("n")), ["grp"], 0.5)
    scaled = F.exp((F.col("bin") + 0.5) / 64 - 21.0) / MEDIAN * CUT
    return staged(model.join(middle.select("grp", scaled.alias("cut")), "grp").drop("start", "before"), "mcd")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, n_words, the four counts, base_failed, kept, distance, cut.

    Rows that fail a base rule take no part in the estimates and are not kept. A (lang, source) group of fewer than
    MIN_GROUP rows is pooled with its language's other small groups, and those below MIN_GROUP with each other. Null
    lang or source is a value of its own; null text has no words and fails. An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), label(lang_col).alias("lang"), label(source_col).alias("source"), F.col(text_col).cast("string").alias("text"))
    stats = read.mapInArrow(_statistics, f"doc_id long, lang string, source string, {STAT_SCHEMA}")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = staged(stats.withColumn("base_failed", failed), "statistics")
    rows = _features(stats.filter(~F.col("base_failed")))
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = sizes.filter(F.col("n") < MIN_GROUP).groupBy("lang").agg(F.sum("n").alias("n_lang"))
    named = staged(
        sizes.join(small, "lang", "left").select(
            "lang",
            "source",
            F.when(F.col("n") >= MIN_GROUP, F.concat_ws("\x1f", F.lit("s"), "lang", "source"))
            .when(F.col("n_lang") >= MIN_GROUP, F.concat_ws("\x1f", F.lit("l"), "lang"))
            .otherwise(F.lit("a"))
            .alias("grp"),
        ),
        "groups",
    )
    n_named = named.count()
    rows = rows.join(F.broadcast(named) if n_named <= BROADCAST_GROUPS else named, ["lang", "source"])
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    models = mcd_models(rows.select("grp", *FEATURES))
    judged = _with_groups(rows, models, n_named).withColumn("distance", _distance())
    none = F.lit(None).cast("double")
    return judged.select(*out, (F.col("distance") <= F.col("cut")).alias("kept"), "distance", "cut").unionByName(
        stats.filter("base_failed").select(*out, F.lit(False).alias("kept"), none.alias("distance"), none.alias("cut"))
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
