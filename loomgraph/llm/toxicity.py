"""Toxicity by a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings of itself and of its first bytes (stems). Filters of several widths slide
over the words, their maxima over the whole text feed a logistic layer. Embeddings start from smoothed log odds of
their bucket and are then trained with the filters by AdaGrad. A cut is calibrated for each language, told from the
letters of the text, and shifts the score so that 0.5 is the decision everywhere.

Every labelled row counts: log odds are summed over all, shards of the rows train from one start and their moves are
averaged, and cuts are chosen by the counts of all rows left out of the fit.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.memory import give_back
from loomgraph.llm.scratch import staged
from loomgraph.llm.shipping import ship_package
from loomgraph.llm.words import BASE, BASE_INVERSE, Words, mix, powers, text_blocks, word_runs

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
STEMS = (4, 5, 6, 8)
KINDS = 1 + len(STEMS)
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 4
RATE = 0.05
BATCH = 16
OUT_ROWS = 1_000
SAMPLE_ROWS = 6_000
SAMPLE_BYTES = 48 << 20
FOLDS = 5
# Of 100 rows those that are fitted, where there are enough to leave the others out; text that one shard trains on.
FITTED = 85
ENOUGH_ROWS = 200
SHARD_BYTES = 16 << 20
# Logits are counted in steps of 1 / STEPS between -SPAN and SPAN.
SPAN = 64
STEPS = 256
# Letters (second byte after 0xC3) that mark a text's language.
LETTERS = {"de": "äöüß", "es": "ñóíáú", "fr": "éèêçàùâî"}
SIGN = np.zeros(256, bool)
SIGN[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
LANGUAGES = ["other", *LETTERS]
MARKERS = np.zeros((len(LETTERS), 256), bool)
for _i, _letters in enumerate(LETTERS.values()):
    for _c in _letters + _letters.upper():
        if len(_c.encode()) == 2:
            MARKERS[_i, _c.encode()[1]] = True


def features(w: Words) -> np.ndarray:
    """Rows of the embedding table for every word: the word (signs at its end cut off), then its first bytes."""
    if not len(w.start):
        return np.zeros((0, KINDS), np.int32)
    data = w.data
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=total[1:])
    inverse = powers(BASE_INVERSE, len(data))[w.start]
    base = total[w.start]
    end = w.end.copy()
    for _ in range(4):
        end -= SIGN[data[end - 1]] & (end - 1 > w.start)
    out = np.zeros((len(w.start), KINDS), np.int32)
    for k, stem in enumerate((None, *STEMS)):
        stop = end if stem is None else np.minimum(w.start + stem, end)
        h = mix((total[stop] - base) * inverse) >> np.uint64(64 - BUCKET_BITS)
        # a stem that is the whole word says nothing more: bucket 0, which stays zero
        known = np.ones(len(h), bool) if stem is None else stop < end
        out[:, k] = k * BUCKETS + np.where(known, h.astype(np.int32), 0)
    return out


def languages(w: Words) -> np.ndarray:
    """Index into LANGUAGES for each document, by marked letters; "other" below one in sixteen words."""
    hit = np.zeros((w.n_docs, len(LETTERS)), np.int64)
    if len(w.data) > 1:
        lead = np.flatnonzero(w.data[:-1] == 0xC3)
        doc = np.searchsorted(w.bounds, lead, "right") - 1
        for i in range(len(LETTERS)):
            hit[:, i] = np.bincount(doc[MARKERS[i, w.data[lead + 1]]], minlength=w.n_docs)
    best = hit.argmax(1)
    enough = hit[np.arange(w.n_docs), best] * 16 >= np.maximum(w.counts, 1)
    return np.where(enough, best + 1, 0)


@dataclass
class Model:
    table: np.ndarray
    kernels: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    cuts: np.ndarray

    def activations(self, rows: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Filter responses at every word; a window that runs past its document's end sees zeros there."""
        x = self.table[rows[:, 0]]
        for k in range(1, KINDS):
            x += self.table[rows[:, k]]
        each = x @ np.concatenate([tap for kernel in self.kernels for tap in kernel], 1)
        out = np.empty((len(x), FILTERS * len(self.kernels)), np.float32)
        at = 0
        for i, kernel in enumerate(self.kernels):
            z = out[:, i * FILTERS : (i + 1) * FILTERS]
            z[:] = each[:, at : at + FILTERS]
            for s in range(1, min(len(kernel), len(x))):
                late = each[s:, at + s * FILTERS : at + (s + 1) * FILTERS]
                late[owner[s:] != owner[:-s]] = 0
                z[:-s] += late
            at += len(kernel) * FILTERS
        return out

    def logits(self, w: Words) -> np.ndarray:
        """One logit a document; without words the pooled response is zero."""
        pooled = np.zeros((w.n_docs, len(self.bias)), np.float32)
        if len(w.start):
            z = self.activations(features(w), w.owner)
            some = np.flatnonzero(w.counts)
            pooled[some] = np.maximum(np.maximum.reduceat(z, w.first[some], axis=0) + self.bias, 0)
        return pooled @ self.out + self.out_bias

    def logit(self, rows: np.ndarray) -> float:
        """The logit of one document by the features of its words."""
        pooled = np.zeros(len(self.bias), np.float32)
        if len(rows):
            pooled = np.maximum(self.activations(rows, np.zeros(len(rows), np.int64)).max(0) + self.bias, 0)
        return float(pooled @ self.out + self.out_bias)

    def scores(self, w: Words) -> np.ndarray:
        z = self.logits(w).astype(np.float64) - self.cuts[languages(w)]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _bucket_counts(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """How many documents of each class hold a bucket."""
    seen = np.zeros((2, KINDS * BUCKETS), np.int64)
    for rows, label in zip(docs, y, strict=True):
        seen[int(label), np.unique(rows)] += 1
    return seen


def _log_odds(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Smoothed log odds of each bucket by the documents of each class that hold it, of n a class."""
    n = np.maximum(n, 1)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    support = seen.sum(0) / (seen.sum(0) + 2)
    return np.clip(odds * support, -4, 4)


def _fresh_model(rng: np.random.Generator) -> Model:
    width = FILTERS * len(WIDTHS)
    table = rng.normal(0, 0.05, (KINDS * BUCKETS, DIM)).astype(np.float32)
    kernels = [rng.normal(0, 0.2, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
    return Model(table, kernels, np.zeros(width, np.float32), rng.normal(0.2, 0.1, width).astype(np.float32), -2.0, np.zeros(len(LANGUAGES)))


def _constant(model: Model) -> Model:
    """Every score is low and the same."""
    model.table[:], model.out_bias = 0, -4.0
    return model


def _start_from(model: Model, seen: np.ndarray, n: np.ndarray) -> None:
    """The table starts from the log odds of all fitted documents."""
    model.table[:, 0] += 0.3 * _log_odds(seen, n).astype(np.float32)
    model.table[np.arange(KINDS) * BUCKETS] = 0
    for kernel in model.kernels:
        kernel[:, 0] += 0.5


def _documents(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The features of each document's words, and its language."""
    docs, langs = [], []
    for _, _, w in word_runs(texts, fold=True):
        docs += np.split(features(w), w.first[1:-1])
        langs.append(languages(w))
    return docs, np.concatenate(langs) if langs else np.zeros(0, np.int64)


def train(texts: list[str | None], labels: list[int], seed: int = 17) -> Model:
    """Fit the classifier on this machine; without both classes every score is low and the same."""
    y = np.array(labels, np.int64)
    docs, lang = _documents(pa.array(texts, pa.string()))
    rng = np.random.default_rng(seed)
    model = _fresh_model(rng)
    if len(set(labels)) < 2:
        return _constant(model)
    fit = np.ones(len(y), bool)
    if len(y) >= ENOUGH_ROWS:
        fit = rng.random(len(y)) < FITTED / 100
    n = np.bincount(y[fit], minlength=2)
    _start_from(model, _bucket_counts([d for d, f in zip(docs, fit, strict=True) if f], y[fit]), n)
    _descend(model, docs, y, np.flatnonzero(fit), n, rng)
    out = ~fit if (~fit).any() else fit
    z = np.array([model.logit(rows) for rows in docs])
    model.cuts[:] = _cuts(_logit_counts(z[out], y[out], lang[out]))
    return model


def _descend(model: Model, docs: list[np.ndarray], y: np.ndarray, order: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> None:
    """EPOCHS of AdaGrad over the documents of `order`; classes are weighted by n, the fitted documents of each."""
    width = FILTERS * len(WIDTHS)
    params = [model.table, *model.kernels, model.bias, model.out]
    speed = [np.full(p.shape, 1e-3, np.float32) for p in params]
    bias_speed = 1e-3
    share = n / n.sum()
    weight = np.where(y == 1, 0.5 / max(share[1], 0.05), 0.5 / share[0])
    order = order[np.array([len(docs[i]) > 0 for i in order], bool)]

    def step(i: int, grad: np.ndarray, at=slice(None)) -> None:
        speed[i][at] += grad**2
        params[i][at] -= RATE * grad / np.sqrt(speed[i][at])

    for _ in range(EPOCHS):
        rng.shuffle(order)
        for b in range(0, len(order), BATCH):
            pick = order[b : b + BATCH]
            rows = np.concatenate([docs[i] for i in pick])
            sizes = np.array([len(docs[i]) for i in pick])
            first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            owner = np.repeat(np.arange(len(pick)), sizes)
            z = model.activations(rows, owner)
            arg = np.stack([z[a : a + n].argmax(0) + a for a, n in zip(first, sizes, strict=True)])
            raw = z[arg, np.arange(width)] + model.bias
            hidden = np.maximum(raw, 0)
            prob = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.out_bias, -30, 30)))
            d = ((prob - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            back = d[:, None] * model.out * (raw > 0)
            g_out = hidden.T @ d + 1e-4 * model.out
            x_grad: dict[str, list] = {"at": [], "g": []}
            g_kernels = []
            for k, kernel in enumerate(model.kernels):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                g = np.zeros_like(kernel)
                for s in range(len(kernel)):
                    at = arg[:, cols] + s
                    inside = at < (first + sizes)[:, None]
                    at = np.where(inside, at, 0)
                    x = model.table[rows[at]].sum(2)
                    dz = back[:, cols] * inside
                    g[s] = np.einsum("bfd,bf->df", x, dz)
                    x_grad["at"].append(at[inside])
                    x_grad["g"].append((dz[:, :, None] * kernel[s].T[None])[inside])
                g_kernels.append(g)
            at, gx = np.concatenate(x_grad["at"]), np.concatenate(x_grad["g"])
            buckets, inverse = np.unique(rows[at], return_inverse=True)
            g_table = np.zeros((len(buckets), DIM), np.float32)
            for k in range(KINDS):
                np.add.at(g_table, inverse.reshape(len(at), KINDS)[:, k], gx)
            live = buckets % BUCKETS != 0
            step(0, g_table[live], buckets[live])
            for k, g in enumerate(g_kernels):
                step(1 + k, g)
            step(1 + len(model.kernels), back.sum(0))
            step(2 + len(model.kernels), g_out)
            bias_speed += float(d.sum()) ** 2
            model.out_bias -= RATE * float(d.sum()) / bias_speed**0.5


def _logit_counts(z: np.ndarray, y: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Rows by language, class and step of their logit."""
    counts = np.zeros((len(LANGUAGES), 2, 2 * SPAN * STEPS), np.int64)
    np.add.at(counts, (lang, y, np.clip(np.floor((z + SPAN) * STEPS), 0, counts.shape[2] - 1).astype(np.int64)), 1)
    return counts


def _cuts(counts: np.ndarray) -> np.ndarray:
    """Cut of each language between its classes: least weighted error, at the edge of a step."""
    edges = np.arange(counts.shape[2] + 1) / STEPS - SPAN

    def cut(clean: np.ndarray, toxic: np.ndarray, prior: float) -> float:
        if toxic.sum() < 5 or clean.sum() < 5:
            return prior
        below = lambda n: np.concatenate(([0], np.cumsum(n))) / n.sum()
        used = np.flatnonzero(clean + toxic)
        tries = slice(max(used[0] - STEPS, 0), used[-1] + 2 + STEPS)
        cost = (below(toxic) + 3 * (1 - below(clean)))[tries]
        best = edges[tries][cost <= cost.min() + 1e-12]
        # a wide gap between the classes: its middle, drawn to the prior if that lies inside
        return float(np.clip(prior, best.min(), best.max()))

    shared = cut(*counts.sum(0), 0.0)
    return np.array([cut(*each, shared) for each in counts])


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, y, text, n_bytes, part) of every labelled document outside the held-out fold; part: 0 to 99, by hash."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(F.col("toxic").cast("int")) == 1).cast("int").alias("y"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # one plan at every size: labels are hashed where they meet the texts, which are neither sorted nor spilled
    return read.join(one.hint("shuffle_hash"), "doc_id").select("doc_id", "y", "text", F.octet_length("text").alias("n_bytes"), F.pmod(F.xxhash64("doc_id"), F.lit(100)).alias("part"))


def _added(df: DataFrame) -> list[np.ndarray]:
    """The sums of arrays that each row of df holds as bytes, by column: float32 or, of a name in n_, int64."""

    def arrays(row) -> list[np.ndarray]:
        return [np.frombuffer(row[c], np.int64 if c.startswith("n_") else np.float32).copy() for c in row.__fields__]

    def add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        for x, y in zip(a, b, strict=True):
            x += y
        return a

    return df.rdd.map(arrays).treeReduce(add, 3)


def _one_row(**arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays.values()], list(arrays))


def fit_all(rows: DataFrame, seed: int = 17, shard_bytes: int = SHARD_BYTES) -> Model:
    """Fit the classifier on all `rows` (as of labelled_rows, staged).

    Rows are dealt by hash into shards of about `shard_bytes` of text. Each shard trains from the same start, which holds
    the log odds of all fitted rows; moves of weights are averaged over shards, those of a bucket over the shards
    that moved it. What leaves a task has the size of the model or of the counts, and is added up a tree.
    """
    spark = rows.sparkSession
    ship_package(spark)
    model = _fresh_model(np.random.default_rng(seed))
    fitted = F.col("part") < FITTED
    total = rows.agg(F.count("*").alias("n"), F.sum("n_bytes").alias("size"), *(F.count(F.when(F.expr(f"y = {k}") & c, 1)).alias(f"{name}{k}") for k in (0, 1) for name, c in (("all", F.lit(True)), ("fit", fitted)))).first()
    if not total["all0"] or not total["all1"]:
        return _constant(model)
    aside = total["n"] >= ENOUGH_ROWS and total["fit0"] > 0 and total["fit1"] > 0 and total["fit0"] + total["fit1"] < total["n"]
    fit, out = (rows.filter(fitted), rows.filter(~fitted)) if aside else (rows, rows)
    name = "fit" if aside else "all"
    n = np.array([total[f"{name}0"], total[f"{name}1"]])
    shards = max(1, round(total["size"] / shard_bytes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, KINDS * BUCKETS), np.int64)
        for b in text_blocks(batches):
            seen += _bucket_counts(_documents(b.column("text"))[0], b.column("y").to_numpy())
        yield _one_row(n_seen=seen)

    _start_from(model, _added(fit.select("y", "text").mapInArrow(count, "n_seen binary"))[0].reshape(2, -1), n)
    start = spark.sparkContext.broadcast(model)

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        whole = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        shard, y, own = whole.column("shard")[0].as_py(), whole.column("y").to_numpy(), copy.deepcopy(start.value)
        docs = _documents(whole.column("text"))[0]
        del whole, held
        _descend(own, docs, y, np.arange(len(y)), n, np.random.default_rng([seed, shard]))
        table = own.table - start.value.table
        rest = np.concatenate([x.ravel() for x in (*own.kernels, own.bias, own.out)] + [[own.out_bias]]).astype(np.float32)
        yield _one_row(table=table, n_moved=table.any(1).astype(np.int64), rest=rest, n_used=np.ones(1, np.int64))
        del docs, own, table
        give_back()

    dealt = fit.select("doc_id", "y", "text", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(shards)).cast("int").alias("shard"))
    dealt = dealt.repartitionById(shards, F.col("shard"))
    table, moved, rest, used = _added(dealt.mapInArrow(trained, "table binary, n_moved binary, rest binary, n_used binary"))
    model.table += table.reshape(model.table.shape) / np.maximum(moved, 1)[:, None]
    rest, at = rest / used[0], 0
    for x in (*model.kernels, model.bias, model.out):
        x[...] = rest[at : at + x.size].reshape(x.shape)
        at += x.size
    model.out_bias = float(rest[at])
    start.destroy()
    shared = spark.sparkContext.broadcast(model)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [(shared.value.logits(w), languages(w)) for _, _, w in word_runs(b.column("text"), fold=True, most=1 << 19)]
            if parts:
                z, lang = (np.concatenate(x) for x in zip(*parts, strict=True))
                step = np.clip(np.floor((z.astype(np.float64) + SPAN) * STEPS), 0, 2 * SPAN * STEPS - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), b.column("y"), pa.array(step)], ["lang", "y", "step"])

    counts = np.zeros((len(LANGUAGES), 2, 2 * SPAN * STEPS), np.int64)
    for r in out.select("y", "text").mapInArrow(place, "lang int, y int, step long").groupBy("lang", "y", "step").count().collect():
        counts[r["lang"], r["y"], r["step"]] = r["count"]
    shared.destroy()
    model.cuts[:] = _cuts(counts)
    return model


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str | None], list[int]]:
    """For a fit on one machine (`train`), not used by the queries: at most `rows` labelled documents outside the held-out fold, toxic ones first up to half, in an order by hash.

    Texts are taken whole; one with which the sample would pass `most_bytes` is left out. Only texts of the sample
    reach the driver. The order depends on doc_id only through its hash, and neither it nor any other column than
    the text is a feature.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    one = usable.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("k", F.xxhash64("doc_id"))
    toxic = one.filter("y = 1").orderBy("k").limit(rows // 2)
    clean = one.filter("y <> 1").orderBy("k").limit(rows - rows // 2)
    picked = toxic.unionByName(clean)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.struct(F.octet_length(text).alias("n"), F.xxhash64(text).alias("h")).alias("size"))
    sized = read.select("doc_id", "size").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "k", "y").agg(F.min("size").alias("size"))
    kept, total = [], 0
    for r in sorted(sized.collect(), key=lambda r: r["k"]):
        if total + r["size"]["n"] <= most_bytes:
            kept.append((r["doc_id"], r["size"], int(r["y"] == 1)))
            total += r["size"]["n"]
    chosen = docs.sparkSession.createDataFrame(kept, "doc_id long, size struct<n int, h long>, y int")
    got = read.join(F.broadcast(chosen), ["doc_id", "size"]).groupBy("doc_id").agg(F.first("text").alias("text"), F.first("y").alias("y")).collect()
    got.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in got], [r["y"] for r in got]


def held_out(doc_id):
    """True for documents whose labels are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score in 0..1 over the whole text, predicted (score >= 0.5).

    Null and empty texts get the score of a text without words. Repeated rows get equal scores, a null doc_id is
    kept as it is, other columns are ignored. Nothing is shuffled; the model (of fixed size) is broadcast.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [shared.value.scores(w) for _, _, w in word_runs(b.column("text"), fold=True, most=1 << 19)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores below 0.5; nothing is shuffled.

    Null and empty texts are scored like a text without words, repeated rows alike, and an empty table stays empty.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), OUT_ROWS):
                b = whole.slice(i, OUT_ROWS)
                parts = [shared.value.scores(w) for _, _, w in word_runs(b.column(at), fold=True, most=1 << 19)]
                yield b.filter(pa.array(np.concatenate(parts) < 0.5))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def fit_toxicity(spark: SparkSession, sf_dir: str) -> Model:
    rows = labelled_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = fit_all(staged(rows, "labelled"))
    give_back()
    return model


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), fit_toxicity(spark, sf_dir))
