"""Benchmark decontamination by winnowing (DataFrame functions only).

Of every stretch of consecutive word k-grams as long as a benchmark window, the one of the least hash is kept as a
fingerprint, for documents and items alike, so a document that holds a window keeps one of that window's own
fingerprints. Fingerprints are joined, and each hit is extended to the windows around it; a window counts where its
words are those of a benchmark window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.exact_dedup import LOWER, UPPER
from loomgraph.llm.scratch import staged

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
GRAM = 5
# Fingerprints or windows of the benchmark up to this number (about 100 MB as a hash table) are broadcast; above it
# the same joins are shuffled.
MOST_BROADCAST = 500_000
# Most bits of the map that tells fingerprints which the benchmark lacks before they become rows.
MOST_BITS = 1 << 22


def words_of(text: Column) -> Column:
    """Words of letters, digits and all characters beyond ASCII, A-Z lower-cased; null has none."""
    text = F.coalesce(text, F.lit(""))
    # of plain ASCII, lower() changes A-Z only, and it is faster
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, BREAK), "")


def _runs(df: DataFrame, source: str, n: int, name: str, op) -> DataFrame:
    """df with column `name`: op over every n consecutive elements of array `source`, by doubling.

    op joins what stands at two places; the last step may overlap, as it may for a least, a greatest or a hash. Every
    step is a column of its own that is read twice, so that no plan evaluates it inside a lambda.
    """
    have, size, made = source, 1, []
    while size < n or not made:
        by = min(size, n - size)
        step = f"{name}_{size}"
        left = F.greatest(F.size(have) - by, F.lit(0))
        df = df.withColumn(step, F.zip_with(F.slice(have, 1, left), F.slice(have, by + 1, left), op) if by else F.col(have))
        made.append(step)
        have, size = step, size + by
    return df.withColumnRenamed(have, name).drop(*made[:-1])


def _bitmap(prints: DataFrame, count: int) -> tuple[Column, int] | None:
    """A bit for each of `count` fingerprints as a constant array of words of 32 bits, and its number of bits.

    It is at most MOST_BITS long whatever the benchmark; where so many fingerprints would fill it, there is none.
    """
    n = 1 << 10
    while n < 64 * count and n < MOST_BITS:
        n *= 2
    if 4 * count > n:
        return None
    bit = F.col("print").bitwiseAND(F.lit(n - 1))
    rows = prints.select(F.shiftright(bit, 5).alias("w"), F.expr("shiftleft(1L, cast(print & 31 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    words = [0] * (n // 32)
    for r in rows:
        words[r["w"]] = r["b"]
    return F.expr(f"cast(split('{','.join(map(str, words))}', ',') as array<bigint>)"), n


def _grams(df: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """df(words, ...) with columns g<k>: hashes of all k-grams, for each k that windows of these lengths need."""
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    for k in sorted({min(gram, n) for n in lengths}):
        df = _runs(df, "h", k, f"g{k}", lambda a, b: F.xxhash64(a, b))
    return df


def winnowed(df: DataFrame, lengths: list[int], gram: int = GRAM, bitmap: tuple[Column, int] | None = None) -> DataFrame:
    """df(words, ...) with prints: array of (length, at, print, first, around), the fingerprints for windows of each length.

    A window of n words has w = n - k + 1 k-grams (k = min(gram, n)); of every w in a row the least is kept, so a
    k-gram stays if it equals the greatest of the least values of the stretches that hold it. `around` holds the words
    from number `first` on in which every window lies that holds the k-gram at `at`. Where a bitmap is given,
    fingerprints without a bit in it are left out.
    """

    def chosen(g: Column, top: Column | None):
        def of(i: Column) -> Column:
            x = F.get(g, i)
            kept = F.lit(True) if top is None else x == F.get(top, i)
            if bitmap is None:
                return kept
            bits, size = bitmap
            at = x.bitwiseAND(F.lit(size - 1))
            return kept & (F.getbit(F.get(bits, F.shiftright(at, 5).cast("int")), at.bitwiseAND(F.lit(31)).cast("int")) == 1)

        return of

    def found(n: int, k: int, g: Column):
        def of(p: Column) -> Column:
            first = F.greatest(p - (n - k), F.lit(0))
            around = F.slice(F.col("words"), first + 1, p + n - first)
            return F.struct(F.lit(n).alias("length"), p.alias("at"), F.get(g, p).alias("print"), first.alias("first"), around.alias("around"))

        return of

    df, parts = _grams(df, lengths, gram), []
    for n in lengths:
        k = min(gram, n)
        g, w, top = F.col(f"g{k}"), n - k + 1, None
        if w > 1:
            df = _runs(df, f"g{k}", w, "least", lambda a, b: F.least(a, b))
            pad = F.array_repeat(F.lit(-(1 << 63)), w - 1)
            df = _runs(df.withColumn("padded", F.concat(pad, "least", pad)), "padded", w, f"top{n}", lambda a, b: F.greatest(a, b)).drop("least", "padded")
            top = F.col(f"top{n}")
        places = F.when(F.size(g) > 0, F.sequence(F.lit(0), F.size(g) - 1)).otherwise(F.array().cast("array<int>"))
        # with fewer k-grams than a stretch no window of this length fits; top is read twice, see _runs
        fits = F.size(g) >= w if top is None else (F.size(g) >= w) & (F.size(top) == F.size(g))
        df = df.withColumn(f"p{n}", F.filter(F.when(fits, places).otherwise(F.array().cast("array<int>")), chosen(g, top)))
        parts.append(F.transform(f"p{n}", found(n, k, g)))
    return df.withColumn("prints", F.concat(*parts))


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id text, length, words): every window of each item, a shorter item being one window."""
    read = items.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("all")).filter("size(all) > 0")
    n = F.least(F.size("all"), F.lit(window))
    cut = F.transform(F.sequence(F.lit(0), F.size("all") - n), lambda i: F.slice(F.col("all"), i + 1, n))
    return read.select("item_id", n.alias("length"), F.explode(cut).alias("words"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words inside any occurrence of a benchmark window are hit; `items_sha256` digests the sorted ids of the items
    with such windows. Null and empty texts have no words, no windows and no hits. Rows that repeat a doc_id or a text
    are judged one by one, each by its own text; a null doc_id stays null. Items that repeat an item_id are one item; an
    item without id marks words and is neither counted nor listed. An empty benchmark hits nothing, an empty table
    gives an empty result. Other columns of both tables are ignored. A document of any length is one row of its own,
    so memory grows with the longest text and not with the number of documents.
    """
    windows = staged(benchmark_windows(benchmark, item_col, item_text_col, window).distinct(), "windows")
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most `window` of them
    prints = staged(_benchmark_prints(windows, lengths, gram), "prints")
    sets = staged(windows.groupBy(F.array_join("words", " ").alias("text")).agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("set_id", F.sha2(F.array_join("items", ","), 256)), "item-sets")
    n_prints = prints.count()
    few = sets.count() <= most_broadcast and n_prints <= most_broadcast
    sized = F.broadcast if few else lambda df: df

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), words_of(F.col(text_col)).alias("words"))
    # one row without a place stands for the document itself, under a key of its own so that it joins nowhere in particular
    own = F.struct(F.lit(0).alias("length"), F.lit(-1).alias("at"), F.xxhash64("row").alias("print"), F.lit(0).alias("first"), F.array().cast("array<string>").alias("around"))
    each = winnowed(read, lengths, gram, _bitmap(prints, n_prints)).select("doc_id", "row", F.size("words").alias("n_words"), F.explode_outer(F.concat(F.array(own), "prints")).alias("p")) if lengths else read.select("doc_id", "row", F.size("words").alias("n_words"), own.alias("p"))
    each = each.select("doc_id", "row", "n_words", "p.*").join(sized(prints.withColumn("known", F.lit(True))), ["length", "print"], "left")
    kept = staged(each.filter("at < 0 or known").select("doc_id", "row", "n_words", "length", "at", "first", "around"), "hits")

    around = F.transform(F.sequence(F.lit(0), F.size("around") - F.col("length")), lambda j: F.struct((F.col("first") + j).alias("start"), F.array_join(F.slice(F.col("around"), j + 1, F.col("length")), " ").alias("text")))
    extended = kept.filter("at >= 0 and size(around) >= length").select("row", "length", F.explode(around).alias("w")).select("row", "length", "w.start", "w.text")
    found = staged(extended.join(sized(sets.select("text", "set_id")), "text").select("row", "start", "length", "set_id").distinct(), "found-windows")
    spans = found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("stop")))).alias("spans"))
    listed = found.select("row", "set_id").distinct().join(sets.select("set_id", "items").dropDuplicates(["set_id"]), "set_id").groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    judged = kept.filter("at < 0").select("row", "doc_id", "n_words").join(spans, "row", "left").join(listed, "row", "left")
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop"))
    covered = F.aggregate("spans", none, lambda acc, s: F.struct((acc["n"] + F.greatest(s["stop"] - F.greatest(s["start"], acc["stop"]), F.lit(0))).alias("n"), F.greatest(s["stop"], acc["stop"]).alias("stop")))["n"]
    items = F.coalesce("items", F.array().cast("array<string>"))
    return judged.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.coalesce(covered, F.lit(0)) > 0).alias("contaminated"),
    )


def _benchmark_prints(windows: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """(length, print): each window's own fingerprint, the least of all its k-grams."""
    if not lengths:
        return windows.sparkSession.createDataFrame([], "length int, print long")
    # explode_outer: a filter that explode infers would put the arrays' whole definitions inside their own lambdas
    parts = None
    for n in lengths:
        of = winnowed(windows.filter(F.col("length") == n).select("words"), [n], gram).select(F.explode_outer("prints").alias("p")).select("p.length", "p.print")
        parts = of if parts is None else parts.unionByName(of)
    return parts.distinct()


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _words(table: str, key: str) -> str:
    word = BREAK.replace("[", "[^")
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{word}') AS w FROM {table}"


ORACLE = f"""
    WITH d AS ({_words("documents", "doc_id")}), i AS ({_words("benchmark", "item_id")}),
    iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s + 1 : s + n], ' ') AS t
           FROM (SELECT *, unnest(generate_series(0, len(w) - n)) AS s FROM (SELECT *, least(len(w), {WINDOW}) AS n FROM i WHERE len(w) > 0))),
    dw AS (SELECT doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') AS t
           FROM (SELECT *, unnest(generate_series(0, len(w) - n)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
    hit AS (SELECT doc_id, s, n, item_id FROM dw JOIN iw USING (n, t)),
    cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY 1),
    it AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) WHERE k IS NOT NULL GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)"""
