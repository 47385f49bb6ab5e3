"""Packing of documents into fixed-length sequences by cutting-stock column generation.

A document longer than a sequence gives full sequences of its own; what remains is an item, and items are counted in
a histogram of length classes. A linear program over patterns (how many items of each class share one sequence) is
solved by column generation: a knapsack dynamic program prices new patterns against the duals until none improves.
Rounded pattern counts say which rank of which class goes into which sequence, so the documents, ranked within their
class without gathering any of them, find their places by arithmetic. The space that is left over in the sequences
is filled by a stream of a few short documents, cut where a gap ends; the rest of that stream fills sequences of its
own, the last of which are powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.memory import give_back
from loomgraph.llm.scratch import staged
from loomgraph.llm.shipping import ship_package
from loomgraph.llm.word_tokens import END_ID, MODEL_FILE, tokenizer
from loomgraph.llm.words import text_blocks

CAPACITY = 2048
GRAIN = 16
FILLER_EVERY = 16
STREAM_BLOCK = 1 << 16
RUN_BLOCK = 4096
MOST_PIVOTS = 5_000
MOST_STALLED = 200
# The present cover over the best pattern's value bounds the optimum from below, so this is the share left to gain.
NEAR = 5e-4


def best_pattern(worth: np.ndarray, units: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack of `room` units (units ascending): its value and how often each item is taken."""
    best = np.zeros(room + 1)
    taken = np.full(room + 1, -1)
    fits = np.searchsorted(units, np.arange(room + 1), "right").tolist()
    for u in range(1, room + 1):
        best[u] = best[u - 1]
        if fits[u]:
            value = worth[: fits[u]] + best[u - units[: fits[u]]]
            k = int(value.argmax())
            if value[k] > best[u] + 1e-12:
                best[u], taken[u] = value[k], k
    pattern = np.zeros(len(units))
    u = room
    while u > 0:
        if taken[u] < 0:
            u -= 1
        else:
            pattern[taken[u]] += 1
            u -= units[taken[u]]
    return float(best[room]), pattern


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """A product of a small matrix and a vector, without threads of a linear algebra library."""
    return np.einsum("ij,j->i", matrix, vector)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan elimination with row pivots, without threads of a linear algebra library either."""
    n = len(matrix)
    both = np.concatenate((matrix, np.eye(n)), axis=1)
    for c in range(n):
        p = c + int(np.abs(both[c:, c]).argmax())
        both[[c, p]] = both[[p, c]]
        both[c] /= both[c, c]
        factor = both[:, c].copy()
        factor[c] = 0
        both -= np.multiply.outer(factor, both[c])
    return both[:, n:]


def column_generation(units: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and their fractional counts that cover `demand` with the fewest sequences.

    A revised simplex: the basis starts from one-class patterns; each step enters the pattern the knapsack prices
    above its cost of one, or the surplus of a class whose dual is negative. It ends when no pattern can gain more
    than the share NEAR, or after MOST_STALLED steps without gain; the cover that it returns is whole in either case.
    """
    m = len(units)
    basis = np.diag((room // units).astype(float))
    cost = np.ones(m)
    inverse = np.diag(1 / np.diag(basis))
    # unequal hundredths keep ties out of the ratio test, where the simplex would stand still
    demand = demand + 0.01 * (1 + np.arange(m) * 0.6180339887 % 1)
    x = _times(inverse, demand)
    before, stalled = np.inf, 0
    for step in range(MOST_PIVOTS):
        dual = _times(inverse.T, cost)
        low = int(dual.argmin())
        if dual[low] < -1e-9:
            column, price = np.zeros(m), 0.0
            column[low] = -1
        else:
            value, column = best_pattern(dual, units, room)
            price = 1.0
            if value <= 1 + NEAR:
                break
        move = _times(inverse, column)
        up = move > 1e-10
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, move, 1), np.inf)
        leave = int(ratio.argmin())
        basis[:, leave], cost[leave] = column, price
        if step % 50 == 49:
            inverse = _inverse(basis)
        else:
            pivot = inverse[leave] / move[leave]
            inverse -= np.multiply.outer(move, pivot)
            inverse[leave] = pivot
        x = np.maximum(_times(inverse, demand), 0)
        total = float((cost * x).sum())
        before, stalled = (total, 0) if total < before * (1 - NEAR / 10) else (before, stalled + 1)
        if stalled > MOST_STALLED:
            break
    used = cost > 0
    return basis[:, used].T.round().astype(np.int64), x[used]


def round_patterns(units: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole counts of patterns that place exactly `demand` items: patterns (rows) and how many sequences use each.

    Counts are rounded down; the items left, fewer than the patterns hold once, go first-fit decreasing.
    """
    if not len(units):
        return np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
    patterns, x = column_generation(units, demand.astype(float), room)
    left = demand.copy()
    rows, counts = [], []
    for p, n in sorted(zip(patterns.tolist(), x.tolist(), strict=True), key=lambda t: -t[1]):
        n = int(n + 1e-6)
        # a class the patterns over-cover runs out before the others: the pattern goes on without it
        while n > 0:
            now = np.minimum(p, left)
            some = now > 0
            if not some.any():
                break
            times = min(n, int((left[some] // now[some]).min()))
            rows.append(now)
            counts.append(times)
            left = left - times * now
            n -= times
    bins: list[list] = []
    for c in np.argsort(-units):
        for _ in range(int(left[c])):
            for b in bins:
                if b[0] >= units[c]:
                    break
            else:
                b = [room, np.zeros(len(units), np.int64)]
                bins.append(b)
            b[0] -= int(units[c])
            b[1][c] += 1
    return np.array([*rows, *(b[1] for b in bins)]).reshape(-1, len(units)), np.array([*counts, *(1 for _ in bins)], np.int64)


ITEM_SCHEMA = (
    "doc_id long, part int, doc_tokens long, full_crcs array<long>, full_rank long, cls int, cls_rank long, item_length long, item_crc long, fill_from long, ids binary"
)


def _tokenised(docs: DataFrame, model: str, id_col: str, text_col: str) -> DataFrame:
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = np.zeros(CAPACITY // GRAIN + 1, np.int64)
        full_rank = fill_from = 0
        for block in text_blocks(batches):
            out = []
            for ids, part, fill in zip(tokenizer(model).encode(block.column("text")), block.column("part").to_pylist(), block.column("fill").to_pylist(), strict=True):
                ids += end
                n = len(ids) // 4
                if fill and n <= CAPACITY:
                    out.append((part, n, [], 0, None, None, 0, None, fill_from, ids))
                    fill_from += n
                    continue
                crcs = [zlib.crc32(ids[i : i + 4 * CAPACITY]) for i in range(0, len(ids) - 4 * CAPACITY + 1, 4 * CAPACITY)]
                rest = n % CAPACITY
                cls = -(-rest // GRAIN)
                out.append((part, n, crcs, full_rank, cls or None, int(ranks[cls]) if cls else None, rest, zlib.crc32(ids[-4 * rest :]) if rest else None, None, None))
                full_rank += len(crcs)
                ranks[cls] += 1
            types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *cols], [f.split(" ")[0] for f in ITEM_SCHEMA.split(", ")])
        give_back()

    ident, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    read = docs.select(ident.alias("doc_id"), text.alias("text"), F.spark_partition_id().alias("part"), (F.pmod(F.xxhash64(ident, text), F.lit(FILLER_EVERY)) == 0).alias("fill"))
    return staged(read.mapInArrow(run, ITEM_SCHEMA), "tokenised")


def _part_starts(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """What the parts before each part hold, by keys: a table of parts x keys rows."""
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("part", *keys, F.coalesce(F.sum(value).over(before), F.lit(0)).alias("base"))


PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECE = [f.split(" ")[0] for f in PIECE_SCHEMA.split(", ")]


def _placed_items(items: DataFrame, slots: np.ndarray) -> DataFrame:
    """Items with their sequence and slot. slots: rows of (cls, first rank, items a sequence, first sequence), sorted."""
    shared = items.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        key = (s[:, 0] << 48) + s[:, 1]
        for b in batches:
            cls = b.column("cls").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            row = np.searchsorted(key, (cls << 48) + rank, "right") - 1
            step = rank - s[row, 1]
            sequence, slot = s[row, 3] + step // s[row, 2], (cls << 16) + step % s[row, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "doc_tokens", "item_length", "item_crc")), pa.array(sequence), pa.array(-slot)], ["doc_id", "doc_tokens", "item_length", "item_crc", "sequence_id", "slot"])

    return items.mapInArrow(run, "doc_id long, doc_tokens long, item_length long, item_crc long, sequence_id long, slot long")


def pack_documents(docs: DataFrame, model: str = MODEL_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and END_ID behind them; null and empty texts are that id alone. Each id lies in one
    piece, and the pieces of a sequence follow one another from offset 0 to at most CAPACITY. Rows that repeat a
    doc_id are packed as rows of their own, a null doc_id is kept, other columns are ignored, and an empty table
    gives no piece.
    """
    spark = docs.sparkSession
    ship_package(spark)
    items = _tokenised(docs, model, id_col, text_col)

    classed = items.filter("cls is not null").groupBy("part", "cls").agg(F.count("*").alias("n"))
    classed = staged(classed, "class-counts")
    # a row a class, at most CAPACITY / GRAIN of them
    histogram = sorted((r["cls"], r["n"]) for r in classed.groupBy("cls").agg(F.sum("n").alias("n")).collect())
    units, demand = np.array([c for c, _ in histogram], np.int64), np.array([n for _, n in histogram], np.int64)
    patterns, counts = round_patterns(units, demand, CAPACITY // GRAIN)
    n_packed = int(counts.sum())
    first_sequence = np.cumsum(counts) - counts
    rows, filled = [], np.zeros(len(units), np.int64)
    for p, n, at in zip(patterns, counts.tolist(), first_sequence.tolist(), strict=True):
        for c in np.flatnonzero(p).tolist():
            rows.append((int(units[c]), int(filled[c]), int(p[c]), at))
            filled[c] += n * p[c]
    slots = np.array(sorted(rows), np.int64).reshape(-1, 4)

    ranked = items.filter("cls is not null").join(_part_starts(classed, ["cls"], "n"), ["part", "cls"])
    ranked = ranked.select("doc_id", "doc_tokens", "item_length", "item_crc", "cls", (F.col("base") + F.col("cls_rank")).alias("rank"))
    together = Window.partitionBy("sequence_id")
    placed = _placed_items(ranked, slots)
    placed = placed.withColumn("offset", F.sum("item_length").over(together.orderBy("slot")) - F.col("item_length"))
    placed = staged(placed.withColumn("used", F.sum("item_length").over(together)), "placed-items")
    remainders = placed.select("doc_id", (F.col("doc_tokens") - F.col("item_length")).alias("start"), F.col("item_length").alias("length"), F.col("item_crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

    per_part = staged(
        items.groupBy("part").agg(F.sum(F.size("full_crcs")).alias("n_full"), F.coalesce(F.sum(F.when(F.col("fill_from").isNotNull(), F.col("doc_tokens"))), F.lit(0)).alias("n_fill")), "part-counts"
    )
    totals = per_part.agg(F.sum("n_full"), F.sum("n_fill")).first()
    n_full, n_fill = int(totals[0] or 0), int(totals[1] or 0)
    full = items.filter(F.size("full_crcs") > 0).join(_part_starts(per_part.withColumn("all", F.lit(0)), ["all"], "n_full"), "part")
    full = full.select("doc_id", "doc_tokens", "full_rank", "base", F.posexplode("full_crcs").alias("k", "ids_crc32"))
    full = full.select(
        "doc_id", (F.col("k").cast("long") * CAPACITY).alias("start"), F.lit(CAPACITY).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("base") + F.col("full_rank") + F.col("k") + n_packed).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )

    gaps = placed.filter(f"offset = 0 and used < {CAPACITY}").select("sequence_id", "used", (CAPACITY - F.col("used")).alias("gap"))
    runs = gaps.groupBy(F.floor(F.col("sequence_id") / RUN_BLOCK).alias("run")).agg(F.sum("gap").alias("n"))
    runs = staged(runs.select("run", "n", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("base")), "gap-runs")
    n_gap = int(runs.agg(F.sum("n")).first()[0] or 0)
    inside = Window.partitionBy("run").orderBy("sequence_id")
    gaps = gaps.withColumn("run", F.floor(F.col("sequence_id") / RUN_BLOCK)).withColumn("before", F.sum("gap").over(inside) - F.col("gap"))
    gaps = gaps.join(runs.select("run", "base"), "run").select("sequence_id", "used", "gap", (F.col("base") + F.col("before")).alias("at"))
    gaps = gaps.filter(F.col("at") < n_fill)
    blocks_of = F.sequence(F.floor(F.col("at") / STREAM_BLOCK), F.floor((F.col("at") + F.col("gap") - 1) / STREAM_BLOCK))
    gaps = gaps.withColumn("block", F.explode(blocks_of))
    filler = items.filter("fill_from is not null").join(_part_starts(per_part.withColumn("all", F.lit(0)), ["all"], "n_fill"), "part")
    filler = filler.select("doc_id", "doc_tokens", "ids", (F.col("base") + F.col("fill_from")).alias("at"))
    span = F.sequence(F.floor(F.col("at") / STREAM_BLOCK), F.floor((F.col("at") + F.col("doc_tokens") - 1) / STREAM_BLOCK))
    filler = filler.withColumn("block", F.explode(span)).withColumn("from", F.greatest(F.col("block") * STREAM_BLOCK - F.col("at"), F.lit(0)).cast("long"))
    filler = filler.withColumn("to", F.least((F.col("block") + 1) * STREAM_BLOCK - F.col("at"), F.col("doc_tokens")).cast("long"))
    filler = filler.select("block", "doc_id", "doc_tokens", "from", (F.col("at") + F.col("from")).alias("at"), F.expr("substring(ids, cast(4 * `from` + 1 as int), cast(4 * (`to` - `from`) as int))").alias("ids"))
    cuts = _stream_cuts(n_gap, n_fill, n_packed + n_full)

    def fill(stream: pd.DataFrame, room: pd.DataFrame) -> pd.DataFrame:
        return _fill_block(stream, room, cuts)

    poured = filler.groupBy("block").cogroup(gaps.groupBy("block")).applyInPandas(fill, PIECE_SCHEMA)
    return remainders.select(*PIECE).unionByName(full.select(*PIECE)).unionByName(poured)


def _stream_cuts(n_gap: int, n_fill: int, first: int) -> tuple[int, int, int, list[tuple[int, int, int]]]:
    """Where the stream goes behind the gaps: (from, to, first sequence) of whole sequences, then (from, to, sequence) of powers of two."""
    begin = min(n_gap, n_fill)
    whole = (n_fill - begin) // CAPACITY
    at, left, sequence, tail = begin + whole * CAPACITY, (n_fill - begin) % CAPACITY, first + whole, []
    for bit in range(CAPACITY.bit_length() - 1, -1, -1):
        if left >> bit & 1:
            tail.append((at, at + (1 << bit), sequence))
            at += 1 << bit
            sequence += 1
    return begin, begin + whole * CAPACITY, first, tail


def _fill_block(stream: pd.DataFrame, room: pd.DataFrame, cuts: tuple) -> pd.DataFrame:
    """Pieces of one block of the stream: every stretch that lies in one document and one gap or sequence."""
    begin, end, first, tail = cuts
    if not len(stream):
        return pd.DataFrame({c: pd.Series([], dtype="int64") for c in PIECE})
    stream = stream.sort_values("at")
    low, high = int(stream["at"].iloc[0]), int(stream["at"].iloc[-1] + len(stream["ids"].iloc[-1]) // 4)
    targets = [(int(a), int(a + g), int(s), int(u)) for a, g, s, u in room[["at", "gap", "sequence_id", "used"]].sort_values("at").itertuples(index=False)]
    k = max(0, low - begin) // CAPACITY
    while begin + k * CAPACITY < min(high, end):
        targets.append((begin + k * CAPACITY, begin + (k + 1) * CAPACITY, first + k, 0))
        k += 1
    targets += [(a, b, s, 0) for a, b, s in tail if a < high and b > low]
    out, t = [], 0
    for doc_id, doc_tokens, start, at, raw in stream[["doc_id", "doc_tokens", "from", "at", "ids"]].itertuples(index=False):
        ids = np.frombuffer(raw, "<u4")
        pos, stop = int(at), int(at) + len(ids)
        while pos < stop:
            while targets[t][1] <= pos:
                t += 1
            a, b, sequence, used = targets[t]
            n = min(b, stop) - pos
            i = pos - int(at)
            out.append((doc_id, int(start) + i, n, zlib.crc32(ids[i : i + n].tobytes()), doc_tokens, sequence, used + pos - a))
            pos += n
    done = pd.DataFrame(out, columns=PIECE)
    done["doc_id"] = done["doc_id"].astype("Int64")
    return done


def sequence_ids(docs: DataFrame, pieces: DataFrame, model: str = MODEL_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences themselves: sequence_id, length, ids (binary, little-endian unsigned 32-bit). Needs unique doc_ids."""
    ship_package(docs.sparkSession)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array([x + end for x in tokenizer(model).encode(block.column("text"))], pa.binary())], ["doc_id", "all_ids"])

    coded = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, all_ids binary")
    parts = pieces.join(coded, "doc_id").select("sequence_id", "offset", "length", F.expr("substring(all_ids, cast(4 * start + 1 as int), cast(4 * length as int))").alias("ids"))
    whole = parts.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return whole.select("sequence_id", "length", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
