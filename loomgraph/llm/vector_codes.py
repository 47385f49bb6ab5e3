"""Product codes of vectors: codebooks by k-means over columnar blocks, summed up a reduction tree.

Vectors are packed once into blocks that hold their components dimension by dimension. Each round is one
RDD.treeAggregate over the blocks: a task adds up distances one dimension at a time, assigns every part to its nearest
entry, and adds the parts into integer sum and count tensors; only those tensors (parts x entries x components) travel.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.memory import give_back
from loomgraph.llm.scratch import fresh, staged
from loomgraph.llm.shipping import ship_package

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK = 2048
# Whole components below this give squared distances of a vector that fit 63 bits; beyond it Python integers are used.
SAFE = 1 << 26
# Label sums up to this number of rows are broadcast; above it the same join is shuffled.
MOST_BROADCAST = 100_000


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as int64 where that is safe and as Python integers where it is not."""
    scaled = np.floor(np.ldexp(x.astype(np.float64), SCALE.bit_length() - 1))
    if not scaled.size or np.abs(scaled).max() < SAFE:
        return scaled.astype(np.int64)
    return np.frompyfunc(lambda v: math.floor(Fraction(v) * SCALE), 1, 1)(x.astype(np.float64).tolist()).astype(object)


def block_of(data: bytes, n: int, kind: str) -> np.ndarray:
    """The integer components of a block, one row a dimension."""
    return whole(np.frombuffer(data, kind).reshape(-1, n)) if n else np.zeros((0, 0), np.int64)


def nearest(block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of book (entries x components) to each column of block, ties to the lower, and its squared distance."""
    away = np.zeros((block.shape[1], len(book)), object if object in (block.dtype, book.dtype) else np.int64)
    for d in range(len(block)):
        gap = block[d][:, None] - book[None, :, d]
        away += gap * gap
    at = away.argmin(axis=1)
    return at, away[np.arange(len(at)), at]


def parted(block: np.ndarray, parts: int) -> np.ndarray:
    return block.reshape(parts, len(block) // parts, block.shape[1])


def _add(total: tuple | None, block: np.ndarray, books: np.ndarray) -> tuple:
    parts, entries, width = books.shape
    exact = object if object in (block.dtype, books.dtype) else np.int64
    if total is None:
        total = (np.zeros((parts, entries, width), exact), np.zeros((parts, entries), np.int64))
    sums, counts = total
    if exact is object and sums.dtype != object:
        sums = sums.astype(object)
    for p, piece in enumerate(parted(block, parts)):
        at, _ = nearest(piece, books[p])
        np.add.at(sums[p], at, piece.T)
        np.add.at(counts[p], at, 1)
    return sums, counts


def _merge(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return a if b is None else b
    return a[0] + b[0], a[1] + b[1]


def moved(books: np.ndarray, total: tuple | None) -> np.ndarray:
    """Each used entry becomes the floor of its parts' mean; unused ones stay."""
    if total is None:
        return books
    sums, counts = total
    used = counts > 0
    out = books.astype(object) if sums.dtype == object else books.copy()
    out[used] = sums[used] // counts[used][:, None]
    return out


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is there and has neither null nor non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.filter(F.col(vec_col).isNotNull() & ~F.exists(vec_col, bad))


def _blocks(kept: DataFrame, size: int, dims: int) -> DataFrame:
    """(ids, labels, n, data): up to `size` vectors a row, their components dimension by dimension."""
    kind = "<f4" if isinstance(kept.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, size):
                part = b.slice(i, size)
                flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(kind)
                if len(flat) != part.num_rows * dims or (np.diff(part.column("embedding").offsets.to_numpy()) != dims).any():
                    raise ValueError(f"every vector must have {dims} components, as that of the least vec_id has")
                data = np.ascontiguousarray(flat.reshape(part.num_rows, dims).T).tobytes()
                lists = [pa.ListArray.from_arrays([0, part.num_rows], part.column(c)) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([part.num_rows], pa.int32()), pa.array([data], pa.binary())], ["ids", "labels", "n", "data"])
        give_back()

    label = kept.schema["label"].dataType.simpleString()
    return kept.mapInArrow(pack, f"ids array<bigint>, labels array<{label}>, n int, data binary")


def fit_codebooks(blocks: DataFrame, books: np.ndarray, kind: str, rounds: int = ROUNDS) -> np.ndarray:
    """`rounds` of assignment and floored means over all blocks."""
    rdd = blocks.select("n", "data").rdd
    for _ in range(rounds):
        shared = rdd.context.broadcast(books)
        total = rdd.treeAggregate(None, lambda acc, r: _add(acc, block_of(bytes(r["data"]), r["n"], kind), shared.value), _merge, 2)  # noqa: B023
        books = moved(books, total)
        shared.destroy()
    return books


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK, most_broadcast: int = MOST_BROADCAST
) -> DataFrame:
    """One row per usable vector: vec_id, code, error, label_error, codebooks_sha256.

    Rows with a null vector or with null or non-finite components are left out; a null label is a group of its own.
    The first `entries` rows by vec_id (nulls last), then by vector, start the codebooks; with fewer rows there are
    fewer entries. Repeated rows are coded one by one and all count. Vectors must have one length, a multiple of
    `parts`, else the job fails with that message. Components of any size are exact; an error beyond a long is null.
    An empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    read = usable(vectors, vec_col).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"), F.col(label_col).alias("label"))
    seeds = read.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    label = read.schema["label"].dataType.simpleString()
    if not seeds:
        return read.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    dims = len(seeds[0]["embedding"])
    if dims % parts or any(len(r["embedding"]) != dims for r in seeds):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    kind = "<f4" if isinstance(read.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    start = whole(np.array([r["embedding"] for r in seeds], kind))
    books = np.ascontiguousarray(start.reshape(len(start), parts, dims // parts).transpose(1, 0, 2))
    blocks = staged(_blocks(read, block, dims), "blocks")
    books = fit_codebooks(blocks, books, kind, rounds)
    digest = codebooks_digest(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n = b.column("n")[i].as_py()
                found = [nearest(piece, books[p]) for p, piece in enumerate(parted(block_of(b.column("data")[i].as_py(), n, kind), parts))]
                codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                error = sum(d for _, d in found)
                error = pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64()) if error.dtype == object else pa.array(error)
                width = 2 * parts
                texts = pa.array([codes[k : k + width] for k in range(0, len(codes), width)], pa.string())
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, b.column("labels")[i].values, texts, error], ["vec_id", "label", "code", "error"])

    coded = staged(blocks.mapInArrow(code, f"vec_id bigint, label {label}, code string, error bigint"), "codes")
    key = fresh(["vec_id", "label", "code", "error"], "group")
    sums = coded.groupBy(F.col("label").alias(key)).agg(F.sum("error").alias("label_error"))
    if sums.count() <= most_broadcast:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col(key)), "left").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """The contract for vectors with distinct ids and components whose sums stay within a long."""
    near = """a{r} AS (SELECT vec_id, p, x, CAST(m % {n} AS BIGINT) AS e, CAST(m // {n} AS BIGINT) AS far FROM (
      SELECT vec_id, p, x, min(CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * {n} + e) AS m FROM d JOIN c{r} USING (p) GROUP BY ALL))"""
    move = """u{r} AS (SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(generate_series(1, max(len(x)))) AS i FROM d) GROUP BY ALL),
    c{next} AS (SELECT p, e, coalesce(l.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM u{r} GROUP BY 1, 2) l USING (p, e))"""
    rounds = ", ".join(f"{near.format(r=r, n=ENTRIES)}, {move.format(r=r, next=r + 1)}" for r in range(ROUNDS))
    return f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    d AS (SELECT vec_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM k, range({PARTS}) t(p)),
    c0 AS (SELECT p, e, x AS c FROM d JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)),
    {rounds}, {near.format(r=ROUNDS, n=ENTRIES)},
    h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM c{ROUNDS}),
    f AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY 1)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM f JOIN k USING (vec_id), h"""


ORACLE = _oracle()
