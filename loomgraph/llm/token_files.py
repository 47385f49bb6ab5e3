"""Token files coded by a static range asymmetric numeral system.

A container holds whole documents in order. One frequency table, counted over the container's tokens, is shared by
all of its blocks. Every block is coded on its own by LANES interleaved states over one word stream, keeps the
states and the stream position at every checkpoint, and a checksum of its ids, so that blocks, and the stretches
between checkpoints, decode in parallel.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.memory import give_back
from loomgraph.llm.scratch import staged
from loomgraph.llm.shipping import ship_package
from loomgraph.llm.word_tokens import END_ID, MODEL_FILE, tokenizer
from loomgraph.llm.words import text_blocks

MAGIC = b"LGRANS01"
LANES = 32
STEPS = 1024
CHECK = 256
BLOCK = LANES * STEPS
STRETCHES = STEPS // CHECK
SCALE_BITS = 18
LOWER = np.uint64(1 << 31)
WORD = np.uint64(32)
CONTAINER_TOKENS = 2 << 20


def _scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2 ** SCALE_BITS, at least 1 for every symbol that occurs."""
    total = 1 << SCALE_BITS
    used = counts > 0
    freq = np.where(used, np.maximum(1, counts * (total - int(used.sum())) // counts.sum() + 1), 0)
    freq[np.argmax(freq)] += total - freq.sum()
    return freq


def encode_container(ids: np.ndarray) -> bytes:
    """Code one array of ids (of fewer than 2 ** SCALE_BITS distinct values)."""
    n = len(ids)
    if n == 0:
        return MAGIC + struct.pack("<QQI", 0, 0, 0)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int64)
    place[symbols] = np.arange(len(symbols))
    code, counts = place[ids], counts[symbols]
    blocks = -(-n // BLOCK)
    freq = _scaled(counts.astype(np.int64)).astype(np.uint64)
    cum = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
    padded = np.full(blocks * BLOCK, np.argmax(freq), np.int64)
    padded[:n] = code
    # step-major within a block: lane l of step t holds id t * LANES + l
    steps = padded.reshape(blocks, STEPS, LANES).transpose(1, 0, 2)
    limit = freq << np.uint64(63 - SCALE_BITS)
    state = np.full((blocks, LANES), LOWER, np.uint64)
    words = np.zeros((STEPS, blocks, LANES), np.uint32)
    sent = np.zeros((STEPS, blocks, LANES), bool)
    saved = np.zeros((blocks, STRETCHES, LANES), np.uint64)
    for t in range(STEPS - 1, -1, -1):
        s = steps[t]
        f = freq[s]
        full = state >= limit[s]
        words[t] = state
        sent[t] = full
        state = np.where(full, state >> WORD, state)
        q = state // f
        state = (q << np.uint64(SCALE_BITS)) + (state - q * f) + cum[s]
        if t % CHECK == 0:
            saved[:, t // CHECK] = state
    sent = sent.transpose(1, 0, 2)
    stream = words.transpose(1, 0, 2)[sent]
    per_stretch = sent.reshape(blocks, STRETCHES, CHECK * LANES).sum(2)
    flat = ids.astype("<u4")
    checks = np.array([zlib.crc32(flat[b * BLOCK : (b + 1) * BLOCK].tobytes()) for b in range(blocks)], "<u4")
    table = zlib.compress(np.concatenate((np.diff(symbols, prepend=0), freq.astype(np.int64))).astype("<u4").tobytes(), 6)
    head = struct.pack("<QQI", n, len(symbols), len(table))
    return b"".join((MAGIC, head, table, checks.tobytes(), per_stretch.astype("<u4").tobytes(), saved.astype("<u8").tobytes(), stream.astype("<u4").tobytes()))


def decode_container(raw: bytes) -> np.ndarray:
    """The ids of a container; a damaged one raises ValueError."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token container")
    n, n_symbols, table_bytes = struct.unpack_from("<QQI", raw, 8)
    if n == 0:
        return np.zeros(0, "<u4")
    at = 28
    table = np.frombuffer(zlib.decompress(raw[at : at + table_bytes]), "<u4").astype(np.int64)
    at += table_bytes
    symbols, freq = np.cumsum(table[:n_symbols]), table[n_symbols:].astype(np.uint64)
    cum = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
    slot_symbol = np.repeat(np.arange(n_symbols), freq.astype(np.int64))
    blocks = -(-n // BLOCK)

    def part(dtype, count):
        nonlocal at
        out = np.frombuffer(raw, dtype, count, at)
        at += out.nbytes
        return out

    checks, per_stretch, state = part("<u4", blocks), part("<u4", blocks * STRETCHES), part("<u8", blocks * STRETCHES * LANES).reshape(-1, LANES).copy()
    stream = np.append(part("<u4", (len(raw) - at) // 4), np.zeros(1, np.uint32)).astype(np.uint64)
    where = np.concatenate(([0], np.cumsum(per_stretch)[:-1])).astype(np.int64)
    out = np.zeros((blocks * STRETCHES, CHECK, LANES), np.int32)
    mask = np.uint64((1 << SCALE_BITS) - 1)
    for t in range(CHECK):
        slot = state & mask
        s = slot_symbol[slot.astype(np.int64)]
        out[:, t] = s
        state = freq[s] * (state >> np.uint64(SCALE_BITS)) + slot - cum[s]
        low = state < LOWER
        rank = np.cumsum(low, axis=1)
        take = np.minimum(where[:, None] + rank - 1, len(stream) - 1)
        state = np.where(low, (state << WORD) | stream[take], state)
        where = where + rank[:, -1]
    ids = symbols[out.reshape(-1)[:n]].astype("<u4")
    for b, want in enumerate(checks.tolist()):
        if zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].tobytes()) != want:
            raise ValueError(f"block {b} fails its checksum")
    return ids


FILE_SCHEMA = "part int, start_in_part long, n_docs long, n_tokens long, doc_ids binary, doc_nulls binary, doc_tokens binary, payload binary"


def write_token_files(docs: DataFrame, model: str = MODEL_FILE, id_col: str = "doc_id", text_col: str = "text", container_tokens: int = CONTAINER_TOKENS, folder: str | None = None) -> DataFrame:
    """Containers of all documents in ascending doc_id order, one row each, written as Parquet to `folder`.

    Without `folder` they go to the application's shared one, which ends with it.

    Each document is its text's ids and END_ID behind them; null and empty texts have that id alone. A null doc_id
    comes first, rows that repeat a doc_id stand together in the order of a hash of their text (so that any number of
    them spreads over several parts), other columns are ignored, and an
    empty table gives no container. A container closes at the first document end past `container_tokens`.
    """
    ship_package(docs.sparkSession)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, doc_ids, held, start = [], [], 0, 0
        number = 0

        def close() -> pa.RecordBatch:
            nonlocal parts, doc_ids, held, start
            lengths = np.array([len(x) // 4 for x in parts], "<u8")
            keys = np.array([d or 0 for d in doc_ids], "<i8")
            row = [number, start, len(parts), held, keys.tobytes(), bytes(d is None for d in doc_ids), lengths.tobytes(), encode_container(np.frombuffer(b"".join(parts), "<u4"))]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            start, parts, doc_ids, held = start + held, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], [f.split(" ")[0] for f in FILE_SCHEMA.split(", ")])

        for block in text_blocks(batches):
            number = block.column("part")[0].as_py()
            for d, ids in zip(block.column("doc_id").to_pylist(), tokenizer(model).encode(block.column("text")), strict=True):
                parts.append(ids + end)
                doc_ids.append(d)
                held += len(ids) // 4 + 1
                if held >= container_tokens:
                    yield close()
        if parts:
            yield close()
        give_back()

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = ["doc_id", "place", "seq"]
    placed = read.select("*", F.xxhash64("text").alias("place"), F.monotonically_increasing_id().alias("seq"))
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    return staged(ordered.mapInArrow(run, FILE_SCHEMA), "token-files", codec="uncompressed", folder=folder)


def read_token_files(files: DataFrame) -> DataFrame:
    """Decode containers: one row per document with doc_id, start, n_tokens, ids_crc32 and ids (binary)."""
    ship_package(files.sparkSession)
    # one total for each part of the writer: bounded by its number of partitions
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base, total = {}, 0
    for number, n in totals:
        base[number] = total
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = decode_container(r["payload"])
                raw = ids.tobytes()
                lengths = np.frombuffer(r["doc_tokens"], "<u8").astype(np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                docs = [raw[4 * i : 4 * j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                nulls = np.frombuffer(r["doc_nulls"], np.uint8).astype(bool)
                cols = [
                    pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=nulls),
                    pa.array(starts + base[r["part"]] + r["start_in_part"]),
                    pa.array(lengths),
                    pa.array([zlib.crc32(x) for x in docs], pa.int64()),
                    pa.array(docs, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_token_files(files).drop("ids")
