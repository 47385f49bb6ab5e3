"""Substring deduplication by super-k-mer partitioning of word windows.

A window is WINDOW consecutive words of one text. Its minimiser is the least hash among its runs of MINIMISER words,
and consecutive windows with one minimiser travel as one packed string (a super-k-mer) to that minimiser's bucket,
so every copy of a window reaches the same bucket. There windows are sorted by hash, equal ones are verified by the
64-bit hashes of all their words, and each learns the smallest doc_id that holds it.

Skew: a task sends the text of a super-k-mer once, whatever the order of its documents. A document with a larger doc_id
than another holder's in the task is decided on the spot; a smaller one sends its own row without the text, and the bucket
joins rows and texts by digest, so copies collapse before the shuffle and again in the bucket. Word runs that a sample
shows to be very frequent (a bounded list, used only to balance buckets) come last in the minimiser order, so the windows
around a common passage spread by their context.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from loomgraph.llm.memory import give_back
from loomgraph.llm.scratch import staged
from loomgraph.llm.shipping import ship_package
from loomgraph.llm.words import BASE, BASE_INVERSE, Words, ids_of, mix, powers, rolling, word_runs

WINDOW = 50
MINIMISER = 8
SAMPLE_RATE = 128
FLUSH_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20
EXPANSION = 6
SEEN_MOST = 250_000
DIGEST = 16
ROW_BYTES = 200
OUT_ROWS = 500
LAST = np.iinfo(np.int64).max


def window_minima(h: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Least rank among the MINIMISER-word runs of each WINDOW consecutive words; frequent runs rank last."""
    runs = rolling(h, MINIMISER)
    rank = runs >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, runs), len(frequent) - 1)
        rank = rank | ((frequent[at] == runs).astype(np.uint64) << np.uint64(63))
    want, span = WINDOW - MINIMISER + 1, 1
    while span * 2 <= want:
        rank = np.minimum(rank[:-span], rank[span:])
        span *= 2
    return np.minimum(rank[: len(rank) - (want - span)], rank[want - span :]) if want > span else rank


class Packed:
    """Words of a run of documents laid out with one space between them, so that a stretch of words is a slice."""

    def __init__(self, w: Words):
        sizes = w.end - w.start
        self.start = np.cumsum(sizes + 1) - (sizes + 1)
        self.end = self.start + sizes
        self.data = np.full(int(sizes.sum() + len(sizes)), 32, np.uint8)
        solid = np.zeros(len(w.data) + 1, np.int8)
        solid[w.start] += 1
        solid[w.end] -= 1
        inside = np.cumsum(solid[:-1]).astype(bool)
        self.data[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = w.data[inside]
        self.raw = self.data.tobytes()


def super_kmers(w: Words, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser rank of each super-k-mer of a run of documents."""
    none = np.zeros(0, np.int64)
    owner = w.owner
    if len(owner) < WINDOW:
        return none, none, none.astype(np.uint64)
    at = np.flatnonzero(owner[: len(owner) - WINDOW + 1] == owner[WINDOW - 1 :])
    if not len(at):
        return none, none, none.astype(np.uint64)
    least = window_minima(w.hashes(), frequent)[at]
    opens = np.ones(len(at), bool)
    opens[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(opens)
    return at[heads], np.diff(np.append(heads, len(at))), least[heads]


BLOB_SCHEMA = "bucket long, kind int, blob binary"
RANGE_SCHEMA = "doc_id long, row_key long, start int, n_windows int"


class _Sender:
    """Collects super-k-mers by bucket and packs them into compressed blobs."""

    def __init__(self, n_buckets: int, frequent: np.ndarray):
        self.n_buckets, self.frequent = n_buckets, frequent
        self.seen: dict[bytes, int] = {}
        self.rows: set[int] = set()
        self.press = zstandard.ZstdCompressor(level=3)
        self.reset()

    def reset(self) -> None:
        self.held: dict[int, dict[bytes, tuple[bytes | None, list]]] = {}
        self.decided: list[tuple] = []
        self.bytes = 0

    def _new(self, key: np.ndarray) -> np.ndarray:
        """False for rows whose doc_id and text this task has had before: their ranges are the same."""
        if len(self.rows) > SEEN_MOST:
            self.rows.clear()
        out = np.ones(len(key), bool)
        for i, k in enumerate(key.tolist()):
            out[i] = k not in self.rows
            self.rows.add(k)
        return out

    def add(self, w: Words, doc: np.ndarray, key: np.ndarray) -> None:
        first, count, rank = super_kmers(w, self.frequent)
        if not len(first):
            return
        new = self._new(key)
        if not new.all():
            own = new[w.owner[first]]
            first, count, rank = first[own], count[own], rank[own]
        pack = Packed(w)
        owner = w.owner[first]
        place = first - w.first[owner]
        bucket = (mix(rank) % np.uint64(self.n_buckets)).astype(np.int64)
        last = first + count + WINDOW - 2
        rows = zip(pack.start[first].tolist(), pack.end[last].tolist(), bucket.tolist(), doc[owner].tolist(), key[owner].tolist(), place.tolist(), count.tolist(), strict=True)
        seen, raw = self.seen, pack.raw
        for a, b, to, d, k, p, n in rows:
            s = raw[a:b]
            digest = hashlib.blake2b(s, digest_size=DIGEST).digest()
            before = seen.get(digest)
            if before is not None and before < d:
                self.decided.append((d, k, p, n))
                self.bytes += ROW_BYTES
                continue
            seen[digest] = d
            groups = self.held.setdefault(to, {})
            held = groups.get(digest)
            if held is None:
                groups[digest] = (s if before is None else None, [(d, k, p, n)])
                self.bytes += ROW_BYTES + (b - a if before is None else 0)
            elif before is not None and d < before:
                # those of a larger doc_id need not be sent: their windows start in d as well
                self.decided += [r for r in held[1] if r[0] > d]
                held[1][:] = [r for r in held[1] if r[0] <= d] + [(d, k, p, n)]
                self.bytes += ROW_BYTES
            else:
                held[1].append((d, k, p, n))
                self.bytes += ROW_BYTES
        if len(seen) > SEEN_MOST:
            seen.clear()

    def flush(self) -> Iterator[pa.RecordBatch]:
        buckets, kinds, blobs = [], [], []
        for to, groups in self.held.items():
            texts = [t for t, _ in groups.values() if t is not None]
            sizes = np.array([-1 if t is None else len(t) for t, _ in groups.values()], "<i8")
            shares = np.array([len(r) for _, r in groups.values()], "<i8")
            table = np.array([r for _, rows in groups.values() for r in rows], "<i8")
            # the bucket digests the texts it gets itself; a digest stands only for a text sent before
            absent = [g for g, (t, _) in groups.items() if t is None]
            head = struct.pack("<QQ", len(groups), len(table))
            blobs.append(self.press.compress(head + sizes.tobytes() + shares.tobytes() + table.tobytes() + b"".join(absent) + b" ".join(texts)))
            buckets.append(to)
            kinds.append(0)
        if self.decided:
            blobs.append(np.array(self.decided, "<i8").tobytes())
            buckets.append(int(self.decided[0][1]) % self.n_buckets)
            kinds.append(1)
        if blobs:
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])
        self.reset()


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different texts of a bucket and their bounds; its rows (doc_id, row_key, first word, windows) and the text of each."""
    open_ = zstandard.ZstdDecompressor()
    place: dict[bytes, int] = {}
    texts: dict[int, bytes] = {}
    tables, whose = [], []
    for b in blobs:
        raw = open_.decompress(b)
        n, rows = struct.unpack_from("<QQ", raw)
        sizes = np.frombuffer(raw, "<i8", n, 16)
        shares = np.frombuffer(raw, "<i8", n, 16 + 8 * n)
        tables.append(np.frombuffer(raw, "<i8", 4 * rows, 16 + 16 * n).reshape(rows, 4))
        mark = 16 + 16 * n + 32 * rows
        at = mark + DIGEST * int((sizes < 0).sum())
        mine = []
        for size in sizes.tolist():
            if size < 0:
                digest, mark = raw[mark : mark + DIGEST], mark + DIGEST
            else:
                text, at = raw[at : at + size], at + size + 1
                digest = hashlib.blake2b(text, digest_size=DIGEST).digest()
            i = place.setdefault(digest, len(place))
            if size >= 0:
                texts.setdefault(i, text)
            mine.append(i)
        whose.append(np.repeat(np.array(mine, np.int64), shares))
    ordered = [texts[i] for i in range(len(place))]
    bounds = np.concatenate(([0], np.cumsum(np.array([len(t) for t in ordered], np.int64) + 1)))
    bounds[-1] -= 1
    return np.frombuffer(b" ".join(ordered), np.uint8), bounds, np.concatenate(tables), np.concatenate(whose)


def first_holders(h: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For the windows of words h that start at `at` (ascending): the smallest doc among equal windows.

    Windows are grouped by sorting a hash of their words; each is then compared with its group's leader, word hash by
    word hash where a run of matches begins and by its last word where the run goes on. Groups that a hash collision
    joined are regrouped by their words.
    """
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(BASE, len(h)), out=total[1:])
    key = (total[at + WINDOW] - total[at]) * powers(BASE_INVERSE, len(h))[at]
    order = np.argsort(key, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], key[order[1:]] != key[order[:-1]])))
    group = np.empty(len(at), np.int64)
    group[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(at))))
    leader = order[heads][group]
    follows = np.zeros(len(at), bool)
    follows[1:] = (leader[1:] == leader[:-1] + 1) & (at[1:] == at[:-1] + 1) & (at[leader[1:]] == at[leader[:-1]] + 1)
    differs = h[at + WINDOW - 1] != h[at[leader] + WINDOW - 1]
    begin = np.flatnonzero(~follows & (leader != np.arange(len(at))))
    for k in range(WINDOW - 1):
        differs[begin] |= h[at[begin] + k] != h[at[leader[begin]] + k]
    if differs.any():
        # what follows a failed match is unproven as well
        for k in range(WINDOW):
            differs |= h[at + k] != h[at[leader] + k]
        for g in np.unique(group[np.flatnonzero(differs)]):
            by: dict[bytes, int] = {}
            for i in np.flatnonzero(group == g):
                group[i] = by.setdefault(h[at[i] : at[i] + WINDOW].tobytes(), len(at) + len(heads) + i)
        _, group = np.unique(group, return_inverse=True)
    least = np.full(int(group.max()) + 1, LAST, np.int64)
    np.minimum.at(least, group, doc)
    return least[group]


def _judge(blobs: list[bytes]) -> np.ndarray:
    """Ranges of removed windows of one bucket: rows of (doc_id, row_key, first word, windows).

    A text is judged once, for the smallest doc_id that holds it; in its other holders all its windows go.
    """
    data, bounds, table, whose = _unpack(blobs)
    w = Words(data, bounds)
    doc = table[:, 0]
    least = np.full(len(bounds) - 1, LAST, np.int64)
    np.minimum.at(least, whose, doc)
    n = np.zeros(len(least), np.int64)
    n[whose] = table[:, 3]
    at = np.repeat(w.first[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    item = np.repeat(np.arange(len(n)), n)
    later = doc > least[whose]
    out = [table[later]]
    gone = np.flatnonzero(first_holders(w.hashes(), at, least[item]) < least[item])
    if len(gone):
        opens = np.ones(len(gone), bool)
        opens[1:] = (gone[1:] != gone[:-1] + 1) | (item[gone[1:]] != item[gone[:-1]])
        heads = np.flatnonzero(opens)
        lead, sizes = gone[heads], np.diff(np.append(heads, len(gone)))
        start, text = at[lead] - w.first[item[lead]], item[lead]
        # runs of a text, for each row that holds it with the smallest doc_id
        rows = np.flatnonzero(~later)
        low = np.searchsorted(text, whose[rows])
        many = np.searchsorted(text, whose[rows], side="right") - low
        row = np.repeat(rows, many)
        run = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        found = table[row].copy()
        found[:, 2] += start[run]
        found[:, 3] = sizes[run]
        out.append(found)
    return np.concatenate(out)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ident = F.col(id_col).cast("long")
    return docs.select(ident.alias("doc_id"), F.xxhash64(ident, text).alias("row_key"), text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest"))


def _size(df: DataFrame) -> int:
    """Spark's own estimate of a plan's input in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def frequent_runs(keyed: DataFrame, n_buckets: int) -> np.ndarray:
    """Word runs that hold over 1 / (16 n_buckets) of the sampled ones, so at most 16 n_buckets of them.

    Only the balance of the buckets depends on this sample, never a result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, w in word_runs(b.column("text")):
                if len(w.start) < MINIMISER:
                    continue
                runs, n = np.unique(rolling(w.hashes(), MINIMISER), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(runs.view(np.int64)), pa.array(n, pa.int64())], ["run", "n"])

    sample = keyed.filter(F.pmod(F.col("row_key"), F.lit(SAMPLE_RATE)) == 0).select("text")
    counts = sample.mapInArrow(run, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).filter("n > 3")
    counts = staged(counts, "frequent-runs")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") > max(8.0, total / (16 * n_buckets))).select("run").toPandas()["run"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def duplicate_ranges(keyed: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """Runs of windows that also start in a document with a smaller doc_id: RANGE_SCHEMA, in words of the text."""
    spark = keyed.sparkSession
    ship_package(spark)
    buckets = n_buckets or max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(_size(keyed) * EXPANSION / BUCKET_BYTES))
    buckets = min(buckets, 1 << 31)
    frequent = spark.sparkContext.broadcast(frequent_runs(keyed, buckets))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sender(buckets, frequent.value)
        for b in batches:
            doc, key = ids_of(b.column("doc_id")), b.column("row_key").to_numpy(zero_copy_only=False)
            for i, j, w in word_runs(b.column("text")):
                out.add(w, doc[i:j], key[i:j])
                if out.bytes > FLUSH_BYTES:
                    yield from out.flush()
        yield from out.flush()
        del out
        give_back()

    def judge(table: pa.Table) -> pa.Table:
        blobs: dict[int, list[bytes]] = {0: [], 1: []}
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
            blobs[kind].append(blob)
        rows = [np.frombuffer(b, "<i8").reshape(-1, 4) for b in blobs[1]]
        if blobs[0]:
            rows.append(_judge(blobs[0]))
        r = np.concatenate(rows)
        doc = pa.array(r[:, 0], mask=r[:, 0] == LAST)
        return pa.Table.from_arrays([doc, pa.array(r[:, 1]), pa.array(r[:, 2], pa.int32()), pa.array(r[:, 3], pa.int32())], [f.split(" ")[0] for f in RANGE_SCHEMA.split(", ")])

    return keyed.mapInArrow(send, BLOB_SCHEMA).groupBy("bucket").applyInArrow(judge, RANGE_SCHEMA)


OUT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, n_buckets: int | None = None, verbatim: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and, with_text, kept_text.

    Every word that lies in a window which also starts in a document with a smaller doc_id is removed; windows are
    judged on the input. Null and empty texts have no words, texts below WINDOW words lose none, rows that share a
    doc_id do not remove each other's words, and a null doc_id ranks after every other. Other columns are ignored
    and an empty table gives an empty result. verbatim: texts that lose nothing keep their white space, and the
    struct `rest` carries the row's other columns.
    """
    keyed = _keyed(docs, id_col, text_col)
    schema = StructType([*_parse_datatype_string(OUT_SCHEMA).fields, *([keyed.schema["rest"]] if verbatim else [])])
    carried = ["rest"] if verbatim else []
    key = [F.coalesce(F.col("doc_id"), F.lit(int(LAST))).alias("k"), "row_key"]
    # rows that repeat a doc_id and a text give the same ranges: one list for all of them, no longer than the text
    ranges = duplicate_ranges(keyed.drop("rest"), n_buckets).groupBy(*key, "start").agg(F.max("n_windows").alias("n_windows"))
    ranges = ranges.groupBy("k", "row_key").agg(F.collect_list(F.struct("start", "n_windows")).alias("r"))
    ranges = ranges.select("k", "row_key", F.col("r").getField("start").alias("starts"), F.col("r").getField("n_windows").alias("counts"))
    joined = keyed.select(*key, "doc_id", "text", *carried).join(ranges, ["k", "row_key"], "left").select("doc_id", "text", "starts", "counts", *carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, OUT_ROWS) for whole in batches for i in range(0, max(len(whole), 1), OUT_ROWS)):
            out = []
            for text, starts, counts in zip(b.column("text"), b.column("starts").to_pylist(), b.column("counts").to_pylist(), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                kept = words
                if starts:
                    cover = np.zeros(len(words) + 1, np.int32)
                    first = np.array(starts)
                    np.add.at(cover, first, 1)
                    np.add.at(cover, np.minimum(first + np.array(counts) + WINDOW - 1, len(words)), -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
                raw = b" ".join(kept)
                shown = text.as_py() if verbatim and len(kept) == len(words) else raw.decode() if with_text else None
                out.append((len(words), len(words) - len(kept), hashlib.sha256(raw).hexdigest(), shown))
            n, gone, sha, kept_text = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.string()), *(b.column(c) for c in carried)], schema.names
            )

    result = joined.mapInArrow(run, schema)
    return result if with_text else result.drop("kept_text")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows of docs, all columns, with repeated windows taken out of their text; a text that loses none is unchanged.

    length_col, if given and present, becomes the number of characters of a text that lost some.
    """
    kept = remove_repeats(docs, id_col, text_col, verbatim=True)

    def shown(c: str):
        own = F.col(f"rest.`{c}`")
        return F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema[c].dataType)).otherwise(own) if c == length_col else own

    return kept.select(*[(F.col("kept_text") if c == text_col else shown(c)).alias(c) for c in docs.columns])


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
