"""Byte-level BPE by merge replay over the distinct pre-tokens of a block of documents.

The block's distinct pre-tokens form one linked list of byte symbols. An inverted index holds, for every adjacent
pair that has a rank, the positions where it stands; ranks are taken in ascending order, each merge is applied at
all its positions at once, and only the neighbours it touched are indexed anew. A pair that a merge creates always
gets a rank of its own; where that is lower than the present one, only that pair's words see it next, which is the
order in which a word-at-a-time encoder would merge.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.shipping import ship_package
from loomgraph.llm.words import slices

# White_Space, as the library's engine reads \s; spelled out since Python's engines differ over control characters.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
LOOSE_SPACE = regex.compile(f"[{WHITE}] | [{WHITE}]")
TIGHT_SPACE = regex.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")
RANKS_FILE = "byte_bpe_50k.tiktoken"
BLOCK_BYTES = 8 << 20
CACHE_WORDS = 400_000


class MergeTable:
    """Ranks of token pairs: pair (left id, right id) -> id of the joined token, which is also its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.size = len(self.tokens)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[t[:i]] * self.size + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs.sort()
        self.keys = np.array([p for p, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.joined = np.array([r for _, r in pairs] + [-1], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it is none."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.joined[at], -1)


def replay(words: list[bytes], table: MergeTable) -> list[np.ndarray]:
    """Token ids of every word; merges run over all words at once in rank order."""
    if not words:
        return []
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    symbol = table.byte[np.frombuffer(b"".join(words), np.uint8)].copy()
    n = len(symbol)
    word = np.repeat(np.arange(len(words)), lengths)
    follows = np.arange(1, n + 1)
    before = np.arange(-1, n - 1)
    ends = np.cumsum(lengths)
    ends = ends[lengths > 0]
    follows[ends - 1] = n
    before[np.concatenate(([0], ends[:-1]))] = -1
    follows = np.append(follows, n)
    # sentinel at n: no symbol, so every look-up beside a word's end finds no pair
    symbol = np.append(symbol, -1)
    alive = np.ones(n + 1, bool)

    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def note(positions: np.ndarray) -> None:
        """Index the pairs that begin at these positions."""
        positions = positions[follows[positions] < n]
        if not len(positions):
            return
        r = table.rank(symbol[positions], symbol[follows[positions]])
        known = r >= 0
        r, positions = r[known], positions[known]
        if not len(r):
            return
        order = np.argsort(r, kind="stable")
        r, positions = r[order], positions[order]
        cuts = np.flatnonzero(np.diff(r)) + 1
        starts = np.concatenate(([0], cuts))
        stops = np.append(cuts, len(r))
        for rank, a, b in zip(r[starts].tolist(), starts.tolist(), stops.tolist(), strict=True):
            if rank in index:
                index[rank].append(positions[a:b])
            else:
                index[rank] = [positions[a:b]]
                heapq.heappush(queue, rank)

    note(np.arange(n))
    while queue:
        rank = heapq.heappop(queue)
        at = index.pop(rank)
        at = np.unique(np.concatenate(at) if len(at) > 1 else at[0])
        at = at[alive[at]]
        right = follows[at]
        ok = right < n
        at, right = at[ok], right[ok]
        ok = table.rank(symbol[at], symbol[right]) == rank
        at, right = at[ok], right[ok]
        if not len(at):
            continue
        # of overlapping pairs (a a a) the leftmost goes first, then every other one along the run
        if symbol[at[0]] == symbol[right[0]]:
            chained = np.concatenate(([False], at[1:] == right[:-1]))
            place = np.arange(len(at))
            head = np.maximum.accumulate(np.where(chained, 0, place))
            take = (place - head) % 2 == 0
            at, right = at[take], right[take]
        after = follows[right]
        symbol[at] = rank
        follows[at] = after
        inner = after < n
        before[after[inner]] = at[inner]
        alive[right] = False
        left = before[at]
        left = left[left >= 0]
        note(np.concatenate((left, at)))
    keep = np.flatnonzero(alive[:n])
    counts = np.bincount(word[keep], minlength=len(words))
    return np.split(symbol[keep], np.cumsum(counts)[:-1])


class BlockEncoder:
    """Encodes and decodes texts block by block; ids are little-endian unsigned 32-bit integers in bytes.

    A text is cut at single spaces between two other characters, where no pre-token can straddle. Cut pieces and
    pre-tokens met before come from bounded caches; the new pre-tokens of a block go through one merge replay.
    """

    def __init__(self, path: str):
        self.table = MergeTable(path)
        self.pretokens: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        parts = [PIECES.findall(u) for u in units]
        new = list({t for p in parts for t in p}.difference(self.pretokens))
        for t, ids in zip(new, replay([t.encode("utf-8", "surrogatepass") for t in new], self.table), strict=True):
            self.pretokens[t] = ids.astype("<u4").tobytes()
        known = self.pretokens.__getitem__
        return {u: b"".join(map(known, p)) for u, p in zip(units, parts, strict=True)}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.pretokens) > CACHE_WORDS:
            self.pretokens.clear()
        if len(self.spaced) > CACHE_WORDS:
            self.spaced.clear()
        cut = [(TIGHT_SPACE.split(t) if LOOSE_SPACE.search(t) else t.split(" ")) if t else [] for t in texts]
        heads = self._learn(list({c[0] for c in cut if c}))
        new = list(set().union(*(c[1:] for c in cut)).difference(self.spaced))
        learnt = self._learn([" " + u for u in new])
        self.spaced.update((u[1:], ids) for u, ids in learnt.items())
        known = self.spaced.__getitem__
        return [heads[c[0]] + b"".join(map(known, c[1:])) if c else b"" for c in cut]

    def rest(self) -> None:
        """Between tasks a worker drops large caches, since other stages share its memory."""
        for cache in (self.pretokens, self.spaced):
            if len(cache) > CACHE_WORDS // 2:
                cache.clear()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[str, BlockEncoder] = {}


def encoder(path: str) -> BlockEncoder:
    """The encoder of a ranks file: a path, or the name of one of the installed public tokenizers. Kept by each worker."""
    if path not in _encoders:
        _encoders[path] = BlockEncoder(path if "/" in path else public_tokenizers.path(path))
    return _encoders[path]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for b in batches:
        texts = b.column("text")
        sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in texts], np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        for i, j in slices(bounds, BLOCK_BYTES):
            part = b.slice(i, j - i)
            yield part, part.column("text").to_pylist()


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode_documents(docs: DataFrame, ranks: str = RANKS_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit).

    Null and empty texts have no ids. Nothing is shuffled; rows may repeat and other columns are ignored.
    """

    def run(batches):
        for part, texts in _blocks(batches):
            ids = encoder(ranks).encode(texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return _input(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, ranks: str = RANKS_FILE) -> DataFrame:
    """The inverse of encode_documents: doc_id, text."""
    ship_package(encoded.sparkSession)

    def run(batches):
        for b in batches:
            texts = [encoder(ranks).decode(x or b"").decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, ranks: str = RANKS_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids, in one pass: doc_id, n_tokens and SHA-256 of the ids and of the decoded bytes."""

    def run(batches):
        for part, texts in _blocks(batches):
            e = encoder(ranks)
            ids = e.encode(texts)
            cols = [
                part.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(e.decode(x)).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _input(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
