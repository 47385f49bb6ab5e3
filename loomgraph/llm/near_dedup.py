"""Near-duplicate components by min-max hashing, with every link confirmed on full shingle sets.

Each of PERMUTATIONS hash functions is evaluated once a shingle and gives two signature values, its minimum and its
maximum. Bands of ROWS values put documents into buckets. Documents with equal sets are one class from the start.

Candidate pairs of a bucket are not all emitted. Its least member is a pivot: every member is compared with the
pivot, and links so found are joined to components. What is left are pairs of members in different components: those
outside a bucket's largest component against its others. A parity bitmap of each set bounds the symmetric difference
of two sets from below, so pairs that cannot be linked are left out inside the join, without error; the others leave
the join once, whatever the number of buckets they share, and are compared as well. No candidate link is lost, and
copies of one text cost one comparison each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.components import connected_components, hot_join
from loomgraph.llm.exact_dedup import text_digest
from loomgraph.llm.memory import give_back
from loomgraph.llm.scratch import staged
from loomgraph.llm.shipping import ship_package
from loomgraph.llm.words import FOLD, Words, mix, rolling, texts_of, word_runs

SHINGLE = 2
PERCENT = 80
PERMUTATIONS = 120
ROWS = 6
BANDS = 2 * PERMUTATIONS // ROWS
BITS = 1024
_rng = np.random.default_rng(20_240_229)
MULTIPLIERS = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64) << np.uint64(1) | np.uint64(1)
FLIPS = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64)


def shingle_sets(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents, sorted within each, and the bounds of each document's part."""
    h, owner = w.hashes(), w.owner
    full = np.flatnonzero(owner[: max(len(owner) - width + 1, 0)] == owner[width - 1 :]) if len(owner) >= width else np.zeros(0, np.int64)
    values, own = rolling(h, width)[full], owner[full]
    counts = w.counts
    for d in np.flatnonzero((counts > 0) & (counts < width)).tolist():
        whole = h[w.first[d] : w.first[d + 1]]
        values = np.append(values, rolling(whole, len(whole)) + np.uint64(len(whole)))
        own = np.append(own, d)
    order = np.lexsort((values, own))
    values, own = values[order], own[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (own[1:] != own[:-1])
    values, own = values[fresh], own[fresh]
    return values, np.searchsorted(own, np.arange(w.n_docs + 1))


def band_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """BANDS bucket keys for each non-empty document."""
    some = np.flatnonzero(np.diff(bounds))
    first = bounds[some]
    signature = np.empty((2 * PERMUTATIONS, len(some)), np.uint64)
    for p in range(PERMUTATIONS):
        v = (values ^ FLIPS[p]) * MULTIPLIERS[p]
        v ^= v >> np.uint64(29)
        signature[p] = np.minimum.reduceat(v, first)
        signature[PERMUTATIONS + p] = np.maximum.reduceat(v, first)
    keys = np.empty((len(some), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(some), b + 1, np.uint64)
        for r in range(ROWS):
            key = mix(key ^ signature[b * ROWS + r])
        keys[:, b] = key
    return keys


def bitmaps(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of BITS hash classes, as BITS / 64 integers a document."""
    n = len(bounds) - 1
    own = np.repeat(np.arange(n), np.diff(bounds))
    place = (mix(values + np.uint64(11)) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    parity = np.bincount(own * BITS + place, minlength=n * BITS).reshape(n, BITS) & 1
    return np.packbits(parity.astype(np.uint8), axis=1).view(np.int64)


SKETCH_SCHEMA = "seq long, doc_id long, n_shingles long, digest binary, keys array<long>, bits array<long>, packed binary"


def _sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for b in batches:
        column = b.column("text")
        data, bounds = texts_of(column)
        for i, j, w in word_runs(column, fold=True):
            values, cuts = shingle_sets(w, width)
            sizes = np.diff(cuts)
            digests = [hashlib.blake2b(values[x:y].tobytes(), digest_size=16).digest() if y > x else None for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            keys = band_keys(values, cuts).view(np.int64).reshape(-1)
            offsets = np.concatenate(([0], np.cumsum((sizes > 0) * BANDS))).astype(np.int32)
            maps = bitmaps(values, cuts)
            map_ends = pa.array(np.arange(j - i + 1, dtype=np.int32) * maps.shape[1])
            packed = [press.compress(data[x:y].tobytes()) if n else None for x, y, n in zip(bounds[i:j].tolist(), bounds[i + 1 : j + 1].tolist(), sizes.tolist(), strict=True)]
            cols = [b.column("seq").slice(i, j - i), b.column("doc_id").slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys)), pa.ListArray.from_arrays(map_ends, pa.array(maps.reshape(-1))), pa.array(packed, pa.binary())]
            more = b.schema.names[3:]
            yield pa.RecordBatch.from_arrays(cols + [b.column(n).slice(i, j - i) for n in more], [*(f.split(" ")[0] for f in SKETCH_SCHEMA.split(", ")), *more])
    give_back()


def overlaps(left: list[bytes], right: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of intersection and union of the shingle sets of paired packed texts."""
    open_ = zstandard.ZstdDecompressor()
    keys, pair, size = [], [], np.zeros(len(left), np.int64)
    for side in (left, right):
        last, raw = None, []
        for x in side:
            if x is not last:
                text = open_.decompress(x)
                last = x
            raw.append(text)
        data = FOLD[np.frombuffer(b"".join(raw), np.uint8)]
        values, cuts = shingle_sets(Words(data, np.concatenate(([0], np.cumsum([len(t) for t in raw])))), width)
        own = np.repeat(np.arange(len(left)), np.diff(cuts))
        keys.append(mix(values ^ mix(own.astype(np.uint64) + np.uint64(3))))
        pair.append(own)
        size += np.diff(cuts)
    key, own = np.concatenate(keys), np.concatenate(pair)
    order = np.argsort(key)
    twice = own[order[1:]][key[order[1:]] == key[order[:-1]]]
    both = np.bincount(twice, minlength=len(left))
    return both, size - both


def _compare(batches: Iterator[pa.RecordBatch], width: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    for b in batches:
        left, right = b.column("left").to_pylist(), b.column("right").to_pylist()
        i = 0
        while i < len(left):
            j, held = i, 0
            while j < len(left) and (j == i or held < most):
                held += 3 * (len(left[j]) + len(right[j]))
                j += 1
            both, union = overlaps(left[i:j], right[i:j], width)
            yield pa.RecordBatch.from_arrays([b.column("a").slice(i, j - i), b.column("b").slice(i, j - i), pa.array(both, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "both", "whole"])
            i = j
    give_back()


def confirm(pairs: DataFrame, sketch: DataFrame, width: int, label: str) -> DataFrame:
    """pairs(a, b) with the sizes of intersection (both) and union (whole) of their full sets."""
    packed = sketch.select("seq", "packed")
    joined = pairs.join(packed.select(F.col("seq").alias("b"), F.col("packed").alias("right")), "b").join(packed.select(F.col("seq").alias("a"), F.col("packed").alias("left")), "a")
    return staged(joined.select("a", "b", "left", "right").mapInArrow(lambda x: _compare(x, width), "a long, b long, both long, whole long"), label)


def _may_link(x: str, y: str, percent: int):
    """False only for sets (size, bits) that cannot reach the similarity: by their sizes, or by their bitmaps' distance."""
    sizes = f"100 * least({x}.size, {y}.size) >= {percent} * greatest({x}.size, {y}.size)"
    apart = f"aggregate(zip_with({x}.bits, {y}.bits, (p, q) -> bit_count(p ^ q)), 0, (s, n) -> s + n)"
    return F.expr(f"{sizes} and {apart} * {100 + percent} <= ({x}.size + {y}.size) * {100 - percent}")


def _apart(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members in different components that may be linked: mixed(key, node, component, main, held).

    Of a bucket only members outside its main component meet the others, each pair in one order. Two members that share
    several buckets pass in the one of the least key only.
    """
    o, m = mixed.filter("component <> main").alias("o"), mixed.alias("m")
    once = F.expr("o.component <> m.component and (m.component = m.main or o.node < m.node)")
    least = F.expr("o.key = array_min(array_intersect(o.held.keys, m.held.keys))")
    met = o.join(m, (F.col("o.key") == F.col("m.key")) & once & _may_link("o.held", "m.held", percent) & least)
    return met.select(F.least("o.node", "m.node").alias("a"), F.greatest("o.node", "m.node").alias("b"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT, keyed: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept; keyed adds text_sha256, which rows_of needs.

    A-Z are lower-cased; a set holds the distinct `width`-word shingles, the whole sequence of a shorter text, and
    nothing for null, empty or blank text, which is linked with nothing and its own component. Documents are linked
    when 100 * intersection >= percent * union; component_id is the smallest doc_id of the component. Rows that
    repeat a doc_id are rows of their own with one kept flag; a null doc_id never gives a component its id unless
    all are null. Other columns are ignored and an empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    read = docs.select(F.monotonically_increasing_id().alias("seq"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    key = ["text_sha256"] if keyed else []
    if keyed:
        read = read.withColumn("text_sha256", text_digest(F.col("text")))
    sketch = staged(read.mapInArrow(lambda x: _sketch(x, width), SKETCH_SCHEMA + "".join(f", {k} string" for k in key)), "sketch")
    classes = staged(sketch.filter("n_shingles > 0").groupBy("digest").agg(F.min("seq").alias("node"), F.min("doc_id").alias("least_doc"), F.count("*").alias("n")), "classes")
    bands = sketch.select(F.col("seq").alias("node"), "keys").join(classes.select("node"), "node").select("node", F.explode("keys").alias("key"))
    pivots = bands.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1").select("key", "pivot")
    members = staged(bands.join(pivots, "key"), "members")
    sets = sketch.select("seq", F.col("n_shingles").alias("size"), "bits", "keys")

    def with_set(df: DataFrame, node: str, name: str, *more: str) -> DataFrame:
        return df.join(sets.select(F.col("seq").alias(node), F.struct("size", "bits", *more).alias(name)), node)

    pivot_pairs = members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    pivot_pairs = with_set(with_set(pivot_pairs, "b", "y"), "a", "x").filter(_may_link("x", "y", percent)).select("a", "b")
    linked = F.expr(f"100 * both >= {percent} * whole")
    links = confirm(pivot_pairs, sketch, width, "pivot-pairs").filter(linked).select("a", "b")
    found = connected_components(links)

    placed = members.join(found, "node", "left").select("key", "node", "pivot", F.coalesce("component", "node").alias("component"))
    counted = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    spread = counted.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("kinds")).filter("kinds > 1").select("key", "main")
    mixed = staged(with_set(placed.filter("node <> pivot").join(spread, "key"), "node", "held", "keys").select("key", "node", "component", "main", "held"), "mixed")
    cross = _apart(mixed, percent).distinct()
    more = confirm(cross, sketch, width, "cross-pairs").filter(linked).select("a", "b")
    if not more.isEmpty():
        # components found so far are stars, which the new links join
        found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    named = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = staged(named.select("digest", "least_doc", "component", F.col("n").alias("copies")), "named")
    smallest = named.groupBy("component").agg(F.min("least_doc").alias("component_id"), F.count("*").alias("n"))
    sizes = named.agg(F.count("*"), F.sum("copies")).first()
    by_digest = hot_join(named, smallest, "component", sizes[0]).select("digest", "component_id", F.col("copies").alias("n"))
    rows = sketch.select("doc_id", "n_shingles", "digest", *key)
    linked_rows = hot_join(rows.filter("n_shingles > 0"), staged(by_digest, "by-digest"), "digest", sizes[1] or 0)
    alone = rows.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    result = linked_rows.unionByName(alone)
    return result.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *key)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
