import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import packing
from loomgraph.llm.word_tokens import END_ID, MODEL_FILE

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
CAP = packing.CAPACITY


LIBRARY = Tokenizer.from_file(public_tokenizers.path(MODEL_FILE))


def ids_of(text):
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids + [END_ID], "<u4")


def check(pieces, docs):
    """docs: (doc_id, ids) with unique ids. Returns padding over tokens."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == {d for d, _ in docs}
    for d, ids in docs:
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= CAP
        padding += 0 if at & (at - 1) == 0 else CAP - at
    return padding / sum(len(i) for _, i in docs)


@pytest.mark.parametrize(("where", "most"), [(SMALL, 0.12), (MIDDLE, 0.01)])
def test_query(spark, where, most):
    docs = [(r.doc_id, ids_of(r.text)) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    pieces = packing.op3_packing(spark, where).collect()
    assert check(pieces, docs) <= most


def test_many_sizes_and_edges(spark):
    rng = np.random.default_rng(0)
    texts = ["cat " * int(n) for n in rng.integers(0, 5000, 300)] + [None, "", " ", "cat " * 2047, "cat " * 2048, "cat " * 4095, "dog " * 9000]
    df = spark.createDataFrame([(i, t, 1, b"x") for i, t in enumerate(texts)], "doc_id long, text string, part int, ids binary").repartition(5)
    pieces = packing.pack_documents(df)
    rows = pieces.collect()
    docs = [(i, ids_of(t)) for i, t in enumerate(texts)]
    assert check(rows, docs) < 0.03
    found = {r.sequence_id: r for r in packing.sequence_ids(df, pieces).collect()}
    by = {i: ids for i, ids in docs}
    parts = defaultdict(list)
    for p in sorted(rows, key=lambda p: p.offset):
        parts[p.sequence_id].append(by[p.doc_id][p.start : p.start + p.length])
    assert {s: np.concatenate(x).tobytes() for s, x in parts.items()} == {s: bytes(r.ids) for s, r in found.items()}


def test_null_and_repeated_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c"), (1, "c"), (2, None)], "doc_id long, text string")
    rows = packing.pack_documents(df).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("1", 2), ("1", 2), ("2", 1), ("None", 3), ("None", 3)]
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        units = np.unique(rng.integers(1, 9, 4))
        worth = rng.random(len(units))
        value, pattern = packing.best_pattern(worth, units, 13)
        best = np.zeros(14)
        for u in range(1, 14):
            best[u] = max([best[u - 1], *(worth[i] + best[u - k] for i, k in enumerate(units) if k <= u)])
        assert abs(value - best[13]) < 1e-9 and pattern @ units <= 13 and abs(pattern @ worth - value) < 1e-9


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(3)
    for n in (5, 40, 128):
        units = np.sort(rng.choice(np.arange(1, 129), n, replace=False))
        demand = rng.integers(1, 5000, n)
        patterns, counts = packing.round_patterns(units, demand, 128)
        assert np.array_equal(patterns.T @ counts, demand) and ((patterns @ units) <= 128).all()
        _, x = packing.column_generation(units, demand.astype(float), 128)
        assert x.sum() >= (units @ demand) / 128 - 1e-6
        assert counts.sum() <= x.sum() + len(units)
