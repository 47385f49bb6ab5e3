import random
import re

import numpy as np
import pytest

from loomgraph.llm import components
from loomgraph.llm import near_dedup as nd
from loomgraph.llm.components import connected_components
from loomgraph.llm.scratch import staged

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_components(df).collect()), key=repr)


def near_rows(seed):
    rng = random.Random(seed)
    rows, ids = [], rng.sample(range(10_000), 160)
    bases = [[f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 10, 40, 90]))] for _ in range(12)]
    for d in ids:
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8, 14])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        rows.append((d, " ".join(w).upper() if rng.random() < 0.2 else "\n".join(w)))
    return rows + [(20_000, None), (20_001, ""), (20_002, " \n"), (20_003, "one"), (20_004, "ONE"), (20_005, "one one"), (None, "one"), (rows[0][0], rows[0][1]), (20_006, "z " * 4000), (20_007, "z z")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = near_rows(seed)
    df = spark.createDataFrame([(d, t, "k", 0) for d, t in rows], "doc_id long, text string, key string, node int")
    assert got(df) == brute(rows)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, nd.op5_near_dedup(spark, SMALL).collect()), key=repr) == brute(rows)


def test_members_apart_meet_once_whatever_buckets_they_share(spark):
    held = (10, [0] * 16, [1, 2, 3])
    rows = [(k, node, component, 5, held) for k in (1, 2, 3) for node, component in ((5, 5), (6, 5), (7, 7), (8, 8))]
    mixed = spark.createDataFrame(rows, "key long, node long, component long, main long, held struct<size: long, bits: array<long>, keys: array<long>>")
    assert sorted(map(tuple, nd._apart(mixed, 80).collect())) == [(5, 7), (5, 8), (6, 7), (6, 8), (7, 8)]


def test_chain_of_links_is_one_component(spark):
    w = [f"w{i}" for i in range(101)]
    rows = [(100 - k, " ".join(w[: 101 - 4 * k] + [f"n{k}_{i}" for i in range(4 * k)])) for k in range(6)]
    want = brute(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    hit = 0
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 120, np.uint64)
        a, b = np.sort(pool[:108]), np.sort(np.concatenate((pool[:96], pool[108:])))
        keys = nd.band_keys(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        hit += bool((keys[0] == keys[1]).any())
    assert hit == 300


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    got_ = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert all(got_.get(x, x) == find(x) for x in list(root))


def test_stars_take_no_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(components, "staged", lambda df, label: (made.append(label), staged(df, label))[1])
    star = [(1, n) for n in range(2, 30)] + [(40, 41), (42, 42)]
    found = connected_components(spark.createDataFrame(star, "a long, b long"))
    assert {(r.node, r.component) for r in found.collect()} == {(n, 1) for n in range(2, 30)} | {(41, 40)} and made == ["edges"]
    # a link between two components of what was found before: one round
    more = found.selectExpr("node AS a", "component AS b").unionByName(spark.createDataFrame([(7, 41)], "a long, b long"))
    made.clear()
    assert {(r.node, r.component) for r in connected_components(more).collect()} == {(n, 1) for n in (*range(2, 30), 40, 41)}
    assert made.count("starred") <= 2


def test_empty_table(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(6)
    for n in (1, 20, 400, 3000):
        pool = rng.integers(0, 1 << 63, 2 * n, np.uint64)
        a, b = pool[:n], pool[n // 3 : n // 3 + n]
        x, y = nd.bitmaps(np.concatenate((a, b)), np.array([0, n, 2 * n])).view(np.uint8)
        assert np.unpackbits(x ^ y).sum() <= len(set(a.tolist()) ^ set(b.tolist()))
