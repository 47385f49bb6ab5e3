import hashlib
import math
import random
from fractions import Fraction

import pytest
from oracle import rows, sql_rows

from loomgraph.llm import vector_codes as vc

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, code string, n int, data string"


def brute(vectors, parts=16, entries=64, rounds=2):
    """Rows (vec_id, vector, label) as the contract words it, in Python integers."""
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v], g, v) for i, v, g in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    books = [[cut(v)[p] for _, v, _, _ in first] for p in range(parts)]

    def near(piece, book):
        away = [sum((a - b) ** 2 for a, b in zip(piece, e, strict=True)) for e in book]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        groups = [[[] for _ in b] for b in books]
        for _, v, _, _ in kept:
            for p, piece in enumerate(cut(v)):
                groups[p][near(piece, books[p])[0]].append(piece)
        books = [[[sum(c) // len(g) for c in zip(*g, strict=True)] if g else e for g, e in zip(gs, b, strict=True)] for gs, b in zip(groups, books, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, total = [], {}
    for i, v, g, _ in kept:
        found = [near(piece, books[p]) for p, piece in enumerate(cut(v))]
        error = sum(d for _, d in found)
        total[g] = total.get(g, 0) + error
        out.append((i, "".join(f"{at:02x}" for at, _ in found), error, g))
    return sorted(((i, c, e, total[g], digest) for i, c, e, g in out), key=repr)


def got(spark, data, **options):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in data], SCHEMA)
    return sorted(map(tuple, vc.vector_codes(df, **options).collect()), key=repr)


def test_query_same_as_brute_force(spark):
    read = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    found, names = rows(vc.op12_vector_codes(spark, SMALL))
    order = [names.index(n) for n in ("vec_id", "code", "error", "label_error", "codebooks_sha256")]
    assert sorted((tuple(r[k] for k in order) for r in found), key=repr) == brute([(r.vec_id, r.embedding, r.label) for r in read])


def test_same_as_sql(spark):
    assert rows(vc.op12_vector_codes(spark, SMALL)) == sql_rows(SMALL, vc.ORACLE)


@pytest.mark.parametrize("most", [100_000, 0])
def test_edges(spark, most):
    rng = random.Random(4)
    vec = lambda: [rng.choice([-0.5, -0.001, 0.0, 0.25, 3.999, -7.3]) * rng.random() for _ in range(32)]
    data = [(rng.randrange(-50, 400), vec(), rng.choice([None, 1, 2, 2, 2])) for _ in range(300)]
    data += [data[0], data[0], (5, None, 1), (6, [None] + vec()[1:], 1), (7, [math.nan] + vec()[1:], 1), (8, [math.inf] + vec()[1:], None), (None, vec(), 2), (9, [-1e-30] * 32, 1)]
    assert got(spark, data, block=37, most_broadcast=most) == brute(data)
    assert got(spark, data[:5]) == brute(data[:5])
    assert got(spark, []) == [] and got(spark, [(1, None, 1)]) == []


def test_large_components_stay_exact(spark):
    rng = random.Random(6)
    data = [(i, [rng.uniform(-1, 1) * rng.choice([1.0, 2e6]) for _ in range(16)], i % 2) for i in range(120)]
    assert got(spark, data, entries=8) == brute(data, entries=8)


def test_lengths_must_agree(spark):
    with pytest.raises(Exception, match="components"):
        got(spark, [(1, [0.0] * 16, 1), (2, [0.0] * 16, 1), *[(i, [0.0] * 32, 1) for i in range(3, 9)]], entries=2)
