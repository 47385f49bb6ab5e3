import hashlib
import random
import re

import pytest
from oracle import rows, sql_rows

from loomgraph.llm import decontamination as dc

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    known = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        for s in range(len(w) - n + 1 if n else 0):
            known.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in known}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in known:
                    hit.update(range(s, s + n))
                    found |= known[tuple(w[s : s + n])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, row int, words string")
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, print int")
    return sorted(map(tuple, dc.decontaminate(d, b, **options).collect()), key=repr)


def test_same_as_sql(spark):
    assert rows(dc.op11_decontamination(spark, SMALL)) == sql_rows(SMALL, dc.ORACLE)


@pytest.mark.parametrize(("seed", "short", "most"), [(1, True, 500_000), (2, False, 0), (3, True, 0)])
def test_same_as_brute_force(spark, seed, short, most):
    rng = random.Random(seed)
    text = lambda n, v: " ".join(f"{rng.choice('aBé7')}{rng.randrange(v)}" for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 5, 7, 9] if short and i % 4 == 0 else [10, 11, 25, 40]), 12 if i % 3 else 2)) for i in range(40)]
    docs = []
    for d in range(120):
        t = text(rng.randrange(60), 12)
        if d % 2:
            w = rng.choice(items)[1].split()
            k = rng.randrange(len(w))
            t += rng.choice([" ", ", ", "\n"]) + " ".join(w[k : k + rng.randrange(1, 30)]).upper() + "! " + text(rng.randrange(9), 12)
        docs.append((d, t))
    assert got(spark, docs, items, most_broadcast=most) == brute(docs, items)


def test_edges(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    items = [(1, passage), (1, "again " + passage), (None, "lone item here"), (3, None), (4, "..."), (10, passage), (2, "tiny")]
    long = " ".join(f"u{i % 7000}" for i in range(30_000)) + " " + passage + " a" * 5000
    docs = [(1, None), (2, ""), (3, " .\n"), (4, passage), (4, passage), (None, "x " + passage + " y"), (5, long), (6, "a lone item here"), (7, "TINY"), (8, " ".join(["w1"] * 4096) + passage)]
    assert got(spark, docs, items) == brute(docs, items)
    assert got(spark, docs, []) == brute(docs, [])
    assert got(spark, [], items) == []


def test_every_long_enough_span_shares_a_fingerprint(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("abc") for _ in range(rng.choice([10, 11, 30, 300])))) for i in range(60)]
    items = [(i, t) for i, t in docs[::3]] + [(100 + i, " ".join(rng.choice("abc") for _ in range(10))) for i in range(30)]
    assert got(spark, docs, items) == brute(docs, items)
