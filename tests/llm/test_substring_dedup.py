import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import substring_dedup as sd
from loomgraph.llm.words import word_runs

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
K = sd.WINDOW


def brute(rows):
    """(doc_id, words, removed, kept text) of each row, over all windows."""
    top = float("inf")
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - K + 1):
            g = tuple(w[i : i + K])
            first[g] = min(first.get(g, top), top if d is None else d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {i + j for i in range(len(w) - K + 1) if first[tuple(w[i : i + K])] < (top if d is None else d) for j in range(K)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def got(df, **kw):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in sd.remove_repeats(df, **kw).collect()), key=repr)


def passages():
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randrange(500))
    shared = [[word() for _ in range(n)] for n in (50, 51, 80, 200, 49)]
    rows = []
    for d in rng.sample(range(1000), 60):
        t = []
        for _ in range(rng.randrange(4)):
            t += [word() for _ in range(rng.randrange(60))] + (rng.choice(shared) if rng.random() < 0.7 else [])
        rows.append((d, "  ".join(t) if d % 2 else "\n ".join(t) + " "))
    rows += [(2000, None), (2001, ""), (2002, "é " * 300), (2003, "é " * 120), (None, " ".join(shared[3])), (None, "é " * 60)]
    rows += [(rows[0][0], rows[0][1]), (3000, " ".join(shared[3])), (3000, " ".join(shared[3]) + " tail"), (3001, "x " * 3000)]
    return rows


def test_against_brute_force(spark):
    rows = passages()
    df = spark.createDataFrame([(d, t, 1, "b") for d, t in rows], "doc_id long, text string, bucket int, blob string")
    assert got(df) == brute(rows)
    assert got(df.repartition(3), n_buckets=2) == brute(rows)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = [(d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in brute(rows)]
    result = sd.op1_substring_dedup(spark, SMALL)
    assert result.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, result.collect()), key=repr) == sorted(want, key=repr)
    assert any(w[2] for w in want)


@pytest.mark.parametrize("frequent", [False, True])
def test_equal_windows_have_equal_minimisers(frequent):
    texts = [t for _, t in passages()]
    by = {}
    for _, _, w in word_runs(pa.array(texts, pa.string())):
        often = np.sort(np.unique(sd.rolling(w.hashes(), sd.MINIMISER))[::3]) if frequent else np.zeros(0, np.uint64)
        first, count, rank = sd.super_kmers(w, often)
        pack = sd.Packed(w)
        n = 0
        for a, c, r in zip(first, count, rank, strict=True):
            words = pack.raw[pack.start[a] : pack.end[a + c + K - 2]].split(b" ")
            assert len(words) == c + K - 1
            for i in range(c):
                assert by.setdefault(tuple(words[i : i + K]), r) == r
                n += 1
        assert n == sum(max(0, len(WORD.findall(t or "")) - K + 1) for t in texts)


def test_collisions_are_regrouped(monkeypatch):
    h = np.arange(200, dtype=np.uint64) % np.uint64(70)
    at = np.arange(0, 150)
    doc = np.arange(150)[::-1].copy()
    want = sd.first_holders(h, at, doc)
    monkeypatch.setattr(sd, "powers", lambda base, n: np.zeros(n, np.uint64))
    assert np.array_equal(sd.first_holders(h, at, doc), want)
    assert want[0] == doc[140] and want[75] == doc[145]


def test_empty_table(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []


def test_many_rows_of_one_text(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = spark.range(6_000).selectExpr("7 AS doc_id", f"'{text}' AS text").unionByName(spark.createDataFrame([(3, f"x {text} y")], "doc_id long, text string"))
    got = {(r.doc_id, r.n_removed): r["count"] for r in sd.remove_repeats(rows, with_text=False).groupBy("doc_id", "n_removed").count().collect()}
    assert got == {(3, 0): 1, (7, 300): 6_000}


@pytest.mark.parametrize("flush_bytes", [1 << 30, 20_000])
def test_texts_travel_once_whatever_the_order(flush_bytes):
    rng = random.Random(8)
    passage = [f"p{rng.randrange(10_000)}" for _ in range(200)]
    rows = [(d, " ".join([f"a{rng.randrange(10**6)}" for _ in range(60)] + passage + [f"b{d}"] * 3)) for d in range(300)]
    often = np.sort(np.unique(sd.rolling(next(iter(word_runs(pa.array([" ".join(passage)], pa.string()))))[2].hashes(), sd.MINIMISER)))

    def sent(order):
        out, blobs = sd._Sender(8, often), {}
        found, size = [], 0
        for d, t in order:
            for _, _, w in word_runs(pa.array([t], pa.string())):
                out.add(w, np.array([d]), np.array([d]))
            if out.bytes > flush_bytes or (d, t) == order[-1]:
                for b in out.flush():
                    for to, kind, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                        if kind:
                            found.append(np.frombuffer(blob, "<i8").reshape(-1, 4))
                        else:
                            blobs.setdefault(to, []).append(blob)
        for mine in blobs.values():
            size += len(sd._unpack(mine)[0])
            found.append(sd._judge(mine))
        cover = {d: set() for d, _ in rows}
        for d, _, first, n in np.concatenate(found).tolist():
            cover[d].update(range(first, first + n + K - 1))
        return {d: len(c) for d, c in cover.items()}, size

    up, up_size = sent(rows)
    down, down_size = sent(rows[::-1])
    mixed, mixed_size = sent(rng.sample(rows, len(rows)))
    assert up == down == mixed == {r[0]: r[2] for r in brute(rows)}
    assert max(down_size, mixed_size) <= 1.01 * up_size
