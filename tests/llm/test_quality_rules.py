import re
from collections import Counter

import numpy as np
import pyarrow as pa

from loomgraph.llm import quality_rules as q

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, seen, lines, again = WORD.findall(text), set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            again += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    near = sum(word in words[max(0, i - 50) : i] for i, word in enumerate(words))
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, again, len(covered), len(re.findall(r"[!-/:-@\[-`{-~]", text)), near]


EDGES = [None, "", " ", "\n\n", "a", "a b c a b c", "x\nx\n x\nx", "é#|<\r\ny\r\ny", "a b\x0bc\x0ca b c", "w " * 5000, "    z", "no end\nno end"]


def test_counts_against_brute_force(spark):
    texts = EDGES + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = np.stack([c.to_numpy() for c in q.text_statistics(pa.array(texts, pa.string())).flatten()], 1)
    for text, row in zip(texts, got.tolist(), strict=True):
        assert row == brute(text), text


def test_query_counts_and_rejects(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = q.op9_quality_rules(spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        n, chars, symbols, _, again, repeat, _, _ = brute(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, again, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.base_failed and r.kept)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    judged = [(quality[r.doc_id], r.kept) for r in got if r.doc_id in quality and not r.base_failed]
    # so few rows pool all languages in one group: every bad row goes, one clean row in fifty may
    assert not any(kept for label, kept in judged if label == 0)
    assert sum(not kept for label, kept in judged if label == 1) <= len(judged) / 50


def frame(spark, data, grp="g"):
    return spark.createDataFrame([(grp, *map(float, x)) for x in data], "grp string, " + ", ".join(f"{f} double" for f in q.FEATURES))


def scatter_of(m):
    inverse = np.zeros((4, 4))
    for i, j in q.PAIRS:
        inverse[i, j] = inverse[j, i] = m[f"w{i}{j}"]
    return np.linalg.inv(inverse)


def brute_mcd(data, starts=200):
    """Least determinant of the covariance of COVER of the rows, by concentration steps from many random starts."""
    rng, h, best = np.random.default_rng(5), int(np.ceil(len(data) * q.COVER)), None
    for _ in range(starts):
        inner = rng.choice(len(data), 6, replace=False)
        for _ in range(50):
            m, s = data[inner].mean(0), np.cov(data[inner].T, bias=True) + 1e-12 * np.eye(4)
            d = np.einsum("ij,jk,ik->i", data - m, np.linalg.inv(s), data - m)
            after = np.sort(np.argsort(d, kind="stable")[:h])
            if len(after) == len(inner) and (after == inner).all():
                break
            inner = after
        det = np.linalg.det(np.cov(data[inner].T, bias=True))
        if best is None or det < best[0]:
            best = det, data[inner].mean(0), np.cov(data[inner].T, bias=True)
    return best


def test_estimate_against_brute_force(spark):
    rng = np.random.default_rng(0)
    turn = np.array([[0.02, 0, 0, 0], [0.05, 0.1, 0, 0], [0, 0.1, 0.2, 0], [0.1, 0, -0.1, 0.3]])
    data = rng.normal(0, 1, (400, 4)) @ turn.T + [1.6, -2, -2.1, 3.4]
    data[:80] = rng.normal([2.0, 0.5, -1, 3.3], 0.1, (80, 4))
    copies = np.repeat(data[399:], 2000, axis=0)
    m = q.mcd_models(frame(spark, np.concatenate((data, copies)))).collect()[0]
    det, mean, cov = brute_mcd(data)
    assert abs(m["det"] / det - 1) < 0.03
    assert np.allclose([m[f"m{i}"] for i in range(4)], mean, atol=0.01)
    assert np.allclose(scatter_of(m), cov * q._consistency(q.COVER), rtol=0.05, atol=3e-4)
    d = np.einsum("ij,jk,ik->i", data - mean, np.linalg.inv(scatter_of(m)), data - mean)
    assert (d[:80] > m["cut"]).all() and (d[80:] <= m["cut"]).all()


def test_least_variance_is_not_the_scatter(spark):
    rng = np.random.default_rng(1)
    m = q.mcd_models(frame(spark, rng.normal([1.6, -2, -2.1, 3.4], [0.02, 0.11, 0.16, 0.37], (3000, 4)))).collect()[0]
    assert (q.LEAST_VARIANCE < 0.05 * np.diag(scatter_of(m))).all()
    # a group whose vectors all agree: the exact fit is floored, not singular
    assert q.mcd_models(frame(spark, [[1.6, -2, -2.1, 3.4]] * 50)).collect()[0]["det"] > 0


def test_empty_null_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, grp string, n_words int, kept int"
    assert q.quality_rules(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None, None, "g", 1, 1), (2, "", "en", None, "g", 1, 1), (None, " ".join(f"w{i}" for i in range(90)), None, "s", None, None, None), (4, "a " * 200, "en", "s", "", 0, 0)]
    got = {r.doc_id: r for r in q.quality_rules(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].base_failed and got[2].base_failed and got[4].base_failed
    assert got[None].kept and got[None].n_words == 90
