import zlib

import numpy as np
import pyarrow as pa

from loomgraph.llm import toxicity as tox
from loomgraph.llm.words import word_runs

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def scores(model, texts):
    return np.concatenate([model.scores(w) for _, _, w in word_runs(pa.array(texts, pa.string()), fold=True)])


def planted(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(400)]
    texts, y = [], []
    for i in range(n):
        t = list(rng.choice(words, rng.integers(5, 120)))
        if i % 4 == 0:
            for _ in range(3):
                t.insert(rng.integers(0, len(t)), "grumpf" + rng.choice(list("abcdefgh")))
        texts.append(" ".join(t))
        y.append(int(i % 4 == 0))
    return texts, y


def test_learns_stems_it_was_shown():
    model = tox.train(*planted(400, 1))
    texts, y = planted(200, 2)
    assert ((scores(model, texts) >= 0.5) == np.array(y, bool)).mean() > 0.98
    assert scores(model, ["zzz grumpfzz yyy"])[0] >= 0.5


def test_score_of_a_text_is_its_own():
    model = tox.train(*planted(400, 1))
    texts = [*planted(30, 3)[0], "", None, "   ", "a " * 30_000]
    together = scores(model, texts)
    alone = np.array([scores(model, [t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-5)
    assert together[-2] == together[-3] == together[-4] < 0.5


def test_one_class_or_nothing_to_learn_from():
    for texts, y in (([], []), (["a b"], [0]), ([None], [1])):
        assert scores(tox.train(texts, y), ["any text", ""]).max() < 0.5


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    got = tox.op4_toxicity(spark, MIDDLE).collect()
    assert len(got) == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    test = [(labels[r.doc_id], r.predicted, r.score) for r in got if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b, _ in test) / len(test) > 0.93
    bad, good = [s for y, _, s in test if y], [s for y, _, s in test if not y]
    assert np.mean([[b > g for g in good] for b in bad]) > 0.95


def test_sample_keeps_to_its_bounds_and_folds(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    texts, y = tox.training_sample(docs, labels, rows=40)
    assert len(texts) == 40 and sum(y) == 20
    assert sum(len((t or "").encode()) for t in tox.training_sample(docs, labels, most_bytes=20_000)[0]) <= 20_000
    held = {t for t, in docs.filter(tox.held_out(docs.doc_id)).select("text").collect()}
    other = {t for t, in docs.filter(~tox.held_out(docs.doc_id)).select("text").collect()}
    assert not set(texts) & (held - other)


def test_whole_sample_of_long_documents(spark):
    docs = spark.range(8_000).selectExpr("id AS doc_id", "repeat('ab c', 1000) AS text")
    texts, y = tox.training_sample(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic"))
    assert len(texts) == 6_000 and sum(y) == 3_000


def test_every_labelled_row_is_fitted(spark):
    ids = spark.range(9_000).selectExpr("id AS doc_id", "concat('w', id, ' plain') AS text")
    rows = tox.labelled_rows(ids, ids.selectExpr("doc_id", "cast(doc_id % 10 = 0 as int) AS toxic"))
    want = ids.filter(~tox.held_out(ids.doc_id)).count()
    assert rows.count() == want > tox.SAMPLE_ROWS
    assert rows.filter("y = 1").count() > want / 11


def test_labels_meet_texts_by_one_plan_at_every_size(spark, capsys):
    docs = spark.range(50).selectExpr("id AS doc_id", "'a b' AS text")
    rows = tox.labelled_rows(docs, docs.selectExpr("doc_id", "1 AS toxic"))
    assert rows.count() == docs.filter(~tox.held_out(docs.doc_id)).count()
    rows.explain()
    plan = capsys.readouterr().out
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan


def test_shards_learn_together(spark):
    texts, y = planted(1_500, 1)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, k in enumerate(y)], "doc_id long, toxic int")
    rows = tox.labelled_rows(docs, labels).cache()
    one, many = (tox.fit_all(rows, shard_bytes=n) for n in (1 << 30, 100_000))
    texts, y = planted(200, 2)
    for model in (one, many):
        assert ((scores(model, texts) >= 0.5) == np.array(y, bool)).mean() > 0.98
    assert np.allclose(scores(tox.fit_all(rows.repartition(3), shard_bytes=100_000), texts), scores(many, texts), atol=1e-4)
    assert scores(tox.fit_all(rows.filter("y = 0")), texts).max() < 0.5


def test_logit_of_features_is_that_of_the_text():
    model = tox.train(*planted(100, 1))
    w = next(w for _, _, w in word_runs(pa.array(["grumpfa b c d", None], pa.string()), fold=True))
    assert np.allclose([model.logit(tox.features(w)), model.logit(tox.features(w)[:0])], model.logits(w), atol=1e-5)


def test_edges(spark):
    schema = "doc_id long, text string, score string, held_out int"
    model = tox.train(*planted(100, 1))
    df = spark.createDataFrame([(None, "a", "x", 1), (1, None, "x", 1), (1, None, "x", 1), (2, "grumpfa grumpfb x", None, None)], schema)
    got = tox.score_toxicity(df, model).collect()
    assert len(got) == 4 and {r.predicted for r in got if r.doc_id == 2} == {1}
    assert tox.score_toxicity(df.limit(0), model).count() == 0
