import corpus_pipeline
import test_near_dedup
import test_packing
import test_substring_dedup

from loomgraph.llm import toxicity
from loomgraph.llm.exact_dedup import drop_copies
from loomgraph.llm.substring_dedup import WINDOW

MIDDLE = "/root/testdata/sf0.001"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    columns, last = docs.columns, None
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, MIDDLE)
        if i == len(corpus_pipeline.STAGES) - 1:
            rows = [(r.doc_id, test_packing.ids_of(r.text)) for r in last]
            test_packing.check(out.collect(), rows)
            break
        assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(str(tmp_path / name))
        before = docs.collect()
        docs = spark.read.parquet(str(tmp_path / name))
        last = docs.collect()
        kept = {r.doc_id: r for r in last}
        assert len(kept) == len(last)
        if name == "toxicity":
            scores = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.read.parquet(f"{MIDDLE}/documents.parquet"), toxicity.fit_toxicity(spark, MIDDLE)).collect()}
            assert set(kept) == {d for d, s in scores.items() if s < 0.5} and 0 < len(kept) < len(before)
        if name == "exact_dedup":
            best = {}
            for r in before:
                best[low(r.text)] = max(best.get(low(r.text), -1), r.doc_id)
            assert set(kept) == set(best.values())
        if name == "near_dedup":
            assert set(kept) == {d for d, _, _, k in test_near_dedup.brute([(r.doc_id, r.text) for r in before]) if k}
        if name == "substring_dedup":
            for d, _, gone, text in test_substring_dedup.brute([(r.doc_id, r.text) for r in before]):
                r = next(x for x in before if x.doc_id == d)
                assert (kept[d].text, kept[d].n_chars) == ((text, len(text)) if gone else (r.text, r.n_chars))
                assert (kept[d].lang, kept[d].source) == (r.lang, r.source)
            assert WINDOW == 50


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "A", "x"), (1, "a", "y"), (1, "a", "y"), (None, "b", None), (None, "b", None), (2, None, "z"), (3, "", "z")], "doc_id long, text string, __id2 string")
    assert sorted((str(r.doc_id), r.text) for r in drop_copies(df).collect()) in ([("1", "A"), ("3", ""), ("None", "b")], [("1", "a"), ("3", ""), ("None", "b")])


def test_decisions_hold_for_the_row_not_for_its_id(spark):
    df = spark.createDataFrame([(None, "b"), (None, "c"), (5, "c"), (6, "d"), (6, "e"), (7, "d")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in drop_copies(df).collect()) == [("5", "c"), ("6", "e"), ("7", "d"), ("None", "b")]
    words = " ".join(f"w{i}" for i in range(60))
    near = spark.createDataFrame([(3, words), (5, words + " end"), (5, "quite another text"), (None, words + " tail"), (None, "")], "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, near, MIDDLE).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("3", words), ("5", "quite another text"), ("None", "")]


def test_columns_of_any_name(spark):
    long = " ".join(f"w{i}" for i in range(70))
    schema = "doc_id long, text string, n_chars long, __removed string, __id int, __text string, __n int, row_id int, row_text string, `a.b` string"
    rows = [(1, long, 5, "r", 1, "t", 2, 3, "x", "y"), (2, long + " tail", 5, "s", 1, "t", 2, 3, "x", "z"), (2, long + " tail", 5, "s", 1, "t", 2, 3, "x", "z")]
    df = spark.createDataFrame(rows, schema)
    for stage in (corpus_pipeline.exact_dedup, corpus_pipeline.near_dedup, corpus_pipeline.substring_dedup):
        out = stage(spark, df, MIDDLE)
        assert out.columns == df.columns and [tuple(r)[3:] for r in out.collect() if r.doc_id == 1] == [tuple(rows[0])[3:]]
    assert sorted((r.text, r.n_chars) for r in corpus_pipeline.substring_dedup(spark, df, MIDDLE).collect()) == [("tail", 4), ("tail", 4), (long, 5)]
    assert [stage(spark, df.limit(0), MIDDLE).count() for stage in (corpus_pipeline.exact_dedup, corpus_pipeline.near_dedup, corpus_pipeline.substring_dedup)] == [0, 0, 0]
