import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomgraph.llm import token_files as tf
from loomgraph.llm.word_tokens import END_ID, MODEL_FILE, tokenizer

SMALL = "/root/testdata/sf0.001"
EDGES = ["", None, "Ａ é É İstanbul ΣΑΣ. <|endoftext|>", "<|endoftext|> a<|startoftext|>b <|END", "one.\nTwo\r\nthree\x1cfour\u2028five", "a  b\n c d", "it's I'LL 12a_b", "ǅ é ́x", " ' 's 'S", "word " * 9000]


def library():
    return Tokenizer.from_file(public_tokenizers.path(MODEL_FILE))


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, tf.BLOCK, tf.BLOCK + 1, 100_000])
def test_container_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.2, n) % 49_408).astype("<u4")
    assert np.array_equal(tf.decode_container(tf.encode_container(ids)), ids)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 49_407), max_size=300), st.integers(1, 400))
def test_container_any_ids(ids, times):
    x = np.array(ids * times, "<u4")
    assert np.array_equal(tf.decode_container(tf.encode_container(x)), x)


def test_damage_is_found():
    raw = bytearray(tf.encode_container(np.arange(40_000, dtype="<u4") % 900))
    raw[len(raw) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        tf.decode_container(bytes(raw))
    with pytest.raises(ValueError, match="not a token"):
        tf.decode_container(b"x" * 40)


def test_size_is_near_the_entropy():
    ids = (np.random.default_rng(1).zipf(1.3, 400_000) % 20_000).astype("<u4")
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    assert len(tf.encode_container(ids)) * 8 < 1.12 * len(ids) * -(p * np.log2(p)).sum()


def test_pieces_equal_library():
    lib = library()
    for text, got in zip(EDGES, tokenizer(MODEL_FILE).encode(EDGES), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == lib.encode(text or "", add_special_tokens=False).ids


def test_query_against_library(spark):
    lib, start = library(), 0
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    got = {r.doc_id: r for r in tf.op7_token_files(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for d, text in docs:
        ids = np.array(lib.encode(text, add_special_tokens=False).ids + [END_ID], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_edges(spark):
    rows = [(i, t, 5) for i, t in enumerate(EDGES)] + [(None, "z", 5), (3, "again", 5), (3, EDGES[3], 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    got = sorted(tf.read_token_files(tf.write_token_files(df, container_tokens=50)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 3, 3, 4, 5, 6, 7, 8, 9]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False)) and got[0].start == 0
    assert tf.read_token_files(tf.write_token_files(df.limit(0))).count() == 0
