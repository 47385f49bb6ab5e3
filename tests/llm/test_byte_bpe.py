import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import byte_bpe

SMALL = "/root/testdata/sf0.001"
EDGES = [None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\n b", "a \n\n b  ", " x y　 z", "\x1c a \x1d", "don't  I'll've 12 3½ ²", "日本 語。x", "a\u0085 b", "<|endoftext|> a", "ananananan aaaaaaa", "word " * 4000]


@pytest.fixture(scope="module")
def library():
    table = byte_bpe.encoder(byte_bpe.RANKS_FILE).table
    ranks = {t: i for i, t in enumerate(table.tokens)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_equals_library(library):
    rng = random.Random(3)
    words = [bytes(rng.choices(range(256), k=rng.randint(1, 30))) for _ in range(500)]
    words += [b"a" * k for k in range(1, 60)] + [b" " * k for k in range(1, 60)] + [b"an" * k for k in range(1, 40)] + [b""]
    got = byte_bpe.replay(words, byte_bpe.encoder(byte_bpe.RANKS_FILE).table)
    assert [g.tolist() for g in got] == [list(library._encode_single_piece(w)) if w else [] for w in words]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab éñ日\n\t '’1.- ", max_size=40), max_size=6))
def test_texts_equal_library(texts):
    table = byte_bpe.encoder(byte_bpe.RANKS_FILE).table
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(table.tokens)}, special_tokens={})
    got = byte_bpe.encoder(byte_bpe.RANKS_FILE).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [enc.encode_ordinary(t) for t in texts]


def test_query_against_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = byte_bpe.op10_byte_bpe(spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = np.array(library.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_round_trip_edges(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(EDGES)] + [(None, "n", 0), (4, "a", 0)], "doc_id long, text string, ids int")
    encoded = byte_bpe.encode_documents(df)
    assert encoded.count() == len(EDGES) + 2
    back = {r.doc_id: r.text for r in byte_bpe.decode_documents(encoded).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(EDGES)) and back[None] == "n"
    assert byte_bpe.round_trip_digests(df.limit(0)).count() == 0
