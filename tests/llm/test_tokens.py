import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sarafa.llm import tokens

tiktoken = pytest.importorskip("tiktoken")
RANKS = tokens.read_ranks()
OURS = tokens.Encoder(RANKS)
THEIRS = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_same_as_the_public_encoder(text):
    assert OURS.encode([text])[0] == THEIRS.encode_ordinary(text)


def test_random_bytes_in_one_trie():
    rng = random.Random(2)
    words = {bytes(rng.choice(b"aeinorst -=0\xc3\xa9\xe0") for _ in range(rng.randint(1, 18))) for _ in range(4000)}
    got = OURS.vocabulary.encode_words(words)
    assert all(b"".join(OURS.vocabulary.token[i] for i in ids) == w for w, ids in got.items())
    assert all(got[w] == THEIRS._encode_single_piece(w) for w in words)


def test_table(spark):
    long = "crore and lakh " * 20_000
    df = spark.createDataFrame([(1, "Net profit of ₹276 crore"), (2, ""), (3, None), (4, "<|endoftext|>"), (1, "Net profit of ₹276 crore"), (5, long)], "doc_id int, text string").selectExpr("doc_id", "text", "1 AS ids")
    got = [(r.doc_id, r.ids) for r in tokens.token_ids(df).collect()]
    want = {i: THEIRS.encode_ordinary(t or "") for i, t in df.select("doc_id", "text").collect()}
    assert len(got) == 6 and all(ids == want[i] for i, ids in got) and want[2] == want[3] == []
    assert tokens.token_ids(df.limit(0)).count() == 0


def test_corpus_round_trip(tables):
    docs = {r.doc_id: r.text or "" for r in tables("documents").select("doc_id", "text").collect()}
    for r in tokens.token_ids(tables("documents")).collect():
        assert b"".join(OURS.vocabulary.token[i] for i in r.ids).decode() == docs[r.doc_id]


def test_memory_starts_afresh(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    e = tokens.Encoder(RANKS)
    texts = ["one two three four five", "five six seven", "one two"]
    assert [e.encode([t])[0] for t in texts] == [THEIRS.encode_ordinary(t) for t in texts]
