import itertools
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sarafa.llm.normal_form import canonical, normal_forms, same_look_pairs

SAME = [
    ("café", "café"), ("Rs 276", "Ｒｓ ２７６"), ("office", "oﬃce"), ("profit", "pro­fit"), ("bank", "﻿b​an⁠k‎"), ("1,234", "1，234"), ("a b", "a b"), ("a b", "a b"),
    ("SCOPE", "ЅСОРЕ"), ("ड़", "ड़"), ("Wait...", "Wait…"), ("re-do", "re‑do"), ("ệ", "ệ"), ("ệ", "ệ"), ("q̣̇", "q̣̇"), ("가", "가"), ("x́y", "x​́y"), ("\u03cc", "\u03bf\u0301"), ("\u03cc", "ó"), ("\u0451", "ë"),
]
DIFFERENT = [("a", "A"), ("cafe", "café"), ("10", "100"), ("m2", "m²"), ("a b", "a  b"), ("a b", "ab"), ("½", "1/2"), ("ж", "x"), ("👩‍💻", "👩💻"), ("a\nb", "a b"), ("a-b", "ab")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert canonical(a) == canonical(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    assert canonical(a) != canonical(b)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aeｅẹ́́​­а  ﬁक़각가‍👩A1", max_size=12))
def test_segments_give_what_the_whole_text_would(text):
    """Splicing unstable runs equals normalizing everything; the form is stable."""
    from sarafa.llm.normal_form import JOINER, properties

    once = canonical(text)
    assert canonical(once) == once
    if JOINER not in text:
        to = properties()[0]
        whole = "".join(to.get(c, c) for c in text)
        whole = "".join(to.get(c, c) for c in unicodedata.normalize("NFC", whole))
        assert once == unicodedata.normalize("NFC", whole)


def test_canonical_equivalents_have_one_form():
    """Texts over many blocks: composed or decomposed, the form is the same and stable."""
    import random

    rng = random.Random(5)
    blocks = ((0x20, 0x250), (0x300, 0x370), (0x391, 0x3FF), (0x400, 0x460), (0x900, 0x970), (0x1100, 0x1200), (0x1E00, 0x2000), (0xAC00, 0xAC40), (0xF900, 0xFA10), (0xFF00, 0xFFEF))
    letters = [chr(c) for a, b in blocks for c in range(a, b)]
    for _ in range(8000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
        form = canonical(text)
        assert {canonical(unicodedata.normalize(f, text)) for f in ("NFC", "NFD")} == {form} == {canonical(form)}


def test_forms_of_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "​" * 50_000 + "x")], "doc_id int, text string").selectExpr("*", "'y' AS form")
    assert {r.id: r.form for r in normal_forms(df).collect()} == {1: None, 2: "", 3: "x"}


def test_pairs(spark, rows):
    texts = [None, "", " ", "​", "profit up", "pro­fit up", "profit up", "profit up", "Profit up", "other"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "doc_id AS id")
    want = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if texts[a] and texts[b] and texts[a] != texts[b] and canonical(texts[a]) == canonical(texts[b]) and canonical(texts[a]).strip()]
    assert rows(same_look_pairs(df)) == sorted(want, key=str)
    assert same_look_pairs(df.limit(0)).count() == 0


def test_many_copies_of_one_stored_text(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id = 7 THEN 'pro­fit' ELSE 'profit' END AS text")
    assert same_look_pairs(df).count() == 2999


def test_pairs_of_the_corpus(tables, rows):
    docs = [(r.doc_id, r.text) for r in tables("documents").collect() if r.text and r.text.strip()]
    forms: dict = {}
    for i, t in docs:
        forms.setdefault(canonical(t), []).append((i, t))
    want = sorted(tuple(sorted((i, j))) for v in forms.values() for (i, a), (j, b) in itertools.combinations(v, 2) if a != b)
    assert sorted(tuple(r) for r in same_look_pairs(tables("documents")).collect()) == want


def test_a_hot_text_meets_its_variants_in_blocks(spark, monkeypatch):
    from sarafa.llm import normal_form

    monkeypatch.setattr(normal_form, "BLOCK", 7)
    texts = ["same caf\u00e9"] * 40 + ["same cafe\u0301"] * 9 + ["same\u00a0caf\u00e9", "other"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [tuple(r) for r in same_look_pairs(df).collect()]
    want = {(i, j) for i, j in itertools.combinations(range(50), 2) if texts[i] != texts[j]}
    assert len(got) == len(want) and set(got) == want
    assert sorted(tuple(r) for r in normal_form.same_look_classes(df).collect()) == [(0, 40), (0, 49), (40, 49)]
