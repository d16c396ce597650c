import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from sarafa.llm import mixing as M

TARGETS = "source string, target_share double, max_repeats int"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS n", "2 AS label", "3 AS cap")


def test_shares_are_reached(spark):
    topics = {"a": "profit revenue margin ", "b": "plant outage boiler ", "c": "rating debt notes "}
    rows = [(i, topics[s] * (5 + i % 7), s) for i, s in enumerate("aabbbbcc" * 60)] + [(1000, topics["b"] * 6, None), (1001, "", "a"), (1002, None, "b"), (1003, "x y z", "none")]
    t = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 2), ("c", 0.1, 1), ("ghost", 0.1, 2)], TARGETS)
    m = M.Mixture(docs(spark, rows), t)
    got = {r.source: r for r in m.shares().collect()}
    assert abs(got["a"].actual_share - 0.5 / 0.9) < 0.01 and abs(got["b"].actual_share - 0.3 / 0.9) < 0.01 and got["ghost"].tokens == 0
    each = m.copies().collect()
    most = {0: 3, 1: 2, 2: 1, 4: 0}
    assert all(r.copies <= most.get(r.label, 3) and r.copies >= 0 for r in each) and len(each) == 482
    size, whole = sum(r.copies * r.n_tokens for r in each), sum(r.n_tokens for r in each)
    assert abs(size / whole - 1) < 0.01
    soft = next(r for r in each if r.doc_id == 1000)
    assert np.argmax(soft.member) == 1 and math.isclose(sum(soft.member), 1, abs_tol=1e-5)


def test_wrong_labels_give_way_to_strong_texts(spark):
    """A document whose text plainly belongs elsewhere is counted there; all others keep the source they state."""
    topics = {"a": "profit revenue margin growth ", "b": "plant outage boiler turbine ", "c": "rating debt notes coupon "}
    rows = [(i, topics[s] * (5 + i % 7), s) for i, s in enumerate("aabbbbcc" * 60)] + [(2000 + i, topics["a"] * 9, "c") for i in range(4)]
    t = spark.createDataFrame([("a", 0.4, 3), ("b", 0.3, 2), ("c", 0.3, 3)], TARGETS)
    m = M.Mixture(docs(spark, rows), t)
    each = {r.doc_id: r for r in m.copies().collect()}
    assert all(np.argmax(each[2000 + i].member) == 0 for i in range(4))
    assert all(np.argmax(r.member) == r.label for i, r in each.items() if i < 2000)
    assert all(abs(r.actual_share - r.target_share) < 0.01 for r in m.shares().collect())


def test_capped_source_gives_all_it_may(spark):
    rows = [(i, "word " * 50, "small" if i < 10 else "big") for i in range(200)]
    t = spark.createDataFrame([("small", 0.5, 2), ("big", 0.5, 2)], TARGETS)
    got = {r.source: r for r in M.Mixture(docs(spark, rows), t).shares().collect()}
    assert got["small"].most_copies == 2 and got["small"].documents == 10
    assert abs(got["small"].actual_share - 0.1) < 0.01 and abs(got["big"].actual_share - 0.9) < 0.01


def test_empty_tables_and_repeated_rows(spark):
    t = spark.createDataFrame([("a", 1.0, None), ("a", None, 1), (None, 0.5, 1)], TARGETS)
    assert M.Mixture(docs(spark, []), t).copies().count() == 0
    assert M.Mixture(docs(spark, []), t).shares().first().tokens == 0
    assert M.Mixture(docs(spark, [(1, "x", "a"), (1, "x", "a")]), t).copies().count() == 2
    assert [r.copies for r in M.Mixture(docs(spark, [(1, "x", "a")]), t.limit(0)).copies().collect()] == [0]


@given(st.lists(st.tuples(st.floats(0, 1), st.floats(0, 5)), min_size=1, max_size=6), st.floats(0.1, 10))
def test_fill(parts, total):
    wanted, room = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    got = M.fill(wanted.copy(), room, total)
    assert (got <= room + 1e-9).all() and (got >= 0).all()
    # Wants of less than a millionth of a millionth of the total count as none.
    assert got.sum() == pytest.approx(min(total, room[wanted > total * 1e-12].sum()), rel=1e-6, abs=1e-9)


def test_classifier_on_held_out_documents(tables):
    """Memberships say more than the sources' sizes do: a held-out label is the likeliest more often than the largest source is."""
    d = tables("documents")
    m = M.Mixture(d, tables("mix_targets"))
    model = m.model
    from sarafa.llm import tokens

    e = tokens.Encoder(tokens.read_ranks())
    held = [(r.text, m.sources.index(r.source)) for r in d.collect() if r.text and r.source in m.sources]
    ids = e.encode([t for t, _ in held])
    flat = np.array([i for x in ids for i in x]) % M.FEATURES
    top = M._scores(flat, np.array([len(x) for x in ids]), model).argmax(1)
    labels = np.array([s for _, s in held])
    assert (top == labels).mean() >= np.bincount(labels).max() / len(labels)
