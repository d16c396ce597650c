import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sarafa.llm import near_dup as N

SCHEMA = "event_id bigint, title string, band int, key int, rep int"


def table(spark, titles):
    return spark.createDataFrame([(i, t, 0, 0, 0) for i, t in enumerate(titles)], SCHEMA)


def brute(titles, threshold=0.6):
    sets = [set(re.findall(r"[^\W_]+", (t or "").lower())) for t in titles]
    return {(i, j) for i, j in itertools.combinations(range(len(titles)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-12}


def corpus(n, seed=3):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)).capitalize()
    forms = ["{} board clears merger of {} {} into {} {}", "{} to build {} {} plant with {} {} for Rs {} crore", "Q3 results: {} profit rises {}% as {} {} beats {} {}"]
    out = []
    while len(out) < n:
        form = rng.choice(forms)
        t = form.format(*[rng.choice(["Hot Steels", name()]) if k == 0 else name() for k in range(form.count("{}"))])
        out.append(t)
        for _ in range(rng.choice((0, 0, 0, 1, 3))):
            w = t.split()
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice(([], [w[at], name()], [name()], [w[at].upper()]))
            rng.shuffle(w) if rng.random() < 0.2 else None
            out.append(" ".join(w))
    return out[:n]


def test_pairs_against_brute_force(spark):
    titles = corpus(700) + [None, "", " ", "!!!", "Same words here", "here words SAME", "Same words here"]
    got = {tuple(r) for r in N.NearDuplicates(table(spark, titles), "event_id", "title").pairs().collect()}
    want = brute(titles)
    assert got == want and len(want) > 100


def test_corpus_pairs(tables):
    e = tables("ingestion_events")
    titles = [(r.event_id, r.title) for r in e.select("event_id", "title").collect()]
    got = {tuple(r) for r in N.NearDuplicates(e, "event_id", "title").pairs().collect()}
    want = {tuple(sorted((titles[i][0], titles[j][0]))) for i, j in brute([t for _, t in titles])}
    assert got == want


def test_edge_tables(spark):
    assert N.NearDuplicates(table(spark, []), "event_id", "title").pairs().count() == 0
    assert N.NearDuplicates(table(spark, []), "event_id", "title").groups().count() == 0
    assert N.NearDuplicates(table(spark, [None, "", "?"]), "event_id", "title").pairs().count() == 0
    long = " ".join(f"w{i}" for i in range(30_000))
    got = N.NearDuplicates(table(spark, [long, long + " x", "short"]), "event_id", "title").pairs().collect()
    assert [tuple(r) for r in got] == [(0, 1)]


def test_copies_are_one_class(spark):
    got = N.NearDuplicates(table(spark, ["a b c d e"] * 500 + ["a b c d e f", "z y"]), "event_id", "title").groups().collect()
    assert len({r.class_id for r in got}) == 3 and len({r.group_id for r in got}) == 2
    assert {r.n_links for r in got} == {0, 1} and len(got) == 502


def test_minima_agree_as_often_as_the_sets_weigh():
    rng = np.random.default_rng(1)
    a, b = np.arange(60, dtype=np.int32), np.arange(30, 90, dtype=np.int32)
    w = rng.uniform(0.5, 5, 90)
    m = N.minima(np.concatenate([a, b]), np.array([0, 60]), np.concatenate([w[a], w[b]]))
    assert abs((m[0] == m[1]).mean() - w[30:60].sum() / w.sum()) < 0.25


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(-40, 40), rng.randint(-40, 40)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, x) for x in range(201, 240)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            parent[max(root(u), root(v))] = min(root(u), root(v))
    want = {x: root(x) for x in list(parent)}
    got = {r.node: r.root for r in N.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == want


def test_pairs_of_common_words_only(spark):
    """Every record has common words and one of its own: no minimum agrees, the early keys find all pairs."""
    base = ["alpha beta gamma delta", "one two three four five", "red green blue"]
    titles = [f"{base[i % 3]} own{i}" for i in range(240)] + [f"{base[0]} epsilon own{i}x own{i}y" for i in range(70)]
    got = {tuple(r) for r in N.NearDuplicates(table(spark, titles), "event_id", "title").pairs().collect()}
    assert got == brute(titles)


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.8])
def test_early_keys_lose_no_pair(threshold):
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 14, rng.integers(1, 13))).astype(np.int32) for _ in range(150)]
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    own, key, side = N.early_keys(flat, starts, flat.astype(np.int64) // 2, np.ones(len(flat), bool), threshold)
    small: dict = {}
    for o, k, s in zip(own, key, side):
        small.setdefault(k, ([], []))[0].extend([o] if s <= 0 else [])
        small[k][1].extend([o] if s >= 0 else [])
    got = {tuple(sorted((x, y))) for a, b in small.values() for x in a for y in b}
    for i, j in itertools.combinations(range(len(sets)), 2):
        n = len(np.intersect1d(sets[i], sets[j]))
        if n >= threshold * (len(sets[i]) + len(sets[j]) - n):
            assert (i, j) in got


def test_pairs_of_uncommon_words_beside_changed_names(spark):
    """Six words that forty records have and two of each record's own: nearly all weight differs, and no link depends on chance."""
    titles = [" ".join([f"story{i % 12}word{k}" for k in range(6)] + [f"own{i}x", f"own{i}y"]) for i in range(480)]
    got = {tuple(r) for r in N.NearDuplicates(table(spark, titles), "event_id", "title").pairs().collect()}
    assert got == brute(titles) and len(got) == 12 * 40 * 39 // 2


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.8])
def test_rare_and_sized_keys_lose_no_pair(threshold, monkeypatch):
    """With words on both sides of RARE in one set."""
    monkeypatch.setattr(N, "RARE", 12)
    rng = np.random.default_rng(11)
    sets = [np.unique(np.minimum(rng.geometric(0.08, rng.integers(1, 13)), 60)).astype(np.int32) for _ in range(200)]
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    count = np.bincount(flat)[flat]
    assert {bool(c) for c in count > N.RARE} == {True, False}
    small: dict = {}
    for o, k in zip(*N.rare_keys(flat, starts, count, threshold)):
        assert k % 2 == 0
        [x.append(o) for x in small.setdefault(("rare", k), ([], []))]
    for o, k, s in zip(*N.early_keys(flat, starts, count, count > N.RARE, threshold)):
        small.setdefault(k, ([], []))[0].extend([o] if s <= 0 else [])
        small[k][1].extend([o] if s >= 0 else [])
    got = {tuple(sorted((x, y))) for a, b in small.values() for x in a for y in b}
    for i, j in itertools.combinations(range(len(sets)), 2):
        n = len(np.intersect1d(sets[i], sets[j]))
        if n >= threshold * (len(sets[i]) + len(sets[j]) - n):
            assert (i, j) in got


def test_no_pair_is_lost(spark):
    titles = corpus(700) + [None, "", "Same words here", "here words SAME"]
    assert {tuple(r) for r in N.NearDuplicates(table(spark, titles), "event_id", "title").pairs().collect()} == brute(titles)


def test_no_pair_of_the_corpus_is_lost(tables):
    e = tables("ingestion_events")
    rows = [(r.event_id, r.title) for r in e.select("event_id", "title").collect()]
    want = {tuple(sorted((rows[i][0], rows[j][0]))) for i, j in brute([t for _, t in rows])}
    assert {tuple(r) for r in N.NearDuplicates(e, "event_id", "title").pairs().collect()} == want


def test_blocks_of_a_large_class_lose_no_pair(spark, monkeypatch):
    """Classes beyond the block size meet themselves and each other block by block: every pair once."""
    monkeypatch.setattr(N, "BLOCK", 7)
    titles = ["a b c d e"] * 40 + ["a b c d"] * 30 + ["z y x w"] * 3 + ["lonely one"]
    got = [tuple(r) for r in N.NearDuplicates(table(spark, titles), "event_id", "title").pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(titles)


def test_keys_with_sizes_alone_find_every_pair(spark):
    """With no word counted as rare, all pairs come by the keys with sizes."""
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(40)]
    titles = [" ".join(rng.sample(pool, rng.randrange(2, 9))) for _ in range(300)]
    assert {tuple(r) for r in N.NearDuplicates(table(spark, titles), "event_id", "title", rare=0).pairs().collect()} == brute(titles)


def test_class_links_and_groups_name_least_records(spark):
    d = N.NearDuplicates(table(spark, ["a b c d", "a b c d", "a b c d e", "q r"]), "event_id", "title")
    ids = [r.event_id for r in table(spark, ["x"] * 4).select("event_id").collect()]
    assert [tuple(r) for r in d.class_links().collect()] == [(ids[0], ids[2])]
    got = {r.event_id: (r.class_id, r.group_id, r.n_links) for r in d.groups().collect()}
    assert got == {ids[0]: (ids[0], ids[0], 1), ids[1]: (ids[0], ids[0], 1), ids[2]: (ids[2], ids[0], 1), ids[3]: (ids[3], ids[3], 0)}


def test_words_of_a_large_table_share_no_counters(spark):
    """With as many words as a fixed sketch has counters, words of a few sets still count as rare, and words of one as alone."""
    n = 100_000
    own = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.hash(F.col("id") * 10 + k))
    sets = spark.range(n).select(F.array_sort(F.array_distinct(F.concat(own, F.array(F.hash(F.concat(F.lit("pair"), F.floor(F.col("id") / 2))), F.hash(F.lit("all")))))).alias("words"))
    counts = N.frequencies(sets)
    words = lambda texts: np.array([r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.hash("t").alias("h")).collect()], np.int32)
    alone = np.array([r.h for r in spark.range(1000).select(F.hash("id").alias("h")).collect()], np.int32)
    assert counts.classes == n and (counts.of(alone)[0] == 1).mean() > 0.6
    twice = counts.of(words([f"pair{i}" for i in range(1000)]))[0]
    assert twice.min() >= 2 and np.median(twice) < 16
    assert counts.of(words(["all"]))[0][0] >= n


def test_counts_are_never_too_low(spark, monkeypatch):
    """With few words, steps beyond 16 bits between their counters included."""
    monkeypatch.setattr(N, "FINE", 1 << 18)
    rng = np.random.default_rng(5)
    sets = [sorted({int(w) for w in rng.geometric(0.01, 8) * 40_009}) for _ in range(300)]
    counts = N.frequencies(spark.createDataFrame([(s,) for s in sets], "words array<int>"))
    flat = np.concatenate([np.array(s, np.int32) for s in sets])
    true = dict(zip(*np.unique(flat, return_counts=True)))
    assert all(c >= true[w] for w, c in zip(flat, counts.of(flat)[0]))
    assert (np.diff(np.sort(flat.view(np.uint32) & np.uint32(8 * len(counts.lone) - 1))) > 0xFFFF).any()


@pytest.mark.parametrize("threshold", [0.33, 0.5, 0.6, 0.8, 1.0])
def test_marks_lose_no_pair(spark, threshold):
    rng = random.Random(9)
    pool = [rng.randrange(-(2**31), 2**31) for _ in range(400)]
    sets = [rng.sample(pool, rng.choice((1, 2, 5, 12, 60, 253, 254, 255, 256, 300))) for _ in range(60)]
    sets += [[w for w in s if rng.random() < rng.choice((0.6, 0.8, 0.95))] + rng.sample(pool, 1) for s in sets for _ in range(2)]
    sets = [np.unique(np.array(s, np.int32)) for s in sets]
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    m = N.marks(flat, starts)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2)]
    told = spark.createDataFrame([(int(m[i]), int(m[j])) for i, j in pairs], "a bigint, b bigint").select(N.may_link(F.col("a"), F.col("b"), threshold).alias("may")).collect()
    similar = []
    for (i, j), r in zip(pairs, told):
        n = len(np.intersect1d(sets[i], sets[j]))
        if n * 10_000 >= round(threshold * 10_000) * (len(sets[i]) + len(sets[j]) - n):
            similar.append(r.may)
    assert all(similar) and similar and not all(r.may for r in told)


def test_bands_of_words_of_one_set_are_not_sent(spark):
    titles = [f"alone{i}a alone{i}b alone{i}c" for i in range(50)] + ["twin one two three", "twin one two four"]
    assert {tuple(r) for r in N.NearDuplicates(table(spark, titles), "event_id", "title").pairs().collect()} == brute(titles) == {(50, 51)}
    sets = table(spark, titles).select(F.col("event_id").alias("rep"), F.array_sort(F.transform(N.words(F.col("title")), lambda w: F.hash(w))).alias("words"))
    counts = N.frequencies(sets)
    known = spark.sparkContext.broadcast((counts, 1.0 / np.concatenate([[1], counts.coarse])))
    rows = N.bands(sets, known, 0.6).collect()
    assert {r.rep for r in rows} == {50, 51} and 0 < sum(r.band % 2 for r in rows if r.rep == 50) <= N.BANDS


def test_pairs_of_copies_are_not_shuffled(spark):
    """Repeating a table multiplies the pairs by the square: none of them passes an exchange; ids of several rows still give each pair once."""
    d = N.NearDuplicates(table(spark, ["a b c d"] * 30 + ["a b c d e"] * 30), "event_id", "title").pairs()
    assert d.count() == 60 * 59 // 2
    assert d._jdf.queryExecution().optimizedPlan().toString().split("\n")[0].startswith("Project")
    rows = [(0, "a b c d"), (0, "a b c d"), (1, "a b c d"), (2, "a b c d e"), (2, "a b c d e")]
    got = [tuple(r) for r in N.NearDuplicates(spark.createDataFrame(rows, "event_id bigint, title string"), "event_id", "title").pairs().collect()]
    assert sorted(got) == [(0, 1), (0, 2), (1, 2)]
