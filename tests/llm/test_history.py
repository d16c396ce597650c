import itertools
import random

import numpy as np
import pytest

from sarafa.llm import history as H
from sarafa.llm import small_world as W

SHA = "93dade54806b66c08361a77a6aa3e75cb1798f58e4e4cad76295ac6eefea8272"
SCHEMA = "event_id bigint, batch_no int, item_key string, content_hash string, block int, slug string, origin string"


def events(spark, *rows):
    return spark.createDataFrame([(i, b, k, h, 0, "", "") for i, (b, k, h) in enumerate(rows, 1)], SCHEMA)


SAME_KEYS = ["news:ABC:2024-03-04:alpha-beta-stake-sale", " \tNEWS : abc : 2024-03-04 : Alpha-Beta-Stake-Sale ", "news|ABC.NS|2024/03/04|alpha_beta_stake_sale", "newss::ABC-EQ::04 Mar 2024::alpha--beta--stake--sale", '"news:ABC:04-Mar-2024:alpha%20beta%20stake%20sale"', "news/ABC/20240304/alpha-beta-stake-sale.html?ref=rss", "news:ABC:2024-03-04:alpha-beta-stake-sale#latest", "news:ABC:2024-03-04:the-alpha-beta-stake-sale", "news:ABC:2024-03-04:alpha-beta-stake", "news:ABC:2024-03-04:sale-alpha-beta-stake", "news:ABC:2024-03-04:alhpa-beta-stake-sale-update", "news:ABC:2024-03-04:stake?src=app&v=2-alpha-beta", "news:ABC.NS.NS:2024-03-04:alpha-beta-stake-sale", "news:abc-eq.bo:2024-03-04:alpha-beta-stake-sale", "news:ABC.NS-EQ:2024-03-04:alpha-beta-stake-sale", "newsss:ABC-EQ-EQ:2024-03-04:alpha-beta-stake-sale"]
OTHER_KEYS = ["filing:ABC:2024-03-04:alpha-beta-stake-sale", "news:ABD:2024-03-04:alpha-beta-stake-sale", "news:ABC:2024-03-05:alpha-beta-stake-sale", "news:ABC:2024-03-04:gamma-delta-launch", "", " ", None]


@pytest.mark.parametrize("key", SAME_KEYS[1:])
def test_same_item(spark, key):
    assert [tuple(r) for r in H.known_before(events(spark, (1, SAME_KEYS[0], SHA), (2, key, SHA))).collect()] == [(1, 2)]


def test_other_items_and_missing(spark):
    rows = [(1, SAME_KEYS[0], SHA)] + [(2, k, SHA) for k in OTHER_KEYS] + [(3, SAME_KEYS[0], h) for h in (None, "", "n/a", SHA[:-1] + "0")]
    assert H.known_before(events(spark, *rows)).count() == 0


@pytest.mark.parametrize("h", [SHA.upper(), f" {SHA} ", f'"{SHA}"', f"sha256:{SHA}", f"SHA-256={SHA.upper()}", f"0x{SHA}", "-".join(SHA[i : i + 8] for i in range(0, 64, 8))])
def test_same_digest(spark, h):
    assert H.known_before(events(spark, (1, SAME_KEYS[0], SHA), (1, SAME_KEYS[0], h))).count() == 1


def test_first_over_batches_and_chains(spark, rows):
    """The earliest of all is given, also over a chain of slips, across batches, and for copies in one batch."""
    ev = events(spark, (1, SAME_KEYS[8], SHA), (1, SAME_KEYS[8], SHA), (2, SAME_KEYS[0], SHA), (3, SAME_KEYS[10], SHA), (None, SAME_KEYS[9], SHA), (3, "odd key", SHA), (4, "Odd  KEY", SHA))
    assert rows(H.known_before(ev)) == [(1, 2), (1, 3), (1, 4), (1, 5), (6, 7)]
    assert H.known_before(ev.limit(0)).count() == 0


def test_very_long_key(spark):
    long = "news:ABC:2024-03-04:" + "-".join(f"word{i}" for i in range(2000))
    assert H.known_before(events(spark, (1, long, SHA), (2, long + "-amp", SHA))).count() == 1


def slips_of(rng, slug):
    w = slug.split()
    kind = rng.randrange(4)
    if kind == 0:
        w = w[-1:] + w[:-1]
    elif kind == 1 and len(w) > 3:
        w.pop()
    elif kind == 2:
        w.append("update")
    else:
        k = rng.randrange(len(w[0]) - 1)
        w[0] = w[0][:k] + w[0][k + 1] + w[0][k] + w[0][k + 2 :]
    return " ".join(w)


def names(rng, n):
    return " ".join("".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(n))


def test_shards_find_what_exhaustive_search_finds():
    """A hot block of many stories in 14 segments: recall of the tuned beam, and the number of shards after merging."""
    rng = random.Random(5)
    stories = [names(rng, 3) for _ in range(300)]
    slugs = [s if rng.random() < 0.4 else slips_of(rng, s) for s in (rng.choice(stories) for _ in range(1400))]
    slugs = list(dict.fromkeys(slugs))
    block = np.zeros(len(slugs), np.int64)
    points, ids = W.sketches(slugs, block), np.arange(len(slugs))
    shards, found = W.Shards(lambda i, j: H.same_slug(slugs[i], slugs[j])), set()
    for k, part in enumerate(np.array_split(ids, 14)):
        found |= {tuple(sorted(p)) for p in shards.add(points[part], block[part], part, k)}
    want = {(i, j) for i, j in itertools.combinations(range(len(slugs)), 2) if H.same_slug(slugs[i], slugs[j])}
    hit = {j for _, j in found}
    assert found <= want and len({j for _, j in want} & hit) >= 0.99 * len({j for _, j in want})
    assert len(shards.graphs) <= 5 and sum(len(g.points) for g in shards.graphs) == len(slugs)


def test_whole_blocks_are_compared_where_no_beam_suffices(monkeypatch):
    """With a recall no beam of 2 reaches, the first segment alone already gives every pair of the block."""
    monkeypatch.setattr(W, "BEAMS", (2,))
    rng = random.Random(6)
    slugs = list(dict.fromkeys(slips_of(rng, s) for s in [names(rng, 3) for _ in range(40)] for _ in range(6)))
    block, ids = np.zeros(len(slugs), np.int64), np.arange(len(slugs))
    shards = W.Shards(lambda i, j: H.same_slug(slugs[i], slugs[j]))
    found = {tuple(sorted(p)) for p in shards.add(W.sketches(slugs, block), block, ids, 0)}
    assert shards.beam is None
    assert found == {(i, j) for i, j in itertools.combinations(range(len(slugs)), 2) if H.same_slug(slugs[i], slugs[j])}


def test_search_goes_nowhere_without_an_entry():
    g = W.Graph(W.sketches(["a b", "a c"], np.array([1, 1])), np.array([1, 1]), np.array([0, 1]), (1, 1))
    assert g.entries(np.array([2, 1])).tolist()[0] == -1 and g.entries(np.array([1]))[0] in (0, 1)
    empty = W.Graph(W.sketches([], np.array([], np.int64)), np.array([], np.int64), np.array([], np.int64), (1, 1))
    assert empty.entries(np.array([1])).tolist() == [-1]


def test_corpus_against_brute_force(tables):
    e = tables("ingestion_events")
    rows = H.items(e).collect()
    blocks: dict = {}
    for r in rows:
        blocks.setdefault(r.block, []).append((r.event_id, r.slug))
    want = set()
    for v in blocks.values():
        parent = {i: i for i, _ in v}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for (i, a), (j, b) in itertools.combinations(v, 2):
            if H.same_slug(a, b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
        want |= {(root(i), i) for i, _ in v if root(i) != i}
    assert {tuple(r) for r in H.known_before(e).collect()} == want


def test_index_in_files_gives_what_one_pass_gives(spark, tables, tmp_path):
    """Ten batches added one after the other: the same pairs, few shards, none lost in merging."""
    from sarafa.llm.index import HistoryIndex

    e = tables("ingestion_events").filter("batch_no <= 10 OR batch_no IS NULL")
    last = e.agg({"event_id": "max"}).first()[0]
    index, got = HistoryIndex(spark, str(tmp_path / "index"), parts=4), set()
    for k in range(10):
        part = e.filter(f"event_id > {last * k // 10} AND event_id <= {last * (k + 1) // 10}")
        got |= {tuple(r) for r in index.add(part).collect()}
    want = {tuple(r) for r in H.known_before(e).collect()}
    firsts, wants = {}, {}
    for a, b in got:
        firsts[b] = a
    for a, b in want:
        wants[b] = a
    assert set(firsts) == set(wants) and sum(firsts[b] == wants[b] for b in wants) >= 0.99 * len(wants)
    assert [s["batches"] for s in index.live()] == [8, 2]


def test_index_with_an_empty_batch(spark, tmp_path):
    from sarafa.llm.index import HistoryIndex

    index = HistoryIndex(spark, str(tmp_path / "index"), parts=2)
    ev = events(spark, (1, SAME_KEYS[0], SHA), (2, SAME_KEYS[9], SHA))
    assert index.add(ev.limit(0)).count() == 0
    assert index.add(ev.filter("event_id = 1")).count() == 0
    assert [tuple(r) for r in index.add(ev.filter("event_id = 2")).collect()] == [(1, 2)]
