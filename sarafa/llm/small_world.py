"""Navigable small-world graphs over bit sketches, built and searched for many points at once.

A shard is one graph over the items of one segment of history. Each node has short links, to the nearest nodes that
a beam search found when it was put in, and long links, to nodes anywhere in the shard. A search walks a beam from
an entry node: the first node of the item's block if the shard has one (a block agrees in everything that must
agree exactly), which is how searches that cannot succeed end at once. Shards of like size are merged on a
schedule, so that n segments leave about log n graphs to search.
"""

from __future__ import annotations

import numpy as np

#: Long links of a node; short links of a node; 64-bit words of a sketch.
LONG, SHORT, WIDTH = 2, 8, 5
#: Beams tried in turn until a search agrees with the exhaustive one, and the recall they must reach; beyond the widest
#: one whole blocks are compared.
BEAMS, RECALL = (8, 16, 32, 64, 128), 0.999
#: Queries compared with exhaustive search when a beam is tuned.
TUNED_ON = 256


def sketches(slugs: list[str], blocks: np.ndarray) -> np.ndarray:
    """(n, WIDTH) words: one of the block, the others a bitmap of the slug's three-letter runs."""
    n = len(slugs)
    out = np.zeros((n, WIDTH), np.uint64)
    if not n:
        return out
    if n > 20_000:  # a bitmap of bytes is made on the way
        return np.concatenate([sketches(slugs[a : a + 20_000], blocks[a : a + 20_000]) for a in range(0, n, 20_000)])
    out[:, 0] = blocks.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    raw = [f"  {s}  ".encode() for s in slugs]
    size = np.array([len(r) for r in raw])
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    gram = flat[:-2] | (flat[1:-1] << np.uint64(8)) | (flat[2:] << np.uint64(16))
    owner = np.repeat(np.arange(n), size)
    inside = owner[:-2] == owner[2:]
    h = gram[inside] * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    place = (h >> np.uint64(56)).astype(np.int64)
    bitmap = np.zeros((n, 256), bool)
    bitmap[owner[:-2][inside], place] = True
    out[:, 1:] = np.packbits(bitmap, axis=1).view(np.uint64)
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits along the last axis."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


class Graph:
    """One shard: sketches, links and the first node of every block."""

    def __init__(self, points: np.ndarray, blocks: np.ndarray, ids: np.ndarray, segments: tuple[int, int], seed: int = 1) -> None:
        """points, blocks, ids: sketch, block and outside number of each node; segments: first and last in it."""
        self.points, self.ids, self.segments = points, ids, segments
        order = np.argsort(blocks, kind="stable")
        self.blocks, self.order = blocks[order], order
        n = len(points)
        rng = np.random.default_rng(seed)
        self.links = np.full((n, SHORT + LONG), -1, np.int32)
        if n:
            self.links[:, SHORT:] = rng.integers(0, n, (n, LONG))
            self._put_in()

    def entries(self, blocks: np.ndarray) -> np.ndarray:
        """The node where a search for each block starts, -1 where the shard has nothing of it."""
        at = np.searchsorted(self.blocks, blocks)
        ok = (at < len(self.blocks)) & (self.blocks[np.minimum(at, len(self.blocks) - 1)] == blocks) if len(self.blocks) else np.zeros(len(blocks), bool)
        return np.where(ok, self.order[np.minimum(at, max(len(self.order) - 1, 0))] if len(self.order) else -1, -1)

    def _put_in(self) -> None:
        """Puts the second and later nodes of each block in by beam search, in rounds of doubling size."""
        start = np.flatnonzero(np.r_[True, self.blocks[1:] != self.blocks[:-1]])
        size = np.diff(np.r_[start, len(self.blocks)])
        rank = np.arange(len(self.blocks)) - np.repeat(start, size)
        first = np.repeat(self.order[start], size)
        low = 1
        while low < size.max():
            new = np.flatnonzero((rank >= low) & (rank < 2 * low))
            nodes, entry = self.order[new], first[new]
            for a in range(0, len(nodes), 4096):
                part = nodes[a : a + 4096]
                near, dist = self.search(self.points[part], entry[a : a + 4096], 16)
                near = np.where(near == part[:, None], -1, near)[:, :SHORT]
                self.links[part, : near.shape[1]] = near
                self._link_back(part, near)
            low *= 2

    def _link_back(self, nodes: np.ndarray, near: np.ndarray) -> None:
        """Links found nodes to the new ones; where a node's places are taken, the farthest makes way for a nearer one."""
        to, frm = near.ravel(), np.repeat(nodes, near.shape[1])
        keep = to >= 0
        for t, f in zip(to[keep].tolist(), frm[keep].tolist()):
            row = self.links[t, :SHORT]
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]] = f
            else:
                d = distance(self.points[row], self.points[t])
                # The first place is never given up: it keeps the way to the rest of the block open.
                far = 1 + int(np.argmax(d[1:]))
                if distance(self.points[f], self.points[t]) < d[far]:
                    row[far] = f

    def search(self, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, distances), each (n, beam), nearest first; -1 where a beam is not full. Entries are valid nodes."""
        n = len(queries)
        nodes = np.full((n, beam), -1, np.int32)
        dist = np.full((n, beam), 1 << 20, np.int32)
        done = np.ones((n, beam), bool)
        nodes[:, 0], dist[:, 0], done[:, 0] = entry, distance(queries, self.points[entry]), False
        live = np.arange(n)
        while len(live):
            d = np.where(done[live], 1 << 20, dist[live])
            at = d.argmin(1)
            going = d[np.arange(len(live)), at] < 1 << 20
            live, at = live[going], at[going]
            if not len(live):
                break
            done[live, at] = True
            new = self.links[nodes[live, at]]
            known = (new[:, :, None] == nodes[live][:, None, :]).any(2) | (new < 0)
            # A node linked twice from one place counts once.
            twice = np.tril(new[:, :, None] == new[:, None, :], -1).any(2)
            nd = np.where(known | twice, 1 << 20, distance(queries[live][:, None, :], self.points[new]))
            all_n, all_d = np.concatenate([nodes[live], new], 1), np.concatenate([dist[live], nd], 1)
            all_f = np.concatenate([done[live], nd >= 1 << 20], 1)
            best = np.argsort(all_d, 1, kind="stable")[:, :beam]
            rows = np.arange(len(live))[:, None]
            nodes[live], dist[live], done[live] = np.where(all_d[rows, best] < 1 << 20, all_n[rows, best], -1), all_d[rows, best], all_f[rows, best]
        return nodes, dist

    def members(self, block: int) -> np.ndarray:
        """All nodes of a block: what an exhaustive search looks at."""
        a, b = np.searchsorted(self.blocks, [block, block + 1] if block < np.iinfo(np.int64).max else [block, block], side="left")
        return self.order[a:b]


class Shards:
    """The shards of one part of the index: add segments in order, search all of them, merge on schedule."""

    def __init__(self, same) -> None:
        """same(i, j): the exact test whether two outside numbers are one item."""
        self.same, self.graphs, self.beam = same, [], BEAMS[0]

    def find(self, points: np.ndarray, blocks: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
        """(query, found) outside numbers of the same items, by beam search in every shard and an exact reranking.

        Where tuning left no beam that reaches the recall (beam is None), whole blocks are compared instead.
        """
        out: list[tuple[int, int]] = []
        for graph in self.graphs:
            entry = graph.entries(blocks)
            hit = np.flatnonzero(entry >= 0)
            for a in range(0, len(hit), 4096):
                part = hit[a : a + 4096]
                for q, k in self._candidates(graph, points, blocks, entry, part):
                    i, j = int(ids[q]), int(graph.ids[k])
                    if i != j and self.same(i, j):
                        out.append((i, j))
        return out

    def _candidates(self, graph: Graph, points: np.ndarray, blocks: np.ndarray, entry: np.ndarray, part: np.ndarray):
        if self.beam is None:
            for q in part:
                yield from ((int(q), int(m)) for m in graph.members(int(blocks[q])))
            return
        near, _ = graph.search(points[part], entry[part], self.beam)
        agree = (near >= 0) & (graph.points[np.maximum(near, 0), 0] == points[part][:, None, 0])
        for q, k in zip(*np.nonzero(agree)):
            yield int(part[q]), int(near[q, k])

    def tune(self, points: np.ndarray, blocks: np.ndarray, ids: np.ndarray) -> None:
        """Widens the beam until it finds for a sample of queries what comparing with the whole block finds.

        What counts is whether a query finds another one of its items at all: the finds are joined to groups
        afterwards. A block holds all that can match, so comparing with it is the exhaustive search of all history.
        """
        for graph in self.graphs:
            if self.beam is None:
                return
            entry = graph.entries(blocks)
            hit = np.flatnonzero(entry >= 0)
            if not len(hit):
                continue
            # Items of the fullest blocks are the hard ones; half of the sample is taken from them.
            crowd = np.searchsorted(graph.blocks, blocks[hit], side="right") - np.searchsorted(graph.blocks, blocks[hit], side="left")
            full = hit[np.argsort(-crowd, kind="stable")[: TUNED_ON // 2]]
            hit = np.union1d(full, hit[np.linspace(0, len(hit) - 1, min(TUNED_ON // 2, len(hit))).astype(int)])
            known = lambda q, m: m >= 0 and int(graph.ids[m]) != int(ids[q]) and self.same(int(ids[q]), int(graph.ids[m]))  # noqa: B023, E731
            truth = [any(known(q, m) for m in graph.members(int(blocks[q]))) for q in hit]
            if not any(truth):
                continue
            while True:
                near, _ = graph.search(points[hit], entry[hit], self.beam)
                if sum(t and any(known(q, m) for m in row) for q, t, row in zip(hit, truth, near)) >= RECALL * sum(truth):
                    break
                at = BEAMS.index(self.beam) + 1
                self.beam = BEAMS[at] if at < len(BEAMS) else None
                if self.beam is None:
                    break

    def add(self, points: np.ndarray, blocks: np.ndarray, ids: np.ndarray, segment: int) -> list[tuple[int, int]]:
        """A new segment: its items are looked for in the shards there are and in its own, which then joins them."""
        if not len(points):
            return []
        self.graphs.append(Graph(points, blocks, ids, (segment, segment), seed=segment + 1))
        self.tune(points, blocks, ids)
        out = self.find(points, blocks, ids)
        self.compact()
        return out

    def compact(self) -> None:
        """Merges the newest shard with the one before it while that is not more than twice as large."""
        while len(self.graphs) > 1 and len(self.graphs[-2].points) <= 2 * len(self.graphs[-1].points):
            b, a = self.graphs.pop(), self.graphs.pop()
            blocks = [g.blocks[np.argsort(g.order)] for g in (a, b)]
            self.graphs.append(Graph(np.concatenate([a.points, b.points]), np.concatenate(blocks), np.concatenate([a.ids, b.ids]), (a.segments[0], b.segments[1])))
