"""The history index as files: add a batch, learn what it repeats, without touching older batches again.

The index is a set of shards, each a table (part, state) with one small-world graph per part. A batch is searched in
every live shard and becomes a shard of its own. As in a binary counter, a new shard and the newest ones that
stand for as many batches are merged into one, so that n batches leave about log n shards. Which shards live is
stated by a manifest that is written last: a job that dies leaves the index as it was.
"""

from __future__ import annotations

import json
import pickle
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarafa.llm.history import items, same_slug
from sarafa.llm.small_world import Graph, Shards, sketches
from sarafa.sources.sinks import latest

#: Parts of an index; each task holds the graphs of one part, so parts grow with the history expected.
PARTS = 64


class HistoryIndex:
    """An index in a folder that all executors share. Batches are added in the order of their event ids."""

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS) -> None:
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def live(self) -> list[dict]:
        """The live shards, oldest first: their folder and how many batches they stand for."""
        at = latest(self.spark, f"{self.path}/manifest")
        return json.loads(self.spark.read.text(at, wholetext=True).first().value)["shards"] if at else []

    def add(self, batch: DataFrame) -> DataFrame:
        """(first_event_id, event_id) of the batch's events that bring what this or an earlier batch brought.

        The batch's shard is part of the index when this returns. Events without key or digest give no row and are
        not kept; an empty batch adds an empty shard. Reading the result reads what was written, not the index.
        """
        shards = self.live()
        merge, size = [], 1
        while len(merge) < len(shards) and shards[-1 - len(merge)]["batches"] == size:
            merge.append(len(shards) - 1 - len(merge))
            size *= 2
        one = items(batch).withColumn("node", F.xxhash64("block", "slug"))
        nodes = one.groupBy("node", "block", "slug").agg(F.min("event_id").alias("first"), F.count("*").alias("n")).withColumn("part", F.pmod(F.xxhash64("block"), F.lit(self.parts)).cast("int"))
        kept = None
        for k, s in enumerate(shards):
            t = self.spark.read.parquet(f"{self.path}/{s['folder']}").filter("kind = 'shard'").select("part", F.lit(k).alias("shard"), "state")
            kept = t if kept is None else kept.unionByName(t)
        if kept is None:
            kept = self.spark.createDataFrame([], "part int, shard int, state binary")
        merged = sorted(merge)

        def run(key: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            return _add_part(int(key[0]), new, {int(r.shard): pickle.loads(r.state) for r in old.itertuples()}, merged)

        out = nodes.groupBy("part").cogroup(kept.groupBy("part")).applyInPandas(run, "part int, kind string, node bigint, origin bigint, state binary")
        folder = f"shard-{uuid.uuid4().hex}"
        out.write.parquet(f"{self.path}/{folder}")
        left = [s for k, s in enumerate(shards) if k not in merge] + [{"folder": folder, "batches": size}]
        text = self.spark.createDataFrame([(json.dumps({"shards": left}),)], "value string")
        text.coalesce(1).write.text(f"{self.path}/manifest/v={self._version():08d}")
        hit = self.spark.read.parquet(f"{self.path}/{folder}").filter("kind = 'hit'").select("node", "origin")
        return one.select("node", "event_id").join(hit, "node").filter("event_id > origin").select(F.col("origin").alias("first_event_id"), "event_id").distinct()

    def _version(self) -> int:
        at = latest(self.spark, f"{self.path}/manifest")
        return 1 + int(at.rsplit("v=", 1)[1]) if at else 1


def _add_part(part: int, new: pd.DataFrame, old: dict[int, dict], merge: list[int]) -> pd.DataFrame:
    """One part of one batch: hits of its nodes, and the state of the shard that it leaves.

    A state is {graph, slug, block, origin, node}: the graph's outside numbers are places in the other lists. Old
    states are those of the live shards; those to be merged go into the new one.
    """
    new = new.sort_values("first", kind="stable").reset_index(drop=True)
    slug = [s for k in sorted(old) for s in old[k]["slug"]] + new["slug"].tolist()
    base = sum(len(old[k]["slug"]) for k in old)
    cat = lambda name, mine: np.concatenate([*(old[k][name] for k in sorted(old)), mine]).astype(np.int64)
    block, node, origin = cat("block", new["block"].to_numpy()), cat("node", new["node"].to_numpy()), cat("origin", new["first"].to_numpy())
    shards, start = Shards(lambda i, j: block[i] == block[j] and same_slug(slug[i], slug[j])), 0
    shards.compact = lambda: None  # which shards are merged is the index's schedule, equal for all parts
    span = {}
    for k in sorted(old):
        span[k] = (start, start + len(old[k]["slug"]))
        g = old[k]["graph"]
        g.ids = g.ids - g.ids.min(initial=0) + start if len(g.ids) else g.ids
        shards.graphs.append(g)
        start = span[k][1]
    mine = np.arange(base, len(slug))
    points = sketches(slug[base:], block[base:])
    parent = {}

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for i, j in shards.add(points, block[base:], mine, 0) if len(mine) else []:
        x, y = root(i), root(j)
        parent[max(x, y)] = min(x, y)
    groups: dict[int, int] = {}
    for i in list(parent):
        groups[root(i)] = min(groups.get(root(i), int(origin[i])), int(origin[i]))
    found = origin.copy()
    for i in list(parent):
        found[i] = groups[root(i)]
    first, n = new["first"].to_numpy(), new["n"].to_numpy()
    tell = (n > 1) | (found[base:] < first)
    keep = [p for k in merge for p in range(*span.get(k, (0, 0)))] + mine.tolist()
    # A node that an old shard has already is not kept twice.
    known = set(node[:base].tolist())
    keep = np.array([p for p in keep if p < base or node[p] not in known], np.int64)
    graph = Graph(sketches([slug[p] for p in keep], block[keep]), block[keep], np.arange(len(keep)), (0, 0))
    state = {"graph": graph, "slug": [slug[p] for p in keep], "block": block[keep], "node": node[keep], "origin": found[keep]}
    rows = pd.DataFrame({"kind": "hit", "node": node[base:][tell], "origin": found[base:][tell], "state": None})
    shard = pd.DataFrame([{"kind": "shard", "node": None, "origin": None, "state": pickle.dumps(state)}])
    both = pd.concat([rows, shard], ignore_index=True)
    both["part"] = part
    return both[["part", "kind", "node", "origin", "state"]]

