"""Stories of one feed: near-equal headlines by overlap of their words, in pairs and in greedy clusters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarafa.functions.rows import keep
from sarafa.functions.strings import title_tokens

# ---- fixed values ----
THRESHOLD, SHARED = 0.5, 2
# ---- end of fixed values ----


def similar_pairs(titles: DataFrame, block: list[str], threshold: float = THRESHOLD, shared: int = SHARED) -> DataFrame:
    """(block, id_a, id_b, n_shared, overlap) of the pairs in a block that share words enough: an inverted index on (block, word)."""
    t = keep(titles.select(*block, "id", title_tokens(F.col("title")).alias("tokens")), lambda r: F.size(r["tokens"]) > 0)
    p = t.select(*block, "id", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    a, b = p.withColumnsRenamed({"id": "id_a", "size": "size_a"}), p.withColumnsRenamed({"id": "id_b", "size": "size_b"})
    hit = a.join(b, [*block, "token"]).filter("id_a < id_b").groupBy(*block, "id_a", "id_b", "size_a", "size_b").agg(F.count("*").alias("n_shared"))
    return hit.withColumn("overlap", F.col("n_shared") / F.least("size_a", "size_b")).filter((F.col("n_shared") >= shared) & (F.col("overlap") >= threshold)).drop("size_a", "size_b")


def greedy(titles: DataFrame, block: str, threshold: float = THRESHOLD, shared: int = SHARED) -> DataFrame:
    """(block, id, cluster): in input order (ord, id) each headline joins the cluster it overlaps most, or opens one.

    A cluster is known by the words of its first headline; its number is that headline's place in the block. The
    rule depends on the order, so a block is read in order; rows stream through the task and only the clusters'
    words of the present block are held. Headlines without words open their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, heads, place = None, [], 0
        for batch in batches:
            blocks, ids, tokens, out = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), []
            for b, words in zip(blocks, tokens):
                if b != here:
                    here, heads, place = b, [], 0
                mine, best, at = set(words or ()), (0.0, 0), None
                for number, theirs in heads:
                    n = len(mine & theirs)
                    o = n / min(len(mine), len(theirs)) if mine and theirs else 0.0
                    if n >= shared and o >= threshold and o > best[0]:
                        best, at = (o, number), number
                if at is None:
                    at = place
                    heads.append((place, mine))
                out.append(at)
                place += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(out, pa.int32())], names=[block, "id", "cluster"])

    t = titles.select(F.col(block).cast("string").alias(block), "id", title_tokens(F.coalesce("title", F.lit(""))).alias("tokens"), "ord")
    kind = titles.schema["id"].dataType.simpleString()
    ordered = t.repartition(block).sortWithinPartitions(block, "ord", "id").drop("ord")
    return ordered.mapInArrow(run, f"{block} string, id {kind}, cluster int")


def representatives(clustered: DataFrame, block: str) -> DataFrame:
    """(block, cluster, id, n): the newest of each cluster, undated last, ties by id. clustered has block, cluster, id and published."""
    best = F.min_by("id", F.struct(F.col("published").isNull(), -F.unix_date("published"), "id"))
    return clustered.groupBy(block, "cluster").agg(best.alias("id"), F.count("*").alias("n"))
