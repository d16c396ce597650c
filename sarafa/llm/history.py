"""New batches of events checked for items and content that came before.

An event's key is taken apart into kind, symbol, date and headline slug, its hash into the SHA-256 digest it states,
however either is written. Distinct items are the points of an index: small-world graphs, one shard per batch,
merged on schedule. An item is looked for in every shard by beam search; the finds are reranked by an exact test
of the slugs. Kind, symbol, date and digest must agree exactly, so items are sent to the part of the index that
their common digest of these four names, and nothing is looked for elsewhere.

Equal items of many events are one point: they are reduced to their first event before anything is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sarafa.functions.rows import keep
from sarafa.llm.canonical_values import slips
from sarafa.llm.small_world import Shards, sketches

# ---- fixed values: how keys and hashes are written ----
SEPARATOR = r"\s*(?:::|:|\||/)\s*"
DATE = r"[0-9]{4}[-/.]?[0-9]{2}[-/.]?[0-9]{2}|[0-9]{1,2}[-/. ][A-Za-z]{3,9}[-/. ][0-9]{4}"
KEY = rf"^[\s\"'\x{{a0}}]*([A-Za-z_]+){SEPARATOR}([A-Za-z0-9&._-]+?){SEPARATOR}({DATE}){SEPARATOR}(.*)$"
DIGEST = r"([0-9a-f]{64})$"
EXCHANGE = r"(?:\.(?:NS|BO)|-EQ)+$"
#: What addresses add to a slug.
DECORATION = r"\?[a-z0-9_]+=[^-#/?]*|#[a-z0-9_]+|\.html?\b|%[0-9a-f]{2}"
# ---- end of fixed values ----

#: The part of a slug's letters that matching words must make up: of the longer slug, or of the shorter one.
SAME_LETTERS, SAME_SHORTER = 0.5, 0.8


def digest(c: Column) -> Column:
    """The 64 hexadecimal digits a hash states, whatever prefix, case, quotes or grouping it has; NULL if none."""
    bare = F.lower(F.regexp_replace(c.cast("string"), r"[^0-9A-Za-z]", ""))
    return F.nullif(F.regexp_extract(bare, DIGEST, 1), F.lit(""))


def items(events: DataFrame) -> DataFrame:
    """(event_id, batch_no, block, slug) of the events with key and hash; the others are no cases.

    block is a 64-bit digest of kind, symbol, date and content. A key of another form counts as a slug alone.
    """
    base = events.select("event_id", F.coalesce(F.col("batch_no"), F.lit(0)).alias("batch_no"), F.trim(F.regexp_replace(F.col("item_key").cast("string"), "%3[aA]", ":")).alias("key"), digest(F.col("content_hash")).alias("sha"))
    split = F.split(F.regexp_replace("key", KEY, "$1\u0001$2\u0001$3\u0001$4"), "\u0001")
    parts = keep(base, lambda r: r["sha"].isNotNull() & (F.length(r["key"]) > 0)).select("event_id", "batch_no", "sha", split.alias("p"))
    whole = F.size("p") == 4
    kind = F.regexp_replace(F.lower(F.get("p", F.lit(0))), "s+$", "")
    symbol = F.regexp_replace(F.upper(F.get("p", F.lit(1))), EXCHANGE, "")
    day = F.get("p", F.lit(2))
    compact = F.regexp_replace(day, "[^0-9A-Za-z]", "")
    date = F.when(compact.rlike("^[0-9]{8}$"), compact).otherwise(F.coalesce(F.date_format(F.try_to_timestamp(F.initcap(F.regexp_replace(day, "[-/.]", " ")), F.lit("d MMM yyyy")), "yyyyMMdd"), F.lower(day)))
    raw = F.lower(F.when(whole, F.get("p", F.lit(3))).otherwise(F.get("p", F.lit(0))))
    slug = F.trim(F.regexp_replace(F.regexp_replace(raw, DECORATION, " "), r"[^\p{L}\p{N}]+", " "))
    block = F.when(whole, F.xxhash64(kind, symbol, date, "sha")).otherwise(F.xxhash64(F.lit("other"), "sha"))
    return parts.select(F.col("event_id").cast("bigint").alias("event_id"), F.col("batch_no").cast("int").alias("batch_no"), block.alias("block"), slug.alias("slug"))


def same_slug(a: str, b: str) -> bool:
    """Whether two slugs differ by small slips: a word more, less or elsewhere, a letter wrong.

    Words are matched equal ones first, then those one slip apart (two in long words). The matched ones must make up
    half of the longer slug's letters, or nearly all of the shorter one's: what is compared already agrees in company,
    date and content. Numbers must be equal, unless one slug has none.
    """
    if a == b:
        return True
    left, right = a.split(), b.split()
    shorter, longer = sorted((sum(map(len, left)), sum(map(len, right))))
    if not left or not right:
        return False
    matched = 0
    for w in list(left):
        if w in right:
            left.remove(w)
            right.remove(w)
            matched += len(w)
    if any(w.isdigit() for w in left) and any(w.isdigit() for w in right):
        return False
    for w in list(left):
        near = next((x for x in right if len(w) > 2 and len(x) > 2 and not w.isdigit() and not x.isdigit() and slips(w, x, 2) <= (2 if min(len(w), len(x)) > 5 else 1)), None)
        if near is not None:
            right.remove(near)
            matched += max(len(w), len(near))
    return matched >= SAME_LETTERS * longer or matched >= SAME_SHORTER * shorter


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, block, slug, first, batch_no, n) of whole parts, -> (node, origin) of the nodes with anything to report."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows).sort_by([("batch_no", "ascending"), ("first", "ascending")])
    node, block, first, batch, count = (table.column(c).to_numpy() for c in ("node", "block", "first", "batch_no", "n"))
    slug = table.column("slug").to_pylist()
    points, ids = sketches(slug, block), np.arange(len(slug))
    parent = ids.tolist()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    shards = Shards(lambda i, j: block[i] == block[j] and same_slug(slug[i], slug[j]))
    edges = np.flatnonzero(np.r_[True, batch[1:] != batch[:-1]]).tolist() + [len(slug)]
    for a, b in zip(edges, edges[1:]):
        for i, j in shards.add(points[a:b], block[a:b], ids[a:b], int(batch[a])):
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
    origin = defaultdict(lambda: np.iinfo(np.int64).max)
    tops = [root(i) for i in range(len(slug))]
    for i, t in enumerate(tops):
        origin[t] = min(origin[t], int(first[i]))
    found = np.array([origin[t] for t in tops])
    tell = (count > 1) | (found < first)
    yield pa.RecordBatch.from_arrays([pa.array(node[tell]), pa.array(found[tell])], names=["node", "origin"])


def known_before(events: DataFrame) -> DataFrame:
    """(first_event_id, event_id): events that bring an item and content an event with a smaller id brought already.

    Events with a null or blank key or without a digest give no row; repeated rows with one event_id count as
    one event; an empty table gives an empty result; further columns are ignored. Events without a batch belong
    to the first one. Each item is compared with the shards of its part of the index only, and history is never
    compared with itself again.
    """
    one = items(events).withColumn("node", F.xxhash64("block", "slug"))
    points = one.groupBy("node", "block", "slug").agg(F.min("event_id").alias("first"), F.min("batch_no").alias("batch_no"), F.count("*").alias("n"))
    parts = points.repartition("block").select("node", "block", "slug", "first", "batch_no", "n")
    firsts = parts.mapInArrow(_firsts, "node bigint, origin bigint")
    return one.select("node", "event_id").join(firsts, "node").filter("event_id > origin").select(F.col("origin").alias("first_event_id"), "event_id").distinct()
