"""Queries of the text operators over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarafa.llm import canonical_values, history, index, mixing, near_dup, normal_form, splitting, tokens
from sarafa.llm.lineage import work_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that bring known items and content once more."""
    return history.known_before(_table(spark, sf_dir, "ingestion_events"))


def p2_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the newest batch brings once more, by the index in files that all earlier arrivals are in."""
    events = _table(spark, sf_dir, "ingestion_events")
    newest = events.agg(F.max("batch_no")).scalar()
    marked = events.withColumn("last", F.coalesce(F.col("batch_no") == newest, F.lit(False)))
    history = index.HistoryIndex(spark, work_path(spark, "history"))
    history.add(marked.filter("NOT last").drop("last"))
    return history.add(marked.filter("last").drop("last"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed symbols and sectors with the entries they mean."""
    return canonical_values.canonical_values(_table(spark, sf_dir, "sample_portfolio"), _table(spark, sf_dir, "ref_symbols"), _table(spark, sf_dir, "ref_sectors"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that had to be cut."""
    return splitting.oversized(_table(spark, sf_dir, "chunks"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks in pieces of at most 120 words."""
    return splitting.pieces(_table(spark, sf_dir, "chunks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of events whose titles share at least 0.6 of their words."""
    return near_dup.NearDuplicates(_table(spark, sf_dir, "ingestion_events"), "event_id", "title").pairs()


def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between classes of equal titles, each class named by its first event."""
    return near_dup.NearDuplicates(_table(spark, sf_dir, "ingestion_events"), "event_id", "title").class_links()


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the group of its title."""
    return near_dup.NearDuplicates(_table(spark, sf_dir, "ingestion_events"), "event_id", "title").groups()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents."""
    return tokens.token_ids(_table(spark, sf_dir, "documents"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is in the mixture."""
    return mixing.Mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets")).copies().select("doc_id", "n_tokens", "rate", "copies")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the mixture reaches."""
    return mixing.Mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets")).shares()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that look the same and are stored differently."""
    return normal_form.same_look_pairs(_table(spark, sf_dir, "documents"))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of differing stored texts that look the same, each named by its first document."""
    return normal_form.same_look_classes(_table(spark, sf_dir, "documents"))


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's normal form."""
    return normal_form.normal_forms(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "form")


QUERIES = {"p2_found": p2_found, "p2_latest": p2_latest, "p3_found": p3_found, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_found": p6_found, "p6_links": p6_links, "p6_groups": p6_groups, "p7_ids": p7_ids, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found, "p9_classes": p9_classes, "p9_forms": p9_forms}

_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

_WORDS = r"""
WITH w AS (SELECT event_id, list_sort(list_distinct(regexp_extract_all(lower(title), '[\p{L}\p{N}]+'))) AS ws FROM ingestion_events WHERE title IS NOT NULL),
c AS (SELECT ws, min(event_id) AS rep, len(ws) AS n FROM w WHERE len(ws) > 0 GROUP BY ws),
e AS (SELECT rep, n, unnest(ws) AS word FROM c),
s AS (SELECT a.rep AS x, b.rep AS y, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.word = b.word AND a.rep < b.rep GROUP BY ALL),
l AS (SELECT x, y FROM s WHERE k * 10 >= 6 * (na + nb - k))"""
_P2 = r"""
WITH k AS (SELECT event_id, trim(regexp_replace(item_key, '%3[aA]', ':', 'g')) AS key, nullif(regexp_extract(lower(regexp_replace(content_hash, '[^0-9A-Za-z]', '', 'g')), '([0-9a-f]{64})$', 1), '') AS sha FROM ingestion_events),
p AS (SELECT event_id, sha, key, regexp_extract(key, '^[\s"''\x{a0}]*([A-Za-z_]+)\s*(?:::|:|\||/)\s*([A-Za-z0-9&._-]+?)\s*(?:::|:|\||/)\s*([0-9]{4}[-/.]?[0-9]{2}[-/.]?[0-9]{2}|[0-9]{1,2}[-/. ][A-Za-z]{3,9}[-/. ][0-9]{4})\s*(?:::|:|\||/)\s*(.*)$', ['kind', 'symbol', 'day', 'slug']) AS m FROM k WHERE sha IS NOT NULL AND length(key) > 0),
n AS (SELECT event_id, sha, regexp_replace(lower(m.kind), 's+$', '') AS kind, regexp_replace(upper(m.symbol), '(\.(NS|BO)|-EQ)+$', '') AS symbol,
  CASE WHEN regexp_full_match(m.day, '[0-9]{4}.?[0-9]{2}.?[0-9]{2}') THEN regexp_replace(m.day, '[^0-9]', '', 'g') ELSE strftime(try_strptime(regexp_replace(m.day, '[-/.]', ' ', 'g'), '%d %b %Y'), '%Y%m%d') END AS day,
  list_sort(list_filter(regexp_split_to_array(regexp_replace(lower(CASE WHEN m.kind = '' THEN key ELSE m.slug END), '\?[a-z0-9_]+=[^-#/?]*|#[a-z0-9_]+|\.html?\b|%[0-9a-f]{2}', ' ', 'g'), '[^\p{L}\p{N}]+'), lambda w: w <> '' AND w NOT IN ('the', 'amp', 'update'))) AS ws FROM p),
d AS (SELECT DISTINCT *, array_to_string(ws, ' ') AS slug FROM n)
SELECT min(a.event_id) AS first_event_id, b.event_id FROM d a JOIN d b ON a.sha = b.sha AND a.kind = b.kind AND a.symbol = b.symbol AND a.day IS NOT DISTINCT FROM b.day AND a.event_id < b.event_id
WHERE a.slug = b.slug OR levenshtein(a.slug, b.slug) * 2 <= greatest(length(a.slug), length(b.slug)) OR len(list_intersect(a.ws, b.ws)) * 2 >= greatest(1, least(len(a.ws), len(b.ws))) GROUP BY b.event_id"""

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_LIKE = "".join(normal_form.LOOKALIKES), "".join(normal_form.LOOKALIKES.values())
_LOOK = (
    r"regexp_replace(regexp_replace(text, '([^\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}])\x{200D}', '\1', 'g'), '[\x{AD}\x{34F}\x{61C}\x{180B}-\x{180F}\x{200B}\x{200C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]', '', 'g')",
    r"regexp_replace({}, '[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', ' ', 'g')",
    "translate(nfc_normalize({}), '" + _WIDE.replace("'", "''") + _LIKE[0] + "‐‑', '" + "".join(chr(ord(c) - 0xFEE0) for c in _WIDE).replace("'", "''") + _LIKE[1] + "--')",
    "replace(replace(replace(replace(replace(replace({}, 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '…', '...')",
)
_FORM = "nfc_normalize(" + _LOOK[3].replace("{}", _LOOK[2].replace("{}", _LOOK[1].replace("{}", _LOOK[0], 1), 1), 1) + ")"
_P9 = f"WITH f AS (SELECT doc_id, text, {_FORM} AS form FROM documents WHERE text IS NOT NULL), g AS (SELECT * FROM f WHERE trim(form, ' ' || chr(9) || chr(10) || chr(13)) <> '')"

ORACLES = {
    "p2_found": _P2,
    "p2_latest": f"SELECT * FROM ({_P2}) WHERE event_id IN (SELECT event_id FROM ingestion_events WHERE batch_no = (SELECT max(batch_no) FROM ingestion_events))",
    "p9_found": _P9 + " SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM g a JOIN g b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id",
    "p9_classes": _P9 + ", c AS (SELECT form, text, min(doc_id) AS rep FROM g GROUP BY 1, 2) SELECT a.rep AS doc_id_a, b.rep AS doc_id_b FROM c a JOIN c b ON a.form = b.form AND a.rep < b.rep",
    "p6_links": _WORDS + " SELECT x AS event_id_a, y AS event_id_b FROM l",
    # A class is linked with few others, so walking its links ends soon.
    "p6_groups": _WORDS.replace("WITH w", "WITH RECURSIVE w")
    + r""",
nb AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l), reach AS (SELECT rep AS a, rep AS b FROM c UNION SELECT r.a, t.y FROM reach r JOIN nb t ON r.b = t.x),
root AS (SELECT a, min(b) AS g FROM reach GROUP BY a), deg AS (SELECT x, count(*) AS n FROM nb GROUP BY x)
SELECT w.event_id, c.rep AS class_id, g AS group_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links FROM w JOIN c ON w.ws = c.ws JOIN root ON root.a = c.rep LEFT JOIN deg ON deg.x = c.rep""",
    "p6_found": r"""
WITH w AS (SELECT DISTINCT event_id, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) AS word FROM ingestion_events WHERE trim(title) <> ''),
n AS (SELECT event_id, count(*) AS n FROM w GROUP BY 1),
s AS (SELECT a.event_id AS x, b.event_id AS y, count(*) AS k FROM w a JOIN w b ON a.word = b.word AND a.event_id < b.event_id GROUP BY 1, 2)
SELECT x AS event_id_a, y AS event_id_b FROM s JOIN n a ON a.event_id = x JOIN n b ON b.event_id = y WHERE k * 10 >= 6 * (a.n + b.n - k)""",
    "p5_found": rf"SELECT chunk_id FROM chunks WHERE len(list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda w: w <> '')) > 120",
}
