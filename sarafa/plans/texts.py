"""Queries on the event log, on titles and on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sarafa.functions import dates, strings
from sarafa.operators import clusters as C
from sarafa.operators import eventlog as E
from sarafa.operators import portfolio as P
from sarafa.operators import retrieval as R
from sarafa.session import table
from sarafa.sources import sinks

TODAY = "2026-03-01"


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ingestion_events")


def q27_event_actions(s: SparkSession, d: str) -> DataFrame:
    """Each valid event as new, superseding or skipped."""
    return E.actions(_events(s, d)).select("event_id", "item_key", "action")


def q27_current_versions(s: SparkSession, d: str) -> DataFrame:
    """The current version of each key."""
    return E.current(_events(s, d))


def q27_quarantine(s: SparkSession, d: str) -> DataFrame:
    """Events that cannot be logged."""
    return E.split_valid(_events(s, d))[1].select("event_id", "reason")


def q28_event_freshness(s: SparkSession, d: str) -> DataFrame:
    """Age and freshness of current versions."""
    return E.fresh(_events(s, d), TODAY, 400).withColumn("age", F.col("age").cast("string"))


def q29_ingest_summary(s: SparkSession, d: str) -> DataFrame:
    """Counts of a run by kind."""
    return E.run_summary(_events(s, d), TODAY, "kind")


def q30_latest_per_source(s: SparkSession, d: str) -> DataFrame:
    """The most recently observed event of each source; the first of equals."""
    return _events(s, d).groupBy("source_id").agg(F.max_by("event_id", F.struct("observed_at", -F.col("event_id"))).alias("event_id"), F.max("observed_at").alias("observed_at"))


def q31_tokens_df(s: SparkSession, d: str) -> DataFrame:
    """Document frequency of every term."""
    return R.document_frequency(R.postings(table(s, d, "documents"), "doc_id"))


def q31_corpus_stats(s: SparkSession, d: str) -> DataFrame:
    """Number and mean length of the documents."""
    return P.rounded(R.corpus(table(s, d, "documents")), 6, "avg_len")


def _questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "numeric_records").select(F.col("figure").alias("query_id")).filter("figure IS NOT NULL").distinct().withColumn("text", F.replace("query_id", F.lit("_"), F.lit(" ")))


def q32_tfidf_topk(s: SparkSession, d: str) -> DataFrame:
    """The five chunks nearest to each figure's name by cosine."""
    return R.top(R.tfidf(table(s, d, "chunks"), _questions(s, d)).withColumn("cosine", F.round("cosine", 9)), "cosine")


def q33_bm25_topk(s: SparkSession, d: str) -> DataFrame:
    """The five best chunks by BM25."""
    return R.top(R.bm25(table(s, d, "chunks"), _questions(s, d)).withColumn("bm25", F.round("bm25", 9)), "bm25")


def q34_hybrid_topk_pins(s: SparkSession, d: str) -> DataFrame:
    """The mixture, with the chunks of primary sources' balance sheets pinned."""
    c = table(s, d, "chunks")
    reg = table(s, d, "source_registry").filter("tier = 'primary'").select("source_id")
    pins = c.filter("lower(section) = 'balance sheet'").join(reg, "source_id", "left_semi").select(F.col("chunk_id").alias("id"))
    return R.hybrid(c, _questions(s, d), pins).select("query_id", "id", F.round("score", 6).alias("score"), "is_pinned")


def q65_best_over_questions(s: SparkSession, d: str) -> DataFrame:
    """The 18 chunks that answer some question best."""
    return R.best_over_queries(R.tfidf(table(s, d, "chunks"), _questions(s, d)).withColumn("cosine", F.round("cosine", 9)), "cosine")


def q35_window_chunks(s: SparkSession, d: str) -> DataFrame:
    """Documents in windows of 120 words that overlap by 20."""
    return table(s, d, "documents").select("doc_id", F.posexplode(strings.windows(F.col("text"))).alias("piece", "words"))


def _titled(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d).filter("trim(title) <> ''")
    key = F.split("item_key", ":")
    return e.select(F.upper(F.trim(F.get(key, F.lit(1)))).alias("symbol"), F.trim(F.get(key, F.lit(2))).alias("day"), F.col("event_id").alias("id"), "title", F.col("event_id").alias("ord"), dates.any_date(F.col("as_of")).alias("published")).filter("symbol IS NOT NULL AND day IS NOT NULL")


def q36_near_dup_pairs(s: SparkSession, d: str) -> DataFrame:
    """Headlines of one company and day that tell one story."""
    return P.rounded(C.similar_pairs(_titled(s, d), ["symbol", "day"]), 9, "overlap")


def q37_near_dup_clusters(s: SparkSession, d: str) -> DataFrame:
    """Headlines of one company and day in greedy clusters."""
    t = _titled(s, d).withColumn("feed", F.concat_ws(":", "symbol", "day"))
    return C.greedy(t, "feed")


def q37_representatives(s: SparkSession, d: str) -> DataFrame:
    """The newest headline of each cluster."""
    t = _titled(s, d).withColumn("feed", F.concat_ws(":", "symbol", "day"))
    return C.representatives(C.greedy(t, "feed").join(t.select("id", "published"), "id"), "feed")


def q38_content_hash_dups(s: SparkSession, d: str) -> DataFrame:
    """Contents that several documents have."""
    x = table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", strings.content_hash(F.col("text")).alias("hash"))
    return x.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")


def q39_html_clean(s: SparkSession, d: str) -> DataFrame:
    """Documents wrapped in markup and cleaned again."""
    page = F.concat(F.lit("<p class='x'>"), F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("</p><br/>&nbsp;end"))
    return table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(strings.clean_html(page)).alias("clean"))


def q41_material_numbers(s: SparkSession, d: str) -> DataFrame:
    """Numbers in documents that a claim would have to prove."""
    return table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.array_join(strings.material_numbers(F.col("text")), " ").alias("numbers"))


def q43_source_tiers(s: SparkSession, d: str) -> DataFrame:
    """Chunks by the tier of their source, unregistered sources dropped."""
    reg = table(s, d, "source_registry").select("source_id", F.when(F.lower("tier") == "primary", 1).when(F.lower("tier") == "analyst", 2).when(F.lower("tier") == "creator", 3).alias("rank"))
    return table(s, d, "chunks").join(reg, "source_id").groupBy("rank").agg(F.count("*").alias("n_chunks"), F.count_distinct("source_id").alias("n_sources")).withColumn("citable", F.col("rank") == 1)


def q46_allwords_search(s: SparkSession, d: str) -> DataFrame:
    """Parts whose names hold all words of a search."""
    return table(s, d, "part").filter(strings.all_words(F.col("p_name"), "red-widget")).select("p_partkey", "p_name")


def q47_upsert(s: SparkSession, d: str) -> DataFrame:
    """Suppliers with the balances of an update put in and new ones added."""
    old = table(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = table(s, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"), F.col("c_acctbal").alias("s_acctbal"))
    return sinks.upserted(old, new, "s_suppkey")


def q48_dedup_sort_cap(s: SparkSession, d: str) -> DataFrame:
    """The eight newest distinct documents of each symbol."""
    x = table(s, d, "documents").filter("text IS NOT NULL AND symbol IS NOT NULL").select("symbol", "doc_id", strings.dedup_key(F.col("text")).alias("key"), dates.any_date(F.col("as_of")).alias("day")).filter("key IS NOT NULL")
    one = x.groupBy("symbol", "key").agg(F.min(F.struct("doc_id", "day")).alias("r")).select("symbol", "r.doc_id", "r.day")
    w = W.partitionBy("symbol").orderBy(F.desc_nulls_last("day"), "doc_id")
    return one.withColumn("rank", F.row_number().over(w)).filter("rank <= 8").withColumn("day", F.col("day").cast("string"))


def q49_props_json(s: SparkSession, d: str) -> DataFrame:
    """A number out of the events' JSON, summed."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(s, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("n"))


def q50_tumbling(s: SparkSession, d: str) -> DataFrame:
    """Events by hour and type (an extension)."""
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return table(s, d, "events").groupBy(F.date_format(w.start, "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def q50_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions of users with gaps of at most 30 minutes (an extension)."""
    w = F.session_window(F.col("ts").cast("timestamp"), "30 minutes")
    return table(s, d, "events").groupBy("user_id", w).agg(F.count("*").alias("n")).select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def q51_rollup_cube(s: SparkSession, d: str) -> DataFrame:
    """Quantities by flag and status at every level (an extension)."""
    return table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))


def q55_set_ops(s: SparkSession, d: str) -> DataFrame:
    """Nations with suppliers only, customers only, or both."""
    a = table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))
    b = table(s, d, "customer").select(F.col("c_nationkey").alias("k"))
    both = a.intersect(b).select("k", F.lit("both").alias("side"))
    return both.unionByName(a.subtract(b).select("k", F.lit("supplier").alias("side"))).unionByName(b.subtract(a).select("k", F.lit("customer").alias("side")))


QUERIES = {f.__name__: f for f in (q27_event_actions, q27_current_versions, q27_quarantine, q28_event_freshness, q29_ingest_summary, q30_latest_per_source, q31_tokens_df, q31_corpus_stats, q32_tfidf_topk, q33_bm25_topk, q34_hybrid_topk_pins, q65_best_over_questions, q35_window_chunks, q36_near_dup_pairs, q37_near_dup_clusters, q37_representatives, q38_content_hash_dups, q39_html_clean, q41_material_numbers, q43_source_tiers, q46_allwords_search, q47_upsert, q48_dedup_sort_cap, q49_props_json, q50_tumbling, q50_sessions, q51_rollup_cube, q55_set_ops)}

_DAY = """coalesce(CASE WHEN regexp_matches(trim(as_of), '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(left(trim(as_of), 10) AS DATE) END, CAST(try_strptime(trim(as_of), '%d-%b-%Y %H:%M:%S') AS DATE), CAST(try_strptime(trim(as_of), '%d-%b-%Y') AS DATE), CAST(try_strptime(trim(as_of), '%d %b %Y') AS DATE), CAST(try_strptime(trim(as_of), '%d/%m/%Y') AS DATE))"""
_VALID = "coalesce(trim(item_key) <> '' AND trim(content_hash) <> '', false)"
_ACTS = f"acts AS (SELECT *, CASE WHEN p IS NULL THEN 'new' WHEN p = content_hash THEN 'skipped' ELSE 'superseded' END AS action FROM (SELECT *, lag(content_hash) OVER (PARTITION BY item_key ORDER BY event_id) AS p FROM src WHERE {_VALID}))"
_LOG = "WITH src AS (SELECT * FROM ingestion_events), " + _ACTS
_CUR = _LOG + ", cur AS (SELECT item_key, arg_max(event_id, event_id) AS event_id, arg_max(content_hash, event_id) AS content_hash, max(struct_pack(e := event_id, a := as_of)).a AS as_of, count(*) AS n_versions FROM acts WHERE action <> 'skipped' GROUP BY 1)"


def _post(rel: str, key: str) -> str:
    return f"(SELECT id, term, len, count(*) AS n FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM (SELECT {key} AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM {rel})) GROUP BY ALL)"


_IR = f"""WITH questions AS (SELECT DISTINCT figure AS query_id, replace(figure, '_', ' ') AS text FROM numeric_records WHERE figure IS NOT NULL),
post AS {_post('chunks', 'chunk_id')}, qp AS {_post('questions', 'query_id')}, dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
st AS (SELECT count(*) AS nd, avg(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS al FROM chunks),
doc AS (SELECT id, p.term, n / len * (ln((1 + nd) / (1 + df)) + 1) AS w FROM post p JOIN dfs USING (term), st),
qw AS (SELECT id AS query_id, q.term, n / len * (ln((1 + nd) / (1 + coalesce(df, 0))) + 1) AS qw FROM qp q LEFT JOIN dfs USING (term), st),
nrm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM doc GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qnorm FROM qw GROUP BY 1),
cos AS (SELECT query_id, id, sum(w * qw) / any_value(norm * qnorm) AS cosine FROM doc JOIN qw USING (term) JOIN nrm USING (id) JOIN qn USING (query_id) GROUP BY 1, 2),
bm AS (SELECT q.id AS query_id, p.id, sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * p.n * 2.5 / (p.n + 1.5 * (0.25 + 0.75 * p.len / al))) AS bm25 FROM post p JOIN qp q ON p.term = q.term JOIN dfs ON dfs.term = p.term, st GROUP BY 1, 2)
"""
_TITLED = f"titled AS (SELECT upper(trim(split_part(item_key, ':', 2))) AS symbol, trim(split_part(item_key, ':', 3)) AS day, event_id AS id, list_filter(string_split(regexp_replace(regexp_replace(lower(title), '[''’]', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM ingestion_events WHERE trim(title) <> '' AND len(string_split(item_key, ':')) >= 3), toks AS (SELECT symbol, day, id, CASE WHEN len(list_filter(w, lambda x: NOT list_contains({list(strings.STOPWORDS)!r}, x))) > 0 THEN list_distinct(list_filter(w, lambda x: NOT list_contains({list(strings.STOPWORDS)!r}, x))) ELSE list_distinct(w) END AS t FROM titled)"

_FEEDS = "WITH RECURSIVE " + _TITLED + r""", o AS (SELECT symbol || ':' || day AS feed, id, t, CAST(row_number() OVER (PARTITION BY symbol || ':' || day ORDER BY id) - 1 AS INTEGER) AS place FROM toks),
r AS (SELECT feed, id, place, [{'n': place, 'w': t}] AS heads, place AS cluster FROM o WHERE place = 0
  UNION ALL SELECT feed, id, place, CASE WHEN best IS NULL THEN list_append(heads, {'n': place, 'w': t}) ELSE heads END, coalesce(best, place) FROM (
    SELECT o.feed, o.id, o.place, o.t, r.heads, list_sort(list_transform(list_filter(r.heads, lambda h: len(list_intersect(h.w, o.t)) >= 2 AND len(list_intersect(h.w, o.t)) * 2 >= least(len(h.w), len(o.t))), lambda h: {'o': -len(list_intersect(h.w, o.t)) / least(len(h.w), len(o.t)), 'n': h.n}))[1].n AS best FROM r JOIN o ON o.feed = r.feed AND o.place = r.place + 1))"""

ORACLES = {
    "q27_event_actions": _LOG + " SELECT event_id, item_key, action FROM acts",
    "q27_current_versions": _CUR + " SELECT * FROM cur",
    "q27_quarantine": f"SELECT event_id, CASE WHEN coalesce(trim(item_key), '') = '' THEN 'no key' ELSE 'no content' END AS reason FROM ingestion_events WHERE NOT {_VALID}",
    "q28_event_freshness": _CUR + f", a AS (SELECT item_key, event_id, date_diff('day', {_DAY}, DATE '{TODAY}') AS age FROM cur) SELECT item_key, event_id, CAST(age AS VARCHAR) AS age, CASE WHEN age IS NULL THEN 'unknown' WHEN age > 400 THEN 'stale' ELSE 'fresh' END AS verdict FROM a",
    "q29_ingest_summary": f"WITH e AS (SELECT *, {_DAY} AS dy FROM ingestion_events), f AS (SELECT *, coalesce(date_diff('day', dy, DATE '{TODAY}') > 120, false) AS old FROM e), src AS (SELECT * FROM f WHERE NOT old), {_ACTS}, g AS (SELECT kind, count(*) AS fetched, count(*) FILTER (WHERE old) AS old, count(*) FILTER (WHERE NOT old AND NOT {_VALID}) AS errors FROM f GROUP BY 1), h AS (SELECT kind, count(*) FILTER (WHERE action = 'new') AS n, count(*) FILTER (WHERE action = 'superseded') AS s, count(*) FILTER (WHERE action = 'skipped') AS k, count(*) FILTER (WHERE dy IS NULL) AS u FROM acts GROUP BY 1) SELECT g.kind, fetched, old, errors, coalesce(n, 0) AS new, coalesce(s, 0) AS superseded, coalesce(k, 0) AS skipped, coalesce(u, 0) AS undated, greatest(0, coalesce(n + s + k - u, 0)) AS recent FROM g LEFT JOIN h ON g.kind IS NOT DISTINCT FROM h.kind",
    "q30_latest_per_source": "SELECT source_id, event_id, observed_at FROM (SELECT source_id, event_id, observed_at, row_number() OVER (PARTITION BY source_id ORDER BY observed_at DESC, event_id) AS r FROM ingestion_events) WHERE r = 1",
    "q31_tokens_df": f"SELECT term, count(*) AS df FROM {_post('documents', 'doc_id')} GROUP BY 1",
    "q31_corpus_stats": "SELECT count(*) AS n_docs, round(avg(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))), 6) AS avg_len FROM documents",
    "q32_tfidf_topk": _IR + "SELECT * FROM (SELECT query_id, id, round(cosine, 9) AS cosine, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, id) AS INTEGER) AS rank FROM cos) WHERE rank <= 5",
    "q65_best_over_questions": _IR + "SELECT id, max(round(cosine, 9)) AS cosine FROM cos GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 18",
    "q33_bm25_topk": _IR + "SELECT * FROM (SELECT query_id, id, round(bm25, 9) AS bm25, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, id) AS INTEGER) AS rank FROM bm) WHERE rank <= 5",
    "q34_hybrid_topk_pins": _IR + """, pins AS (SELECT chunk_id AS id FROM chunks WHERE lower(section) = 'balance sheet' AND source_id IN (SELECT source_id FROM source_registry WHERE tier = 'primary')),
c AS (SELECT cos.query_id, cos.id, cosine, bm25, cos.id IN (SELECT id FROM pins) AS is_pinned FROM cos LEFT JOIN bm ON bm.query_id = cos.query_id AND bm.id = cos.id), k AS (SELECT * FROM c WHERE is_pinned OR cosine >= 0.1),
s AS (SELECT *, cosine + 0.5 * coalesce(bm25 / nullif(max(bm25) OVER (PARTITION BY query_id), 0), 0) AS score FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, is_pinned ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, is_pinned FROM r WHERE is_pinned OR rank <= 5""",
    "q35_window_chunks": r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> '') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(ceil((len(w) - 120) / 100.0), 0) AS BIGINT) + 1)) AS i FROM w WHERE len(w) > 0) SELECT doc_id, CAST(i AS INTEGER) AS piece, array_to_string(w[i * 100 + 1 : i * 100 + 120], ' ') AS words FROM s",
    "q36_near_dup_pairs": "WITH " + _TITLED + ", p AS (SELECT symbol, day, id, len(t) AS n, unnest(t) AS token FROM toks), h AS (SELECT a.symbol, a.day, a.id AS id_a, b.id AS id_b, least(a.n, b.n) AS m, count(*) AS n_shared FROM p a JOIN p b ON a.symbol = b.symbol AND a.day = b.day AND a.token = b.token AND a.id < b.id GROUP BY ALL) SELECT symbol, day, id_a, id_b, n_shared, round(n_shared / m, 9) AS overlap FROM h WHERE n_shared >= 2 AND n_shared / m >= 0.5",
    "q37_near_dup_clusters": _FEEDS + " SELECT feed, id, cluster FROM r",
    "q37_representatives": _FEEDS + f", d AS (SELECT r.*, (SELECT {_DAY} FROM ingestion_events WHERE event_id = r.id) AS dy FROM r) SELECT feed, cluster, arg_min(id, ROW(dy IS NULL, -epoch(dy), id)) AS id, count(*) AS n FROM d GROUP BY 1, 2",
    "q38_content_hash_dups": r"SELECT hash, min(doc_id) AS first_id, count(*) AS n FROM (SELECT doc_id, sha256(trim(regexp_replace(text, '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' ')) AS hash FROM documents WHERE text IS NOT NULL) GROUP BY 1 HAVING count(*) > 1",
    "q39_html_clean": r"SELECT doc_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace('<p class=''x''>' || replace(text, '&', '&amp;') || '</p><br/>&nbsp;end', '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '" + '"' + r"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' ')) AS clean FROM documents WHERE text IS NOT NULL",
    "q41_material_numbers": r"""WITH b AS (SELECT doc_id, regexp_replace(text, '\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\bFY\s?[0-9]{2,4}\b|\b(?:19|20)[0-9]{2}-[0-9]{2}\b', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(t, '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda x: regexp_replace(x, '[^0-9.]', '', 'g')), lambda x: length(replace(x, '.', '')) >= 3) AS a, list_transform(regexp_extract_all(t, '[0-9][0-9,]*(?:\.[0-9]+)?\s?(?:%|bps\b|crore|lakh|million|billion|x\b)'), lambda x: regexp_replace(x, '[^0-9.]', '', 'g')) AS b FROM b)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ' ') AS numbers FROM k""",
    "q43_source_tiers": "SELECT CASE lower(tier) WHEN 'primary' THEN 1 WHEN 'analyst' THEN 2 WHEN 'creator' THEN 3 END AS rank, count(*) AS n_chunks, count(DISTINCT c.source_id) AS n_sources, lower(tier) = 'primary' AS citable FROM chunks c JOIN source_registry r ON r.source_id = c.source_id GROUP BY 1, 4",
    "q46_allwords_search": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') AND contains(lower(p_name), 'widget')",
    "q47_upsert": "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal < 0",
    "q48_dedup_sort_cap": f"WITH x AS (SELECT symbol, doc_id, coalesce(nullif(left(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 80), ''), nullif(left(trim(lower(text), ' '), 80), '')) AS key, {_DAY} AS day FROM documents WHERE text IS NOT NULL AND symbol IS NOT NULL), o AS (SELECT symbol, key, arg_min(doc_id, doc_id) AS doc_id, min(struct_pack(d := doc_id, y := day)).y AS day FROM x WHERE key IS NOT NULL GROUP BY 1, 2), r AS (SELECT symbol, doc_id, CAST(day AS VARCHAR) AS day, CAST(row_number() OVER (PARTITION BY symbol ORDER BY day DESC NULLS LAST, doc_id) AS INTEGER) AS rank FROM o) SELECT * FROM r WHERE rank <= 8",
    "q49_props_json": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(json_extract_string(props, '$.k')) AS n FROM events GROUP BY 1",
    "q50_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "q50_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k",
    "q51_rollup_cube": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "q55_set_ops": "WITH a AS (SELECT DISTINCT s_nationkey AS k FROM supplier), b AS (SELECT DISTINCT c_nationkey AS k FROM customer) SELECT k, 'both' AS side FROM a WHERE k IN (SELECT k FROM b) UNION ALL SELECT k, 'supplier' FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'customer' FROM b WHERE k NOT IN (SELECT k FROM a)",
}
