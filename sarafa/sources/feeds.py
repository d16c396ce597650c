"""Feeds as text columns turned to rows: fund prices, announcements, news, report listings, event lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sarafa.functions import dates, strings

# ---- fixed values: record shapes ----
NSE = "array<struct<symbol:string,desc:string,attchmntFile:string,attchmntText:string,an_dt:string,sort_date:string>>"
BSE = "struct<Table:array<struct<SCRIP_CD:string,CATEGORYNAME:string,NEWSSUB:string,HEADLINE:string,NEWS_DT:string,ATTACHMENTNAME:string>>>"
NEWS = "array<struct<id:string,content:struct<title:string,summary:string,description:string,pubDate:string,provider:struct<displayName:string>,canonicalUrl:struct<url:string>>>>"
RSS = "struct<channel:struct<item:array<struct<title:string,link:string,pubDate:string,description:string,source:string>>>>"
LISTING = "struct<data:array<struct<fileName:string,toYr:string>>>"
EVENT = "item_key string, source_id string, content_hash string, as_of string, observed_at string, kind string, ref string, title string, cluster_id string"
RFC822_DAY = r"([0-9]{1,2} [A-Za-z]{3} [0-9]{4})"
# ---- end of fixed values ----


def _or(*cs: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs])


def nav_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(code, isin, name, nav, date) of lines code;isin;isin2;name;nav;date with a numeric code and a positive finite price."""
    f = F.split(column, ";")
    nav = F.trim(F.get(f, F.lit(4))).try_cast("double")
    rows = lines.filter(F.size(f) >= 6).select(F.trim(F.get(f, F.lit(0))).alias("code"), F.nullif(F.nullif(F.trim(F.get(f, F.lit(1))), F.lit("-")), F.lit("")).alias("isin"), F.trim(F.get(f, F.lit(3))).alias("name"), nav.alias("nav"), F.trim(F.get(f, F.lit(5))).alias("date"))
    return rows.filter(F.col("code").rlike("^[0-9]+$") & (F.col("nav") > 0) & (F.col("nav") < float("inf")) & ~F.isnan("nav"))


def nse_announcements(docs: DataFrame, column: str = "body") -> DataFrame:
    """(symbol, title, category, url, date) of the exchange's JSON, bare or under "data"; rows without title and category are skipped. Bad JSON gives none."""
    bare = F.coalesce(F.get_json_object(column, "$.data"), F.col(column))
    r = docs.select(F.explode(F.from_json(bare, NSE)).alias("r"))
    out = r.select("r.symbol", _or(F.col("r.attchmntText"), F.col("r.desc")).alias("title"), _or(F.col("r.desc")).alias("category"), F.col("r.attchmntFile").alias("url"), dates.any_date(_or(F.col("r.sort_date"), F.col("r.an_dt"))).alias("date"))
    return out.filter("title IS NOT NULL OR category IS NOT NULL")


def bse_announcements(docs: DataFrame, column: str = "body") -> DataFrame:
    """The same of the other exchange's {"Table": [...]}."""
    r = docs.select(F.explode(F.from_json(column, BSE)["Table"]).alias("r"))
    out = r.select(F.col("r.SCRIP_CD").alias("symbol"), _or(F.col("r.NEWSSUB"), F.col("r.HEADLINE")).alias("title"), _or(F.col("r.CATEGORYNAME")).alias("category"), F.col("r.ATTACHMENTNAME").alias("url"), dates.any_date(F.col("r.NEWS_DT")).alias("date"))
    return out.filter("title IS NOT NULL OR category IS NOT NULL")


def news_json(docs: DataFrame, column: str = "body") -> DataFrame:
    """(title, publisher, url, published, summary); items without title are skipped."""
    r = docs.select(F.explode(F.from_json(column, NEWS)).alias("r")).select("r.content.*")
    return r.select(F.trim("title").alias("title"), F.col("provider.displayName").alias("publisher"), F.col("canonicalUrl.url").alias("url"), dates.any_date(F.col("pubDate")).alias("published"), strings.clean_html(_or(F.col("summary"), F.col("description"))).alias("summary")).filter("title <> ''")


def news_rss(docs: DataFrame, column: str = "body") -> DataFrame:
    """(title, publisher, url, published, summary) of RSS items, with " - Publisher" cut off the title. Bad XML gives none."""
    r = docs.select(F.explode(F.from_xml(column, RSS)["channel"]["item"]).alias("r"))
    publisher = F.trim("r.source")
    cut = F.when(publisher.isNotNull() & F.endswith("r.title", F.concat(F.lit(" - "), publisher)), F.substring("r.title", F.lit(1), F.length("r.title") - F.length(publisher) - 3)).otherwise(F.col("r.title"))
    day = F.try_to_date(F.regexp_extract("r.pubDate", RFC822_DAY, 1), "d MMM yyyy")
    return r.select(F.trim(cut).alias("title"), publisher.alias("publisher"), F.col("r.link").alias("url"), F.coalesce(day, dates.any_date(F.col("r.pubDate"))).alias("published"), strings.clean_html(F.col("r.description")).alias("summary")).filter("title <> ''")


def newest_report(docs: DataFrame, column: str = "body", key: str = "symbol") -> DataFrame:
    """(key, url, fy, as_of): the report of the latest year among a listing's PDF files, dated 31 March."""
    r = docs.select(key, F.explode(F.from_json(column, LISTING)["data"]).alias("r")).select(key, F.col("r.fileName").alias("url"), dates.first_year(F.col("r.toYr")).alias("fy"))
    g = r.filter(F.lower("url").endswith(".pdf") & F.col("fy").isNotNull()).groupBy(key).agg(F.max_by("url", F.struct("fy", "url")).alias("url"), F.max("fy").alias("fy"))
    return g.withColumn("as_of", dates.fiscal_year_end(F.col("fy")))


def merge_news(*feeds: DataFrame) -> DataFrame:
    """All feeds, one item per title key: the first feed's, then the newest."""
    every = None
    for i, f in enumerate(feeds):
        f = f.withColumn("_feed", F.lit(i))
        every = f if every is None else every.unionByName(f)
    every = every.withColumn("_key", strings.dedup_key(F.col("title"))).filter("_key IS NOT NULL")
    rest = [c for c in feeds[0].columns]
    best = F.min(F.struct("_feed", F.struct(*[F.col(c) for c in rest]).alias("r")))
    return every.groupBy("_key").agg(best.alias("b")).select("b.r.*")


def not_stale(news: DataFrame, today: str, most_days: int = 365) -> DataFrame:
    """Undated items, and dated ones that are not older."""
    return news.filter(F.col("published").isNull() | (F.col("published") >= F.date_sub(F.to_date(F.lit(today)), most_days)))


def event_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events of JSON lines; lines that are no JSON or lack a key field are skipped."""
    e = lines.select(F.from_json(column, EVENT, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    return e.filter("item_key IS NOT NULL AND source_id IS NOT NULL AND content_hash IS NOT NULL")


def resolve_codes(symbols: DataFrame, seed: DataFrame, found: DataFrame) -> DataFrame:
    """(symbol, code): from the seed list (symbol, code), else from search results (symbol, ticker, code) whose ticker is exactly the symbol, else NULL."""
    exact = found.filter("upper(ticker) = upper(symbol)").groupBy("symbol").agg(F.min("code").alias("found"))
    return symbols.join(seed.withColumnRenamed("code", "seeded"), "symbol", "left").join(exact, "symbol", "left").select("symbol", F.coalesce("seeded", "found").alias("code"))
