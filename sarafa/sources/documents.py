"""Documents, registries and statement tables of HTML pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarafa.functions import dates, strings

# ---- fixed values ----
TIERS = {"primary": 1, "analyst": 2, "creator": 3}
CRORE = 1e7
READABLE = ("txt", "md", "html", "htm")
# ---- end of fixed values ----


def read_registry(text: str) -> list[dict]:
    """Entries of a registry in YAML (tier: list of id, name, url, notes). Raises for a repeated id and an unknown tier."""
    out, tier, seen = [], None, set()
    for line in text.splitlines():
        line = re.sub(r"\s+#.*$|^#.*$", "", line).rstrip()
        if m := re.match(r"^(\w+):\s*(\[\])?$", line):
            tier = m[1]
            if tier not in TIERS:
                raise ValueError(f"unknown tier {tier}")
        elif m := re.match(r"^\s*(-\s+)?(\w+):\s*(.*)$", line):
            if m[1]:
                out.append({"tier": tier})
            out[-1][m[2]] = m[3].strip().strip("\"'")
            if m[2] == "id":
                if m[3] in seen:
                    raise ValueError(f"repeated id {m[3]}")
                seen.add(m[3])
    return out


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, tier, rank, name, url, notes) of a registry file; a small dimension."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    rows = [(e["id"], e["tier"], TIERS[e["tier"]], e.get("name"), e.get("url"), e.get("notes")) for e in read_registry(text)]
    return spark.createDataFrame(rows, "source_id string, tier string, rank int, name string, url string, notes string")


def library(spark: SparkSession, folder: str, registered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((source_id, text) of registered readable files, (path, why) of the others)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    f = files.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("source_id"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("form"), F.decode("content", "UTF-8").alias("body"))
    known = f.join(registered.select("source_id"), "source_id", "left_semi")
    text = F.when(F.col("form").startswith("htm"), strings.clean_html(F.col("body"))).otherwise(F.col("body"))
    good = known.filter(F.col("form").isin(*READABLE)).select("source_id", text.alias("text")).filter("trim(text) <> ''")
    skipped = f.join(registered.select("source_id"), "source_id", "left_anti").select("path", F.lit("not registered").alias("why"))
    failed = known.filter(~F.col("form").isin(*READABLE) | (F.coalesce(F.trim("body"), F.lit("")) == "")).select("path", F.lit("unreadable").alias("why"))
    return good, skipped.unionByName(failed)


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.open = 0
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open += 1
            self.tables.append([])
        elif tag == "tr" and self.open:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.open and self.tables[-1]:
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.open:
            self.open -= 1
        elif tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).replace("\xa0", " ").split()))
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def html_cells(pages: DataFrame, id_column: str = "symbol", html_column: str = "html") -> DataFrame:
    """(id, table_no, row_no, col_no, label, period, value): the tables of pages with periods in the first row, one row per cell.

    Labels lose a trailing "+"; cells that are no numbers have a NULL value; pages without tables give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parser = _Tables()
                parser.feed(page or "")
                for t, table in enumerate(parser.tables):
                    head = table[0] if table else []
                    for r, cells in enumerate(table[1:]):
                        rows += [(i, t, r, k, cells[0].rstrip("+ ").strip(), p, c) for k, (p, c) in enumerate(zip(head[1:], cells[1:]))]
            types = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(types)], names=["id", "table_no", "row_no", "col_no", "label", "period", "cell"])

    kind = pages.schema[id_column].dataType.simpleString()
    cells = pages.select(F.col(id_column).alias("id"), F.col(html_column).cast("string")).mapInArrow(run, f"id {kind}, table_no int, row_no int, col_no int, label string, period string, cell string")
    number = F.regexp_replace("cell", "[,%]", "").try_cast("double")
    return cells.select("id", "table_no", "row_no", "col_no", "label", "period", F.when(~F.isnan(number), number).alias("value"))


def annual(cells: DataFrame) -> DataFrame:
    """(id, table_no) of the tables by year: at least two years among their periods, and no two month names.

    A quarterly table has the labels of an annual one, but its periods go through the months.
    """
    month = F.nullif(F.lower(F.regexp_extract("period", r"(?i)\b([a-z]{3})[a-z]*\.?\s+[0-9]{4}", 1)), F.lit(""))
    n = cells.groupBy("id", "table_no").agg(F.count_distinct(dates.first_year(F.col("period"))).alias("years"), F.count_distinct(month).alias("months"))
    return n.filter("years >= 2 AND months <= 1").select("id", "table_no")


def yearly(cells: DataFrame, label: str, figure: str, factor: float = CRORE) -> DataFrame:
    """(entity, figure, fy, value) of the first row whose label is or begins with the given one, in annual tables."""
    c = cells.withColumn("fy", dates.first_year(F.col("period"))).filter("fy IS NOT NULL")
    hit = c.filter(F.lower("label").startswith(label.lower())).join(annual(cells), ["id", "table_no"], "left_semi")
    first = hit.groupBy("id").agg(F.min(F.struct("table_no", "row_no")).alias("at")).select("id", "at.*")
    return hit.join(first, ["id", "table_no", "row_no"], "left_semi").filter("value IS NOT NULL").select(F.col("id").alias("entity"), F.lit(figure).alias("figure"), "fy", (F.col("value") * factor).alias("value"))


def holding_series(cells: DataFrame) -> DataFrame:
    """(entity, ord, period, value): the promoters' row of the first table that has rows of promoters and of the public, in column order."""
    begins = lambda word: F.lower("label").startswith(word)
    both = cells.groupBy("id", "table_no").agg(F.bool_or(begins("promoters")).alias("p"), F.bool_or(begins("public")).alias("q")).filter("p AND q").groupBy("id").agg(F.min("table_no").alias("table_no"))
    hit = cells.filter(begins("promoters")).join(both, ["id", "table_no"], "left_semi")
    first = hit.groupBy("id").agg(F.min("row_no").alias("row_no"))
    return hit.join(first, ["id", "row_no"], "left_semi").filter("value IS NOT NULL").select(F.col("id").alias("entity"), F.col("col_no").alias("ord"), F.trim("period").alias("period"), "value")


def cash_cycle(cells: DataFrame) -> DataFrame:
    """(entity, figure, fy, value) in days; negative where suppliers fund the business."""
    return yearly(cells, "cash conversion cycle", "cash_cycle_days", 1.0)


def searchable(companies: DataFrame, name_column: str = "company_name") -> DataFrame:
    """The companies that may be searched for in news: those with a name, never a bare ticker."""
    return companies.filter(F.coalesce(F.trim(name_column), F.lit("")) != "")


def added(a: DataFrame, b: DataFrame, figure: str) -> DataFrame:
    """The sum of two figures in the years that have both: capital and reserves, profit and interest."""
    return a.withColumnRenamed("value", "x").drop("figure").join(b.withColumnRenamed("value", "y").drop("figure"), ["entity", "fy"]).select("entity", F.lit(figure).alias("figure"), "fy", (F.col("x") + F.col("y")).alias("value"))


def pledge(pages: DataFrame, text_column: str = "text") -> DataFrame:
    """pages with pledged_pct: "promoters have pledged N%"; NULL where nothing is stated, never 0."""
    return pages.withColumn("pledged_pct", F.nullif(F.regexp_extract(text_column, r"(?i)promoters? ha(?:ve|s) pledged\s+([0-9]+(?:\.[0-9]+)?)\s*%", 1), F.lit("")).try_cast("double"))
