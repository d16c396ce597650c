"""Lines of delimited text, parsed at least cost: clean lines load, the others say what is wrong.

A line is matched against the grammar of a delimited row by dynamic programming over its characters. The
states are the places a reader can be in (start of a field, in plain text, in quotes, after a closing
quote); each step reads a character at no cost, or deletes or inserts a quote or a delimiter at cost one. A
line whose cheapest parse costs nothing and whose fields have valid types loads. For every other line the edits
of the cheapest parse give the reason. Every line goes through the program, which follows one path where a line needs no edit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sarafa.functions.rows import keep

# ---- fixed values: the form of a line and of a number ----
FIELDS = 4
RUPEE = r"(?i)₹|rs\.?|inr"
DECIMAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
# ---- end of fixed values ----

START, PLAIN, QUOTED, CLOSED = range(4)


def cheapest(line: str, fields: int | None = None) -> tuple[int, list[str], list[str]]:
    """(cost, edits, fields) of the cheapest parse; fields: how many there must be, None for any number.

    With None, only quotes may be inserted or deleted: the cost is that of the quoting alone. Edits read like
    "insert quote at 7". Time is proportional to the line's length times the number of fields.
    """
    top = fields if fields is not None else 1
    keep = fields is not None
    # best[state, nth field]: (cost, edits as a linked list, field texts as a linked list, open field)
    best: dict[tuple[int, int], tuple[int, tuple | None, tuple | None, tuple | None]] = {(START, 1): (0, None, None, None)}

    def relax(to: dict, key: tuple[int, int], item: tuple) -> bool:
        if key not in to or item[0] < to[key][0]:
            to[key] = item
            return True
        return False

    def inserts(now: dict, at: int) -> None:
        """Insertions read nothing, so they are followed until nothing gets cheaper."""
        todo = list(now)
        while todo:
            key = todo.pop()
            (state, n), (cost, edits, done, open_) = key, now[key]
            steps = []
            if state == START:
                steps.append(((QUOTED, n), (cost + 1, (f"insert quote at {at}", edits), done, open_)))
            if state == QUOTED:
                steps.append(((CLOSED, n), (cost + 1, (f"insert quote at {at}", edits), done, open_)))
            if keep and state != QUOTED and n < top:
                steps.append(((START, n + 1), (cost + 1, (f"insert delimiter at {at}", edits), (open_, done), None)))
            todo += [k for k, item in steps if relax(now, k, item)]

    inserts(best, 0)
    for i, c in enumerate(line):
        after: dict = {}
        for (state, n), (cost, edits, done, open_) in best.items():
            if c == '"':
                if state == START:
                    relax(after, (QUOTED, n), (cost, edits, done, open_))
                elif state == QUOTED:
                    relax(after, (CLOSED, n), (cost, edits, done, open_))
                elif state == CLOSED:
                    relax(after, (QUOTED, n), (cost, edits, done, (c, open_)))
                relax(after, (state, n), (cost + 1, (f"delete quote at {i}", edits), done, open_))
            elif c == "," and state != QUOTED:
                if not keep or n < top:
                    relax(after, (START, n + 1 if keep else n), (cost, edits, (open_, done), None))
                if keep:
                    relax(after, (state, n), (cost + 1, (f"delete delimiter at {i}", edits), done, open_))
            elif state == QUOTED:
                relax(after, (QUOTED, n), (cost, edits, done, (c, open_)))
            elif state in (START, PLAIN):
                relax(after, (PLAIN, n), (cost, edits, done, (c, open_)))
        inserts(after, i + 1)
        best = after
    ends = [(v[0], k, v) for k, v in best.items() if k[0] != QUOTED and (not keep or k[1] == top)]
    if not ends:
        return len(line) + 1, ["no parse"], []
    cost, _, (_, edits, done, open_) = min(ends, key=lambda x: (x[0], x[1]))
    return cost, _unlink(edits)[::-1], [_text(x) for x in [*_unlink(done)[::-1], open_]]


def _unlink(chain: tuple | None) -> list:
    out = []
    while chain is not None:
        out.append(chain[0])
        chain = chain[1]
    return out


def _text(chain: tuple | None) -> str:
    return "".join(_unlink(chain)[::-1])


def parsed(line: str) -> tuple[int, int, str, list[str] | None]:
    """(cost of the quoting, cost with the fields, edits, cells of a parse that costs nothing).

    A line that needs no edit is followed by the program's one path of cost nothing; the other paths are opened only
    where that path ends.
    """
    cells = free(line)
    if cells is not None and len(cells) == FIELDS:
        return 0, 0, "", cells
    cost, edits, _ = cheapest(line, FIELDS)
    return 0 if cells is not None else cheapest(line)[0], cost, "; ".join(edits), None


def free(line: str) -> list[str] | None:
    """The fields of a parse that costs nothing, None where there is none: the program's states without its edits.

    Without edits each state has one way to go on, so the characters between two marks are taken at once.
    """
    cells, at, end = [], 0, len(line)
    while True:
        if at < end and line[at] == '"':
            cell, at = [], at + 1
            while True:
                shut = line.find('"', at)
                if shut < 0:
                    return None
                cell.append(line[at:shut])
                at = shut + 1
                if at >= end or line[at] != '"':
                    break
                cell.append('"')
                at += 1
            cells.append("".join(cell))
            if at < end and line[at] != ",":
                return None
        else:
            comma = line.find(",", at)
            comma = end if comma < 0 else comma
            if line.find('"', at, comma) >= 0:
                return None
            cells.append(line[at:comma])
            at = comma
        if at >= end:
            return cells
        at += 1


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line_id, line) -> the costs and edits of the cheapest parse, and the cells of a parse that costs nothing."""
    for batch in batches:
        found = [parsed(x) for x in batch.column(1).to_pylist()]
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()))
        columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["line_id", "quote_cost", "cost", "edits", "cells"])


def number(text: Column) -> Column:
    """A field's number, NULL where it is none: rupee marks, commas and outer spaces aside it must be a finite decimal."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, RUPEE, ""), ",", ""), r"^[\s ]+|[\s ]+$", ""))
    d = F.when(bare.rlike(DECIMAL), bare.try_cast("double"))
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf")), d)


def parse(lines: DataFrame) -> DataFrame:
    """Every line but the headers: (line_id, symbol, quantity, avg_cost, sector, reason, edits).

    reason is NULL for a valid holding, else the first that applies of quoting, columns, quantity and avg_cost;
    edits tells how the cheapest parse would mend quoting and columns. A null line has no field at all and is
    reported as columns; so is an empty line. A final CR belongs to no field. A line whose line_no is null is
    taken as data. Repeated lines each give their row.
    """
    body = F.coalesce(F.regexp_replace("raw_line", r"\r$", ""), F.lit(""))
    rows = lines.filter("line_no IS NULL OR line_no > 1").select(F.col("line_id").cast("bigint").alias("line_id"), body.alias("line"))
    mended = rows.mapInArrow(_repairs, "line_id bigint, quote_cost int, cost int, edits string, cells array<string>")
    why = F.when(F.col("quote_cost") > 0, "quoting").when(F.col("cost") > 0, "columns")
    every = mended.select("line_id", "cells", why.alias("reason"), F.when(why.isNotNull(), F.col("edits")).alias("edits"))
    cell = [F.get("cells", F.lit(i)) for i in range(FIELDS)]
    typed = every.select("line_id", F.trim(cell[0]).alias("symbol"), number(cell[1]).alias("quantity"), number(cell[2]).alias("avg_cost"), F.when(F.col("reason").isNull(), F.coalesce(F.nullif(F.trim(cell[3]), F.lit("")), F.lit("Unknown"))).alias("sector"), "reason", "edits")
    bad_type = F.when(~F.coalesce(F.col("quantity") > 0, F.lit(False)), "quantity").when(~F.coalesce(F.col("avg_cost") >= 0, F.lit(False)), "avg_cost")
    return typed.withColumn("reason", F.coalesce("reason", bad_type))


def rejected(lines: DataFrame) -> DataFrame:
    """(line_id, reason) of the lines that are no valid holding."""
    return keep(parse(lines).select("line_id", "reason"), lambda r: r["reason"].isNotNull())


def loaded(lines: DataFrame) -> DataFrame:
    """(line_id, symbol, quantity, avg_cost, sector) of the lines that are."""
    return keep(parse(lines).drop("edits"), lambda r: r["reason"].isNull()).drop("reason")
