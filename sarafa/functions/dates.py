"""Column functions for dates, fiscal years and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----
#: Forms tried after ISO, in order.
FORMS = ("d-MMM-yyyy HH:mm:ss", "d-MMM-yyyy", "d MMM yyyy", "dd/MM/yyyy")
RECENT_DAYS = 120
# ---- end of fixed values ----


def iso_date(c: Column) -> Column:
    """The date that the first ten characters state in ISO form; NULL if none."""
    head = F.substring(F.trim(c.cast("string")), 1, 10)
    return F.when(head.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def any_date(c: Column) -> Column:
    """A date in ISO form or one of the other forms; NULL if none fits."""
    s = F.trim(c.cast("string"))
    return F.coalesce(iso_date(s), *[F.try_to_date(s, f) for f in FORMS])


def age_days(as_of: Column, today: Column) -> Column:
    """Days from as_of to today; NULL for an unknown date."""
    return F.datediff(today, as_of)


def freshness(as_of: Column, today: Column, most: int) -> Column:
    """fresh, stale (strictly older than most days) or unknown."""
    return F.when(as_of.isNull(), "unknown").when(age_days(as_of, today) > most, "stale").otherwise("fresh")


def is_recent(as_of: Column, today: Column, most: int = RECENT_DAYS) -> Column:
    """Within most days, inclusive; the future counts as recent; NULL for an unknown date, which is neither."""
    return age_days(as_of, today) <= most


def period_tag(c: Column) -> Column:
    """FYyyyy as stated by FYnn or FYnnnn, else by "year ended", "as at", "as on" or "as of" a day of March, else by 31-03-yyyy; NULL if none."""
    tag = F.regexp_extract(c, r"(?i)\bFY\s?([0-9]{2,4})\b", 1)
    march = F.regexp_extract(c, r"(?i)(?:year ended|as at|as on|as of)\s+[0-9]{1,2}\s+(?:march|mar)\.?\s+([0-9]{4})", 1)
    dashed = F.regexp_extract(c, r"\b31[-/.]0?3[-/.]([0-9]{4})\b", 1)
    year = F.when(tag != "", F.when(F.length(tag) == 2, F.concat(F.lit("20"), tag)).otherwise(tag)).when(march != "", march).when(dashed != "", dashed)
    return F.concat(F.lit("FY"), year)


def first_year(c: Column) -> Column:
    """The first four digits in a row, as int; NULL if none."""
    return F.nullif(F.regexp_extract(c.cast("string"), "([0-9]{4})", 1), F.lit("")).try_cast("int")


def latest_year_stated(c: Column) -> Column:
    """The latest fiscal year a text states.

    Statements of a year's end in March are certain; only where there is none do the mentions FYnnnn, FYnn and 20nn-nn
    count, which may name a target. The whole text is read.
    """
    certain = (r"(?i)year\s+ended[^.]{0,40}?march[,\s]+.{0,6}?(20[0-9]{2})", r"(?i)march\s+31[,\s]+(20[0-9]{2})", r"(?i)31\s*(?:st)?\s*march[,\s]+(20[0-9]{2})")
    found = lambda pattern: F.regexp_extract_all(c, F.lit(pattern), 1)
    short = F.transform(F.concat(found(r"(?i)\bFY\s?'?([0-9]{2})\b"), found(r"20[0-9]{2}\s*[-/]\s*([0-9]{2})\b")), lambda y: F.concat(F.lit("20"), y))
    latest = lambda years: F.array_max(F.transform(years, lambda y: y.try_cast("int")))
    return F.coalesce(latest(F.concat(*map(found, certain))), latest(F.concat(found(r"(?i)\bFY\s?(20[0-9]{2})"), short)))


def fiscal_year(d: Column) -> Column:
    """The fiscal year (ending in March) of a date."""
    return F.year(d) + F.when(F.month(d) > 3, 1).otherwise(0)


def fiscal_year_end(fy: Column) -> Column:
    """31 March of a fiscal year."""
    return F.make_date(fy, F.lit(3), F.lit(31))


def period_order(c: Column) -> Column:
    """Year * 100 + month of "Mar 2024"; NULL if it has another form."""
    d = F.try_to_date(F.concat(F.lit("01 "), F.trim(c)), "dd MMM yyyy")
    return F.year(d) * 100 + F.month(d)
