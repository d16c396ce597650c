"""Column functions for symbols, rupee amounts and their written forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----
CRORE, LAKH = 1e7, 1e5
RUPEE_TOKENS = r"(?i)₹|rs\.?|inr"
#: White space of any kind, no-break and zero-width included.
BLANK = r"[\s\u00a0\u2007\u202f\u3000\ufeff\u200b]"
# ---- end of fixed values ----


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def normalize_symbol(c: Column) -> Column:
    """Trimmed upper case; what follows the last colon; without .NS, then .BO, then -EQ. NULL stays NULL."""
    s = F.element_at(F.split(F.upper(strip(c)), ":"), -1)
    for suffix in (r"\.NS$", r"\.BO$", "-EQ$"):
        s = F.regexp_replace(s, suffix, "")
    return strip(s)


def quote_symbol(c: Column) -> Column:
    """The symbol a quote service knows: indexes (^...) and suffixed ones as they are, numbers .BO, the rest .NS."""
    s = F.upper(strip(c))
    return F.when(s.startswith("^") | s.endswith(".NS") | s.endswith(".BO"), s).when(s.rlike("^[0-9]+$"), F.concat(s, F.lit(".BO"))).otherwise(F.concat(s, F.lit(".NS")))


def amount(c: Column) -> Column:
    """A written amount as double: rupee tokens and commas dropped; NULL for anything that is no finite number."""
    bare = strip(F.regexp_replace(F.regexp_replace(c, RUPEE_TOKENS, ""), ",", ""))
    d = F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), bare.try_cast("double"))
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def indian_grouping(c: Column) -> Column:
    """A whole number with its last three digits and then pairs set apart: 1234567 as 12,34,567."""
    digits = F.abs(c.cast("bigint")).cast("string")
    head = F.regexp_replace(F.substring(digits, F.lit(1), F.greatest(F.length(digits) - 3, F.lit(0))), r"(?<=[0-9])(?=([0-9]{2})+$)", ",")
    tail = F.substring(digits, F.greatest(F.length(digits) - 2, F.lit(1)), F.lit(3))
    joined = F.when(F.length(digits) > 3, F.concat(head, F.lit(","), tail)).otherwise(digits)
    return F.when(c < 0, F.concat(F.lit("-"), joined)).otherwise(joined)


def short_amount(c: Column) -> Column:
    """Crores from one crore up, lakhs from one lakh up, with at most two decimals; smaller amounts in Indian grouping."""

    def scaled(by: float, word: str) -> Column:
        text = F.regexp_replace(F.format_number(c / F.lit(by), 2), ",", "")
        return F.concat(F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""), F.lit(f" {word}"))

    return F.when(F.abs(c) >= CRORE, scaled(CRORE, "crore")).when(F.abs(c) >= LAKH, scaled(LAKH, "lakh")).otherwise(indian_grouping(F.round(c)))
