"""Column functions for titles, texts, numbers in texts and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----
#: Words that say nothing about a headline's subject.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "by", "for", "from", "has", "in", "into", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "with")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
DATE_FORMS = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\bFY\s?[0-9]{2,4}\b|\b(?:19|20)[0-9]{2}-[0-9]{2}\b"
UNIT_NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?\s?(?:%|bps\b|crore|lakh|million|billion|x\b)"
LONG_NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
#: The end of a sentence, replaced by a mark before splitting (no look-behind, so that other engines can do the same).
SENTENCE_END, MARK = r"([.!?;])\s+|\n+", "\u0001"
# ---- end of fixed values ----


def clean_html(c: Column) -> Column:
    """Tags to blanks, entities to characters, white space collapsed."""
    s = F.regexp_replace(c, "<[^>]*>", " ")
    for entity, char in ENTITIES:
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def title_tokens(c: Column) -> Column:
    """The distinct words of a title without apostrophes, punctuation and stop words, in order; all words where nothing else is left."""
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(F.lower(c), r"['’]", ""), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    kept = F.array_distinct(F.array_except(words, F.array(*[F.lit(w) for w in STOPWORDS])))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array_distinct(words))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over those of the shorter set; 0 for an empty one."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))


def ascii_tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, with repeats."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def content_hash(c: Column) -> Column:
    """SHA-256 of the text with white space collapsed."""
    return F.sha2(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), 256)


def dedup_key(c: Column) -> Column:
    """The first 80 letters and digits of the lower-cased text; failing those, its first 80 characters."""
    plain = F.substring(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), 1, 80)
    return F.coalesce(F.nullif(plain, F.lit("")), F.nullif(F.substring(F.trim(F.lower(c)), 1, 80), F.lit("")))


def number_key(c: Column) -> Column:
    """Digits and points only."""
    return F.regexp_replace(c, "[^0-9.]", "")


def first_sentence(c: Column) -> Column:
    """Up to and with the first full stop that a blank follows."""
    at = F.locate(". ", c)
    return F.when(at > 0, F.substring(c, F.lit(1), at)).otherwise(c)


def fragments(c: Column) -> Column:
    """The sentences and lines of a text."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, SENTENCE_END, f"$1{MARK}"), MARK), lambda x: F.trim(x)), lambda x: x != "")


def numbers_in(c: Column) -> Column:
    """Keys of all numbers of a text, dates and fiscal years aside."""
    bare = F.regexp_replace(c, DATE_FORMS, " ")
    return F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(LONG_NUMBER), 0), number_key))


def material_numbers(c: Column) -> Column:
    """Keys of the numbers with three digits or more and of all that bear a unit, dates and fiscal years aside."""
    bare = F.regexp_replace(c, DATE_FORMS, " ")
    keys = F.transform(F.regexp_extract_all(bare, F.lit(LONG_NUMBER), 0), number_key)
    long = F.filter(keys, lambda k: F.length(F.replace(k, F.lit("."), F.lit(""))) >= 3)
    unit = F.transform(F.regexp_extract_all(bare, F.lit(UNIT_NUMBER), 0), number_key)
    return F.array_sort(F.array_distinct(F.concat(long, unit)))


def supporting_fragment(text: Column, key: Column) -> Column:
    """The first fragment that holds a number; NULL if none does."""
    return F.get(F.filter(fragments(text), lambda f: F.array_contains(numbers_in(f), key)), F.lit(0))


def truthy(c: Column) -> Column:
    """False for null, empty, 0, false, no and off; true for the rest."""
    return ~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "0", "false", "no", "off")


def window_starts(n: Column, width: int = 120, lap: int = 20) -> Column:
    """First word of each window; the last window is the first that reaches the end."""
    step = max(1, width - lap)
    last = F.greatest(F.ceil((n - width) / F.lit(float(step))), F.lit(0)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step))


def windows(c: Column, width: int = 120, lap: int = 20) -> Column:
    """The text's words in overlapping windows, joined by blanks; NULL for blank texts."""
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    return F.transform(window_starts(F.size(words), width, lap), lambda i: F.array_join(F.slice(words, i + 1, F.lit(width)), " "))


def all_words(c: Column, query: str) -> Column:
    """Whether a name holds every word of a query; hyphens part words; an empty query fits all."""
    name = F.lower(c)
    fits = F.lit(True)
    for word in query.lower().replace("-", " ").split():
        fits = fits & F.contains(name, F.lit(word))
    return fits


def sector_kind(c: Column) -> Column:
    """bank, nbfc, real_estate or other, by words of a sector's or industry's name."""
    s = F.lower(F.coalesce(c, F.lit("")))
    return F.when(F.contains(s, F.lit("bank")), "bank").when(s.rlike("credit services|mortgage|conglomerate|nbfc"), "nbfc").when(F.contains(s, F.lit("real estate")), "real_estate").otherwise("other")


def glossary(c: Column, terms: dict[str, str]) -> Column:
    """The text of a term, whatever its case and outer blanks; NULL for a term the glossary lacks."""
    known = F.create_map(*[F.lit(x) for k, v in terms.items() for x in (k.strip().lower(), v)]) if terms else F.create_map(F.lit(""), F.lit(None).cast("string"))
    return F.try_element_at(known, F.lower(F.trim(c)))
