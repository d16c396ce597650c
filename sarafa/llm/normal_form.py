"""One stored form for texts that look the same.

What may be unstable is known per character from its properties (the quick-check idea of normalization): kinds
of space, invisible characters, width variants and ligatures, look-alike letters, and characters that compose or
reorder. A text without any such character is passed on untouched. In the others only the unstable runs, each with
the character before it as boundary context, are normalized and spliced back; the rest of the text is copied as is.

Removed: invisible characters (a joiner between two pictographs is visible and stays). Unified: every kind of
one-line space becomes a blank; full-width, half-width, ligature, hyphen and ellipsis forms become plain ones; canonical
equivalents become composed (NFC). Letters of Greek and Cyrillic that look like Latin ones become these. Kept apart:
case, accents, digits, superscripts, fractions, line breaks, word order.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarafa.llm.lineage import cut

# ---- fixed values ----
#: Look-alike letters, Greek and Cyrillic, with the Latin letters they look like.
LOOKALIKES = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοϲϳАВЕЅІЈКМНОРСТУХаеорсухѕіјԁһԛԝӏ", "ABEZHIKMNOPTYXvocjABESIJKMHOPCTYXaeopcyxsijdhqwl"))
#: Invisible characters, as ranges of code points.
INVISIBLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))
#: Kinds of space within a line.
SPACES = ((0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: Compatibility forms that a reader cannot tell from the plain ones.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
PLAIN = {**{chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFB00, 0xFB07)}, "…": "...", "‐": "-", "‑": "-", "ĳ": "ij", "Ĳ": "IJ", "ǆ": "dž", "ǉ": "lj", "ǌ": "nj"}
JOINER = "‍"
# ---- end of fixed values ----

#: Documents of one stored text that meet those of another in one task, and hot texts that may be broadcast.
BLOCK, HOT_MOST = 4096, 100_000


@lru_cache(1)
def properties() -> tuple[dict[str, str], re.Pattern, re.Pattern]:
    """(single-character replacements, any unstable character, an unstable run with its context)."""
    to: dict[str, str] = {}
    unstable: set[int] = set()
    for cp in range(0x80, 0x323B0):
        c = chr(cp)
        kind = unicodedata.decomposition(c)
        if not kind:
            if unicodedata.combining(c):
                unstable.add(cp)
            continue
        first = kind.split(" ", 1)[0]
        if first in SAME_LOOK:
            to[c] = unicodedata.normalize("NFKC", c)
            unstable.add(cp)
        elif first[0] != "<":
            if not unicodedata.is_normalized("NFC", c):
                unstable.add(cp)
            elif " " in kind:  # its second character may compose with one before it
                unstable.add(int(kind.split()[1], 16))
        if unicodedata.combining(c):
            unstable.add(cp)
    unstable |= set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))  # jamo that compose
    to |= PLAIN | LOOKALIKES
    # A letter with marks on a look-alike is the Latin letter with these marks, composed or not.
    for cp in range(0x370, 0x2000):
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) > 1 and parts[0] in LOOKALIKES:
            to[chr(cp)] = unicodedata.normalize("NFC", LOOKALIKES[parts[0]] + parts[1:])
    to |= {chr(cp): " " for a, b in SPACES for cp in range(a, b + 1)}
    to |= {chr(cp): "" for a, b in INVISIBLE for cp in range(a, b + 1)}
    unstable |= set(map(ord, to))
    unstable = {cp for cp in unstable if cp >= 0x80}
    spans, start = [], None
    ordered = sorted(unstable)
    for i, cp in enumerate(ordered):
        start = cp if start is None else start
        if i + 1 == len(ordered) or ordered[i + 1] != cp + 1:
            spans.append(f"\\U{start:08x}-\\U{cp:08x}")
            start = None
    some = "[" + "".join(spans) + "]"
    return to, re.compile(some), re.compile(f"(?s:.)?{some}+")


def _pictograph(c: str) -> bool:
    return bool(c) and (0x1F000 <= ord(c) <= 0x1FAFF or 0x2600 <= ord(c) <= 0x27BF or ord(c) in (0x2640, 0x2642, 0xFE0F))


def canonical(text: str | None) -> str | None:
    """The one form of a text; null stays null, an empty text empty."""
    if not text or text.isascii():
        return text
    to, some, run = properties()
    if not some.search(text):
        return text

    def mend(match: re.Match) -> str:
        piece, end = match.group(), match.end()
        if JOINER in piece:
            around = piece + text[end : end + 1]
            piece = "".join(c for i, c in enumerate(piece) if c != JOINER or (i and _pictograph(around[i - 1]) and i + 1 < len(around) and _pictograph(around[i + 1])))
            plain = "".join(c if c == JOINER else to.get(c, c) for c in piece)
        else:
            plain = "".join([to.get(c, c) for c in piece])
        return plain if plain.isascii() else unicodedata.normalize("NFC", "".join([to.get(c, c) for c in unicodedata.normalize("NFC", plain)]) if JOINER not in plain else plain)

    return run.sub(mend, text)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([canonical(t) for t in batch.column(1).to_pylist()], pa.string())], names=["id", "stored", "form"])


def normal_forms(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, stored, form): every text beside its one form. Null texts have a null form, empty texts an empty one.

    No shuffle; texts are taken whole; further columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("stored")).mapInArrow(_run, f"id {kind}, stored string, form string")


def same_look_pairs(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: non-blank texts that differ as stored but have one form.

    Texts are normalized once and travel as 128-bit digests. Within a form the differing stored texts are paired as classes
    first (same_look_classes) and documents are attached to the classes last, in blocks of at most about BLOCK documents, so
    that a stored text that a third of all documents share is spread over many tasks.
    """
    member, several, pair = _classes(docs, id_column)
    hot = several.filter("blocks > 1").select("stored", "blocks")
    n_hot, own = hot.count(), F.lit(0)
    placed = member.select("id", "stored")
    if n_hot:
        placed = placed.join(F.broadcast(hot) if n_hot <= HOT_MOST else hot, "stored", "left")
        own = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int")
    placed = placed.select("id", "stored", own.alias("block"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    spread = pair.select("sa", every("na").alias("ba"), "sb", "nb").select("sa", "ba", "sb", every("nb").alias("bb"))
    a = placed.select(F.col("stored").alias("sa"), F.col("block").alias("ba"), F.col("id").alias("ia"))
    b = placed.select(F.col("stored").alias("sb"), F.col("block").alias("bb"), F.col("id").alias("ib"))
    out = spread.join(a, ["sa", "ba"]).join(b, ["sb", "bb"])
    return out.select(F.least("ia", "ib").alias(f"{id_column}_a"), F.greatest("ia", "ib").alias(f"{id_column}_b"))


def _classes(docs: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, form, stored) of the non-blank documents; (form, stored, rep, blocks) of the stored texts; (sa, na, ra, sb, nb, rb) of two of one form."""
    forms = normal_forms(docs, id_column).filter("form IS NOT NULL").filter(~F.col("form").rlike(r"^\s*$"))
    member = cut(forms.select("id", F.md5("form").alias("form"), F.md5("stored").alias("stored")))
    several = cut(member.groupBy("form", "stored").agg(F.min("id").alias("rep"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    both = several.groupBy("form").agg(F.count("*").alias("k")).filter("k > 1")
    cls = several.join(both, "form", "left_semi")
    x, y = cls.alias("x"), cls.alias("y")
    pair = x.join(y, "form").filter("x.stored < y.stored").select(F.col("x.stored").alias("sa"), F.col("x.blocks").alias("na"), F.col("x.rep").alias("ra"), F.col("y.stored").alias("sb"), F.col("y.blocks").alias("nb"), F.col("y.rep").alias("rb"))
    return member, several, pair


def same_look_classes(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: the pairs of differing stored texts of one form, each text named by its least document."""
    _, _, pair = _classes(docs, id_column)
    return pair.select(F.least("ra", "rb").alias(f"{id_column}_a"), F.greatest("ra", "rb").alias(f"{id_column}_b"))
