"""Long texts cut at natural boundaries into pieces under a word limit, with overlaps.

A text over the limit is bisected: the cut goes to the strongest boundary near its middle (the search widens where the middle has none), and halves that still
exceed the limit less the overlap are bisected again. Afterwards each piece but the first gets the last words of
the text before it in front. Boundaries, from strong to weak: a blank line, a line break, the end of a sentence,
the end of a clause, any white space. In tables a line break is a row's end and beats everything inside a row;
in headings and prose a break in mid-sentence is a mere wrap and counts less than the end of a sentence. Words are
parted by white space of any kind, no-break included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 120, 20
#: Parts of a stretch around its middle that are searched in turn until one holds a natural boundary. In the last one, the
#: whole stretch, nothing weaker counts: without any natural boundary the cut stays near the middle.
WINDOWS = (0.5, 0.8, 1.0)

# ---- fixed values ----
BLANK_LINE, ROW, SENTENCE, LINE, CLAUSE, SPACE = 5, 4, 3, 2, 1, 0
#: Sections whose texts are tables although the kind is missing.
TABLE_SECTIONS = ("balance sheet", "cash flow statement")
SENTENCE_END, CLAUSE_END = tuple(".!?।…"), tuple(";:,)")
ITEM = re.compile(r"(?:[-•*–]|\(?[a-z0-9]{1,3}[.)])$", re.IGNORECASE)
# ---- end of fixed values ----

WORD = re.compile(r"\S+")


def layout(kind: str | None, section: str | None, text: str) -> str:
    """"table" or "prose"; spelled unevenly or missing kinds are settled by the section and the lines themselves."""
    k = " ".join((kind or "").split()).lower()
    if k.startswith("table"):
        return "table"
    if k:
        return "prose"
    lines = [x for x in text.splitlines() if x.strip()]
    rows = sum(1 for x in lines if "\t" in x or "|" in x or re.search(r"\S {2,}\S", x))
    likely = " ".join((section or "").split()).lower() in TABLE_SECTIONS
    return "table" if lines and rows * (3 if likely else 2) > len(lines) else "prose"


def strengths(text: str, words: list[tuple[int, int]], form: str) -> list[int]:
    """For each word but the first, how strong the boundary before it is; index 0 is unused."""
    out = [SPACE] * len(words)
    for i in range(1, len(words)):
        gap, before = text[words[i - 1][1] : words[i][0]], text[words[i - 1][0] : words[i - 1][1]]
        breaks = len(gap.splitlines()) - (0 if gap and gap[-1:].splitlines() == [""] else 1) if not gap.isspace() or "\n" in gap or "\r" in gap else 0
        bare = before.rstrip("\"'”’)]»")
        ends = bare.endswith(SENTENCE_END) and len(bare) > 2
        if gap.count("\n") >= 2:
            out[i] = BLANK_LINE
        elif breaks > 0:
            item = ITEM.match(text[words[i][0] : words[i][1]])
            out[i] = ROW if form == "table" or item or ends else LINE
        elif form == "table":
            out[i] = CLAUSE if "\t" in gap or len(gap) > 1 or before == "|" else SPACE
        elif ends:
            out[i] = SENTENCE
        elif before.endswith(CLAUSE_END):
            out[i] = CLAUSE
    return out


def cuts(strength: list[int], limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Word positions at which new pieces start, by bisection; empty when the whole fits the limit.

    The first piece gets at least as many words as the overlap, so that the second can begin with its last ones.
    """
    n, fits = len(strength), limit - overlap
    if n <= limit:
        return []
    out, open_ = [], [(0, n)]
    while open_:
        a, b = open_.pop()
        if b - a <= (max(fits, overlap) if a == 0 else fits):
            continue
        middle = (a + b) / 2
        for window in WINDOWS:
            reach = max(1.0, (b - a) * window / 2)
            lo = max(a + 1, overlap, int(middle - reach))
            hi = max(lo, min(b - 1, int(middle + reach)))
            at = max(range(lo, hi + 1), key=lambda i: (strength[i], -abs(i - middle)))
            if window < 1 or strength[at] >= SENTENCE:
                best = at
            if strength[at] >= SENTENCE:
                break
        out.append(best)
        open_ += [(a, best), (best, b)]
    return sorted(out)


def split(text: str | None, kind: str | None = None, section: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(first new word, new words, overlapping words, text) of each piece, in order; one piece when the text fits.

    Null and blank texts have no piece. Every piece is a stretch of the text as stored; without the overlaps the
    pieces join to the text from its first to its last character.
    """
    words = [m.span() for m in WORD.finditer(text or "")]
    if not words:
        return []
    starts = [0, *(cuts(strengths(text, words, layout(kind, section, text)), limit, overlap) if len(words) > limit else [])]
    out = []
    for k, a in enumerate(starts):
        b = starts[k + 1] if k + 1 < len(starts) else len(words)
        lead = min(overlap, a)
        begin = words[a - lead][0] if a else 0
        end = words[b][0] if b < len(words) else len(text)
        out.append((a, b - a, lead, text[begin:end]))
    return out


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, piece_no, n_pieces, first_word, n_new, n_overlap, piece): every text in pieces of at most limit words.

    Null and blank texts give no row; repeated texts each give their pieces; texts of any length are handled in
    one task without a shuffle; an empty table gives an empty result; further columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for chunk, text, kind, section in zip(*(c.to_pylist() for c in batch.columns)):
                parts = split(text, kind, section, limit, overlap)
                rows += [(chunk, i, len(parts), *p) for i, p in enumerate(parts)]
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["chunk_id", "piece_no", "n_pieces", "first_word", "n_new", "n_overlap", "piece"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", "text", "element_kind", "section").mapInArrow(run, f"chunk_id {kind}, piece_no int, n_pieces int, first_word int, n_new int, n_overlap int, piece string")


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(chunk_id) of the texts that had to be cut."""
    return pieces(chunks, limit).filter("piece_no = 0 AND n_pieces > 1").select(F.col("chunk_id"))
