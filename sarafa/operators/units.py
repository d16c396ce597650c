"""Quantities written in different units, brought to one unit per kind.

Money comes out in paise, rates in basis points, multiples in hundredths. The notation of a record (its currency
mark, scale word or ratio sign) is read from the raw text first and from the columns where the text leaves it out.
What a notation is worth is settled on a *source graph*. Its nodes are (source, notation); records of different
sources that state the same figure of the same company and year link their nodes. Over all links of two notations
the median log ratio is the edge's scale and Theil's intercept its offset; an edge whose offset is negligible and whose
scale lies near a known conversion is snapped to it, and conversions are propagated from a few base notations
(rupees, basis points, multiples) over the snapped edges. So a word the lexicon lacks gets its worth from the data, a
lexicon word whose strong edges say otherwise is overruled, and a source that means something else by a word than
all other sources do is shifted by itself. The lexicon decides where the graph has too few links to.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sarafa.functions.rows import keep
from sarafa.session import cut

# ---- fixed values: the meaning of notations, as factor to the kind's common unit ----
MONEY, RATE, MULTIPLE = "money", "rate", "multiple"
#: Scale words, in whole rupees. Longest meaning first where one word contains another.
SCALE_WORDS = {
    "lakhcrore": (10**12, ("lakh crore", "lakh crores", "lakh cr", "lac crore", "lac crores", "lac cr", "lakhs crore", "lakhs crores")),
    "trillion": (10**12, ("trillion", "trillions", "trn", "tn")),
    "billion": (10**9, ("billion", "billions", "bn", "bln")),
    "crore": (10**7, ("crore", "crores", "cr", "crs")),
    "million": (10**6, ("million", "millions", "mn", "mln", "mio")),
    "lakh": (10**5, ("lakh", "lakhs", "lac", "lacs", "l")),
    "thousand": (10**3, ("thousand", "thousands", "k")),
    "one": (1, ("none", "unit", "units", "absolute", "actual", "actuals", "rupees")),
}
RUPEE_MARKS = ("₹", "rs", "inr", "rupee", "rupees")
FOREIGN_MARKS = ("us$", "$", "usd", "eur", "€", "gbp", "£", "jpy", "¥", "aed", "sgd", "chf", "cny", "aud", "cad", "hkd")
PERCENT_MARKS = ("%", "percent", "per cent", "pct")
BPS_MARKS = ("bp", "bps", "basis point", "basis points")
MULTIPLE_MARKS = ("x", "times", "ratio", "multiple")
#: Words that carry no unit.
FILLERS = ("about", "approx", "approximately", "nearly", "around", "up", "at", "in", "only", "p", "a", "pa", "of", "to", "the", "fy", "n", "see", "note", "currency", "and", "over", "circa", "some", "est")
#: Common units: paise in a rupee, basis points in a percent, hundredths in a multiple.
PAISE, BPS_IN_PERCENT, HUNDREDTHS = 100, 100, 100
#: Ratios a measured edge may snap to.
KNOWN_RATIOS = tuple(float(x) for x in (1, 10, 100, 10**3, 10**4, 10**5, 10**6, 10**7, 10**9, 10**12))
# ---- end of fixed values ----

#: Steps in which the significands of one entity's numbers are told apart: records that state one quantity in different
#: notations agree in the digits, while a company may have many quantities under one figure and year.
SIGNIFICAND = 200
#: An edge counts when its median log10 ratio lies this close to a known conversion.
SNAP = 0.05
#: Links that an edge needs before an unknown notation may take its worth from it.
MIN_LINKS = 3
#: Links, and the part of them that must lie at the conversion, for evidence that settles an edge between known
#: notations, and for a source's own meaning of one.
STRONG_LINKS, EDGE_SHARE, NODE_SHARE = 30, 0.5, 0.6
#: An edge is a pure conversion if its offset is no more than this part of the typical number.
OFFSET_PART = 0.25

#: A number; a point opens one only where no letter stands before it, since the point of "Rs." belongs to the mark.
NUMBER = r"([0-9][0-9,]*(?:\.[0-9]+)?|(?<![a-z0-9])\.[0-9]+)"


def _word(words) -> str:
    """A pattern for any of the words or signs, not inside a longer word."""
    parts = sorted((w for w in words), key=len, reverse=True)
    quoted = [(r"(?<![a-z])" if p[0].isalpha() else "") + "".join(r"\s*" if c == " " else ("\\" + c if not c.isalnum() else c) for c in p) + (r"(?![a-z])" if p[-1].isalpha() else "") for p in parts]
    return "(?:" + "|".join(quoted) + ")"


def _plain(c: Column) -> Column:
    """Lower case, every kind of space as a blank, thousands written '000 as a word, fiscal years removed.

    The patterns are tried only on texts that hold their plain parts.
    """
    spaces = "\u00a0\u2007\u2009\u200a\u202f\u3000\t\n\r"
    s = F.lower(F.translate(F.translate(c, spaces, " " * len(spaces)), "\u200b\ufeff", ""))
    s = F.when(F.contains(s, F.lit("000")), F.regexp_replace(s, r"['\u2019`]\s?000s?", " thousand ")).otherwise(s)
    return F.trim(F.when(F.contains(s, F.lit("fy")), F.regexp_replace(s, r"\(?\b(?:in )?fy\s?[0-9]{2,4}(?:\s?-\s?[0-9]{2,4})?\)?", " ")).otherwise(s))


def _scale_of(text: Column) -> Column:
    """The name of the first scale word in a text, NULL where it has none; one search, then a look-up."""
    words = {w: name for name, (_, ws) in SCALE_WORDS.items() for w in ws if w not in RUPEE_MARKS}
    found = F.regexp_replace(F.regexp_extract(text, "(" + _word(words) + ")", 1), r"\s+", "")
    names = F.create_map(*[F.lit(x) for w, name in words.items() for x in (w.replace(" ", ""), name)])
    return F.try_element_at(names, found)


def _unit_of(text: Column, signs_only: bool) -> Column:
    """rupee, foreign, percent, bps or multiple as stated in a text; NULL where it states none.

    signs_only: in raw text the word "ratio" is no unit of the number beside it.
    """
    times = [w for w in MULTIPLE_MARKS if not (signs_only and w in ("ratio", "multiple"))]
    out = F.when(text.rlike(_word(FOREIGN_MARKS)), F.lit("foreign"))
    out = out.when(text.rlike(_word(PERCENT_MARKS)), F.lit("percent")).when(text.rlike(_word(BPS_MARKS)), F.lit("bps"))
    return out.when(text.rlike(_word(RUPEE_MARKS)), F.lit("rupee")).when(text.rlike(_word(times)), F.lit("multiple"))


def _other_word(text: Column) -> Column:
    """The first word that is neither a filler nor a known notation: a notation still to be learnt."""
    known = {w for _, ws in SCALE_WORDS.values() for w in ws} | set(RUPEE_MARKS + FOREIGN_MARKS + PERCENT_MARKS + BPS_MARKS + MULTIPLE_MARKS) | set(FILLERS)
    listed = sorted({x for k in known for x in k.split()})
    return F.get(F.filter(F.regexp_extract_all(text, F.lit(r"[\p{L}]+"), 0), lambda w: ~w.isin(listed)), F.lit(0))


def parse(records: DataFrame, id_column: str = "record_id") -> DataFrame:
    """(id, source, entity, number decimal(28,8), kind, note): what each record states, not yet converted.

    entity is a hash of figure, company and fiscal year, NULL where one of them is missing; note is the notation,
    "unit" or "rupee:scale", and NULL where the record does not state all that its kind needs.

    number is NULL where no number can be read; unit is NULL where neither text nor columns name one. A text
    that is not empty but holds no number stays unread, whatever the value column says. Infinite and NaN
    values are unread.
    """
    # In stages: a cleaned text is used many times and must be computed once.
    cleaned = records.select(
        F.col(id_column), F.coalesce(F.col("source_doc").cast("string"), F.lit("")).alias("source"), F.col("figure").cast("string").alias("figure"), F.upper(F.trim("company")).alias("company"), F.coalesce(_fiscal_year(F.col("period")), _fiscal_year(F.col("raw_string"))).alias("fy"),
        F.coalesce(_plain(F.col("raw_string")), F.lit("")).alias("raw"), F.col("value").cast("double").alias("value"), *(_plain(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"{c}_c") for c in ("unit", "scale", "currency")),
    )
    raw, value = F.col("raw"), F.col("value")
    minus = raw.rlike(r"(?:^|[^0-9a-z])[-−–]\s?(?:₹|rs\.?|inr)?\s?\.?[0-9]") | raw.rlike(r"\(\s*[-−–]?(?:₹|rs\.?|inr)?\s*" + NUMBER + r"\s*\)")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < 1e19)
    marked = cleaned.select(
        "*", F.regexp_replace(F.regexp_extract(raw, NUMBER, 1), ",", "").alias("digits"), minus.alias("minus"), F.when(finite, value.cast("string").try_cast("decimal(28,8)")).alias("plain_value"), F.regexp_replace(raw, NUMBER, " ").alias("rest"),
        _unit_of(raw, True).alias("raw_unit"), F.coalesce(F.when(_unit_of(F.col("currency_c"), False) == "foreign", F.lit("foreign")), _unit_of(F.col("unit_c"), False)).alias("col_unit"),
    )
    words = marked.select(
        "*", _scale_of(F.col("rest")).alias("raw_scale"), _other_word(F.col("rest")).alias("raw_word"),
        F.coalesce(_scale_of(F.regexp_replace("unit_c", r"rupees?", " ")), _scale_of(F.col("scale_c")), _other_word(F.col("scale_c"))).alias("col_scale"),
    )
    raw_unit, raw_scale, raw_word, col_unit, digits = (F.col(c) for c in ("raw_unit", "raw_scale", "raw_word", "col_unit", "digits"))
    read = digits.try_cast("decimal(28,8)")
    number = F.when(F.length(raw) > 0, F.when(F.length(digits) > 0, F.when(F.col("minus"), -read).otherwise(read))).otherwise(F.col("plain_value"))
    ratio_like = raw_unit.isin("percent", "bps", "multiple")
    # A rupee mark without scale word means whole rupees; a scale word alone means rupees of that scale. A word
    # that the lexicon lacks is looked at last, so that it never hides what the columns say.
    unit = F.coalesce(
        F.when(F.coalesce(ratio_like | (raw_unit == "foreign"), F.lit(False)), raw_unit),
        F.when(raw_scale.isNotNull(), F.when(raw_unit.isNull() & (col_unit == "foreign"), F.lit("foreign")).otherwise(F.lit("rupee"))),
        raw_unit,
        col_unit,
        F.when(raw_word.isNotNull(), F.lit("rupee")),
    )
    scale = F.coalesce(raw_scale, F.when(raw_unit == "rupee", F.lit("one")), F.col("col_scale"), raw_word)
    whole = F.col("figure").isNotNull() & F.col("company").isNotNull() & F.col("fy").isNotNull()
    stated = words.select(id_column, "source", F.when(whole, F.xxhash64("figure", "company", "fy")).alias("entity"), number.alias("number"), unit.alias("unit"), scale.alias("scale"))
    note = F.when(F.col("unit") == "rupee", F.concat(F.lit("rupee:"), F.col("scale"))).when(F.col("unit") != "foreign", F.col("unit"))
    return stated.select(id_column, "source", "entity", "number", _kind(F.col("unit")).alias("kind"), note.alias("note"))


def _kind(unit: Column) -> Column:
    return F.when(unit == "rupee", MONEY).when(unit.isin("percent", "bps"), RATE).when(unit == "multiple", MULTIPLE)


def _fiscal_year(c: Column) -> Column:
    """FY19, FY2019 and 2018-19 as 2019; NULL where none is stated."""
    tag = F.when(F.contains(F.upper(c.cast("string")), F.lit("FY")), F.regexp_extract(F.upper(c.cast("string")), r"FY\s?([0-9]{4}|[0-9]{2})", 1))
    span = F.when(F.contains(c.cast("string"), F.lit("-")), F.regexp_extract(c.cast("string"), r"\b([0-9]{4})-([0-9]{2})\b", 1))
    short = F.when(F.length(tag) == 4, tag.try_cast("int")).when(F.length(tag) == 2, tag.try_cast("int") + 2000)
    return F.coalesce(short, span.try_cast("int") + 1)


def lexicon() -> dict[str, tuple[str, int]]:
    """notation -> (kind, factor to the common unit) for the notations known beforehand."""
    out = {"percent": (RATE, BPS_IN_PERCENT), "bps": (RATE, 1), "multiple": (MULTIPLE, HUNDREDTHS)}
    return out | {f"rupee:{name}": (MONEY, factor * PAISE) for name, (factor, _) in SCALE_WORDS.items()}


#: The base notations that conversions are propagated from.
BASE = ("rupee:one", "bps", "multiple")


def links(parsed: DataFrame) -> DataFrame:
    """(source, kind, a, b, la, lb): a source's number in notation a beside what other sources state in notation b, as log10.

    Records are linked that agree in figure, company, year and significand. Each such entity is first reduced to one median per source and notation, and the other side to one median per
    notation, so that a hot entity gives as many links as it has nodes, times the notations of its kind, and never
    pairs of records. What a source alone states in b is no link of that source.
    """
    named = keep(parsed, lambda r: r["number"].isNotNull() & (r["number"] != 0) & r["note"].isNotNull() & r["entity"].isNotNull())
    lv = F.log10(F.abs(F.col("number").cast("double")))
    near = F.pmod(F.round((lv - F.floor(lv)) * SIGNIFICAND), F.lit(SIGNIFICAND)).cast("int")
    node = named.withColumn("lv", lv).groupBy(F.xxhash64("entity", near).alias("entity"), "kind", "source", "note").agg(F.percentile_approx("lv", 0.5, 1000).alias("lv"))
    hub = node.groupBy("entity", "kind", "note").agg(F.percentile_approx("lv", 0.5, 1000).alias("lb"), F.min("source").alias("least"), F.max("source").alias("most"))
    a, b = node.alias("a"), hub.alias("b")
    others = ~((F.col("b.least") == F.col("a.source")) & (F.col("b.most") == F.col("a.source")))
    joined = a.join(b, (F.col("a.entity") == F.col("b.entity")) & (F.col("a.kind") == F.col("b.kind")) & others)
    return joined.select("a.source", "a.kind", F.col("a.note").alias("a"), F.col("b.note").alias("b"), F.col("a.lv").alias("la"), "b.lb")


def _robust(ratios: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_links, log10_scale, spread, share) of the log ratios d: their median, middle half and part at the nearest power of ten.

    The ratios are first counted in hundredths, so a hot edge sends no more than some thousand counts.
    """
    counted = ratios.withColumn("bin", F.round("d", 2)).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    q = F.percentile("bin", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    edge = counted.groupBy(*keys).agg(F.sum("n").alias("n_links"), q.alias("q"), F.collect_list(F.struct("bin", "n")).alias("bins"))
    middle = F.get("q", F.lit(1))
    near = F.aggregate(F.filter("bins", lambda x: F.abs(x["bin"] - F.round(middle)) <= SNAP + 1e-9), F.lit(0).cast("bigint"), lambda t, x: t + x["n"])
    return edge.select(*keys, "n_links", middle.alias("log10_scale"), (F.get("q", F.lit(2)) - F.get("q", F.lit(0))).alias("spread"), (near / F.col("n_links")).alias("share"))


def edges(linked: DataFrame) -> DataFrame:
    """(a, b, n_links, log10_scale, spread, share, offset_part): the graph's edges between notations, over all sources.

    offset_part is Theil's intercept, the median of what is left of a number after scaling, as a part of the median number.
    """
    pair = linked.filter("a < b").select("a", "b", "la", "lb", (F.col("la") - F.col("lb")).alias("d"))
    edge = _robust(pair, ["a", "b"])
    mine = F.pow(F.lit(10.0), F.col("la"))
    left = pair.join(edge.select("a", "b", "log10_scale"), ["a", "b"]).groupBy("a", "b").agg(
        F.percentile_approx(mine - F.pow(F.lit(10.0), F.col("log10_scale") + F.col("lb")), 0.5, 1000).alias("scale_offset"), F.percentile_approx(mine, 0.5, 1000).alias("mid")
    )
    return edge.join(left.select("a", "b", (F.col("scale_offset") / F.col("mid")).alias("offset_part")), ["a", "b"])


def snapped(d: float) -> float | None:
    """The log10 of the known conversion nearest to d, None where none is near."""
    near = min((math.log10(r) * s for r in KNOWN_RATIOS for s in (1, -1)), key=lambda x: abs(x - d))
    return near if abs(near - d) <= SNAP else None


def spread(edges: list[tuple[str, str, int, float]], anchors: dict[str, float], least: int = MIN_LINKS) -> dict[str, float]:
    """Log10 worth of every notation that a snapped edge connects with an anchor.

    edges: (a, b, links, median of log10(number in a / number in b)); the worth of b's unit is that ratio times
    the worth of a's. Best-supported edges are followed first. Anchors keep their worth.
    """
    near = defaultdict(list)
    for a, b, n, d in edges:
        s = snapped(d)
        if n >= least and s is not None:
            near[a].append((n, b, s))
            near[b].append((n, a, -s))
    worth, open_ = dict(anchors), list(anchors)
    while open_:
        reach = [(n, b, worth[a] + d) for a in open_ for n, b, d in near[a] if b not in worth]
        open_ = []
        for _, b, w in sorted(reach, key=lambda x: (-x[0], x[1])):
            if b not in worth:
                worth[b] = w
                open_.append(b)
    return worth


def worths(linked: DataFrame) -> dict[str, tuple[str, int]]:
    """notation -> (kind, factor): by the graph where it has the links to tell, by the lexicon elsewhere.

    Known notations take their worth from the base over strong edges; those that no strong edge reaches keep the
    lexicon's. Unknown words then take theirs from any settled notation.
    """
    known = lexicon()
    pure = edges(linked).filter((F.col("n_links") >= MIN_LINKS) & (F.abs("offset_part") <= OFFSET_PART))
    # One row per pair of notations with enough links, however many records and sources there are.
    found = [(r.a, r.b, r.n_links, r.log10_scale, r.share) for r in pure.select("a", "b", "n_links", "log10_scale", "share").toLocalIterator()]
    strong = [e[:4] for e in found if e[4] >= EDGE_SHARE and e[0] in known and e[1] in known]
    settled = spread(strong, {k: math.log10(known[k][1]) for k in BASE}, STRONG_LINKS)
    settled |= {k: math.log10(f) for k, (_, f) in known.items() if k not in settled}
    every = spread([e[:4] for e in found if e[4] >= EDGE_SHARE], settled)
    return {note: (known[note][0] if note in known else MONEY, round(10**w)) for note, w in every.items() if w >= 0}


def _map(table: dict[str, tuple[str, int]]) -> Column:
    return F.create_map(*[x for note, (kind, f) in table.items() for x in (F.lit(note), F.struct(F.lit(kind).alias("kind"), F.lit(f).cast("decimal(18,0)").alias("factor")))])


def sources(linked: DataFrame, table: dict[str, tuple[str, int]]) -> DataFrame:
    """(source, note, n_links, log10_shift, share, shift): what each source's notation is worth beside what others mean by it.

    log10_shift is the median over the node's links of how much larger the amount of others is than its own; shift is
    its snapped value where the evidence is strong, else 0.
    """
    log = F.create_map(*[F.lit(x) for note, (_, f) in table.items() for x in (note, math.log10(f))])
    dev = F.try_element_at(log, F.col("b")) + F.col("lb") - F.try_element_at(log, F.col("a")) - F.col("la")
    node = _robust(linked.select("source", F.col("a").alias("note"), dev.alias("d")).filter("d IS NOT NULL"), ["source", "note"])
    steps = F.array(*[F.lit(math.log10(r) * s) for r in KNOWN_RATIOS for s in (1, -1)])
    near = F.get(F.filter(steps, lambda x: F.abs(x - F.col("log10_scale")) <= SNAP), F.lit(0))
    strong = (F.col("n_links") >= STRONG_LINKS) & (F.col("share") >= NODE_SHARE)
    return node.select("source", "note", "n_links", F.col("log10_scale").alias("log10_shift"), "share", F.coalesce(F.when(strong, near), F.lit(0.0)).alias("shift"))


def convert(records: DataFrame, id_column: str = "record_id", learn: bool = True) -> DataFrame:
    """(id, quantity_kind, amount bigint): one row per record whose quantity can be read.

    Nulls, empty texts and unreadable numbers give no row; repeated rows each give their own; an empty table
    gives an empty result; further columns are ignored. Halves are rounded away from zero. An amount beyond
    the range of bigint is unread. learn=False leaves the source graph out, for comparison.
    """
    if not learn:
        return _amounts(parse(records, id_column), id_column, lexicon(), None)
    parsed = cut(keep(parse(records, id_column), lambda r: r["number"].isNotNull() & r["note"].isNotNull()))
    linked = cut(links(parsed))
    table = worths(linked)
    moved = keep(sources(linked, table).select("source", "note", "shift"), lambda r: r["shift"] != 0)
    return _amounts(parsed, id_column, table, moved)


def _amounts(parsed: DataFrame, id_column: str, table: dict[str, tuple[str, int]], moved: DataFrame | None) -> DataFrame:
    known = parsed.select(id_column, "source", "note", "number", F.try_element_at(_map(table), F.col("note")).alias("to"))
    if moved is not None:
        known = known.join(moved, ["source", "note"], "left")
        factor = F.when(F.col("shift").isNull(), F.col("to.factor").cast("decimal(28,10)")).otherwise((F.col("to.factor").cast("double") * F.pow(F.lit(10.0), "shift")).cast("decimal(28,10)"))
    else:
        factor = F.col("to.factor")
    amount = F.round(F.col("number") * factor, 0).try_cast("bigint")
    return keep(known.select(id_column, F.col("to.kind").alias("quantity_kind"), amount.alias("amount")), lambda r: r["quantity_kind"].isNotNull() & r["amount"].isNotNull())


def conversions(records: DataFrame) -> DataFrame:
    """The measured edges between notations beside what the lexicon expects of them."""
    expect = {note: math.log10(f) for note, (_, f) in lexicon().items()}
    known = F.create_map(*[F.lit(x) for kv in expect.items() for x in kv])
    edge = edges(links(parse(records))).filter(F.col("n_links") >= MIN_LINKS)
    return edge.select("a", "b", "n_links", F.round("log10_scale", 4).alias("log10_scale"), F.round("spread", 4).alias("spread"), F.round("share", 4).alias("share"), F.round("offset_part", 4).alias("offset_part"), F.round(F.try_element_at(known, F.col("b")) - F.try_element_at(known, F.col("a")), 4).alias("expected_log10"))


def source_shifts(records: DataFrame) -> DataFrame:
    """Each node (source, notation) of the graph with its links and how far it stands from the other sources."""
    linked = cut(links(parse(records)))
    node = sources(linked, worths(linked))
    return node.select("source", "note", "n_links", F.round("log10_shift", 4).alias("log10_shift"), F.round("share", 4).alias("share"), "shift")
