import random

import pytest

from sarafa.llm import canonical_values as C

SYMBOLS = {"SHAFIZISKI": ["Shafiziski Energy Ltd", "979326"], "DIDAVILOG": ["Didavi Logistics Ltd", "979959"], "TIGOGON": ["Tigogon Energy Ltd", "977444"], "THIGOPETEL": ["Thigope Telecom Ltd", "976518"]}
SECTORS = {s: [] for s in ("Information Technology", "Financial Services", "Fast Moving Consumer Goods", "Consumer Durables", "Oil and Gas", "Power Utilities", "Capital Goods", "Automobiles", "Auto Components", "Fertilizers", "Logistics", "Defence Equipment", "Telecommunication", "Media and Entertainment", "Real Estate")}


@pytest.mark.parametrize("typed,entry", [("shafiziski", "SHAFIZISKI"), ("NSE: SHAFIZISKI", "SHAFIZISKI"), ("bse:979326", "SHAFIZISKI"), ("979326.BO", "SHAFIZISKI"), ("SHA FIZISKI", "SHAFIZISKI"), ("S.HAFIZISKI", "SHAFIZISKI"), ("SHAFIZSIKI-EQ", "SHAFIZISKI"), ("SHAFIZISKI (N)", "SHAFIZISKI"), ("SHAFIZISKI*", "SHAFIZISKI"), ("​SHAFIZISKI ", "SHAFIZISKI"), ("The Shafiziski Energy Limited", "SHAFIZISKI"), ("Energy - Shafiziski", "SHAFIZISKI"), ("Didavi Logistics", "DIDAVILOG"), ("Tigegon Energy", "TIGOGON"), ("Shafiziski Finance", C.UNMATCHED), ("979327", C.UNMATCHED), ("Energy", C.UNMATCHED), ("see statement 44", C.UNMATCHED), ("FD @ 7.1%", C.UNMATCHED), ("--", C.UNMATCHED), ("SHAFIZISKI TIGOGON", C.UNMATCHED), ("bought SHAFIZISKI on dip", "SHAFIZISKI"), ("my SHAFIZISKI holding", "SHAFIZISKI"), ("Shafiziski Energy Ltd shares", "SHAFIZISKI"), ("sold tigogon, kept SHAFIZISKI", C.UNMATCHED), ("new Shafiziski Telecom", C.UNMATCHED)])
def test_symbols(typed, entry):
    assert C.Matcher(SYMBOLS, True).match(typed) == entry


@pytest.mark.parametrize("typed,entry", [("IT", "Information Technology"), ("Info Tech", "Information Technology"), ("F.M.C.G.", "Fast Moving Consumer Goods"), ("Fast-moving cons. goods", "Fast Moving Consumer Goods"), ("Durables (Consumer)", "Consumer Durables"), ("Oil & Gas", "Oil and Gas"), ("OilGas", "Oil and Gas"), ("Gas and Oil", "Oil and Gas"), ("Fin. Svcs", "Financial Services"), ("Financials", "Financial Services"), ("Cap Goods", "Capital Goods"), ("AUTOMOBILE CO", "Automobiles"), ("Auto Comps", "Auto Components"), ("Fertiliser", "Fertilizers"), ("Logistics svcs", "Logistics"), ("Defence Eqpt", "Defence Equipment"), ("Telecom", "Telecommunication"), ("Entertainment/Media", "Media and Entertainment"), ("Real Est.", "Real Estate"), ("Others", C.UNMATCHED), ("xx-99", C.UNMATCHED), ("Crypto !", C.UNMATCHED), ("Goods", C.UNMATCHED), ("is it ok", C.UNMATCHED), ("my real estate bets", "Real Estate")])
def test_sectors(typed, entry):
    assert C.Matcher(SECTORS).match(typed) == entry


def test_longest_find_wins():
    m = C.Matcher({"Oil": [], "Oil and Gas": [], "Gas Supply": []})
    assert m.match("oil and gas ltd") == "Oil and Gas" and m.match("the oil co") == "Oil"


def test_looked_up_words_are_all_words_that_can_stand_for_each_other():
    """Looking likenesses up by parts finds what comparing with every word finds."""
    rng = random.Random(7)
    names = ["".join(rng.choice("abcs") for _ in range(rng.randint(3, 7))) for _ in range(250)]
    m = C.Matcher({f"{a} {b}": [] for a, b in zip(names[::2], names[1::2])})
    for typed in [*names, *("".join(rng.choice("abcsy") for _ in range(rng.randint(2, 7))) for _ in range(400)), *C.SHORT_FORMS]:
        assert m._near(typed) == {w: x for w in m.forms_with if (x := C.alike(typed, w))}


def test_slips():
    assert [C.slips(a, b) for a, b in (("abcd", "abcd"), ("abcd", "abdc"), ("abcd", "abc"), ("abcd", "xbcd"), ("abcd", "badc"), ("a", "abcd"))] == [0, 1, 1, 1, 2, 2]


def test_table(spark, rows):
    h = spark.createDataFrame([(1, "tigogon", None), (2, None, " "), (3, "TIGOGON", "Logistics"), (4, "x" * 100_000, "IT"), (1, "tigogon", None), (5, "", "Power")], "holding_id int, symbol string, sector string").selectExpr("*", "'z' AS canonical", "0 AS field")
    ref = spark.createDataFrame([(k, *v) for k, v in SYMBOLS.items()] + [(None, "n", None)], "symbol string, company_name string, scrip_code string")
    sec = spark.createDataFrame([(s,) for s in SECTORS], "sector string")
    assert rows(C.canonical_values(h, ref, sec)) == [(1, "symbol", "TIGOGON")] * 2 + [(4, "sector", "Information Technology"), (4, "symbol", C.UNMATCHED), (5, "sector", "Power Utilities")]
    assert {r.canonical for r in C.canonical_values(h, ref.limit(0), sec.limit(0)).collect()} == {C.UNMATCHED}
    assert C.canonical_values(h.limit(0), ref, sec).count() == 0


def test_one_list_entry_is_one_slip_from_two():
    m = C.Matcher({"ABCDEF": [], "ABCDEG": []}, True)
    assert m.match("ABCDEH") == C.UNMATCHED and m.match("ABCDE") == C.UNMATCHED
