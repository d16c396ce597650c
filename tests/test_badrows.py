import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from sarafa.operators import badrows


def lines(spark, *raw):
    return spark.createDataFrame([(i, "f", 2, x, "extra") for i, x in enumerate(raw)], "line_id int, file_name string, line_no int, raw_line string, reason string")


def test_reasons(spark, rows):
    cases = [("A,1,2,IT", None), ("A,1,2,", None), ('"A ""x""","1,000","Rs 2.50","Oil, Gas"\r', None), ('"A,1,2,IT', "quoting"), ('A"B,1,2,IT', "quoting"), ('"A"x,1,2,IT', "quoting"), ("A,1,2", "columns"), ("A,1,2,IT,", "columns"), ("", "columns"), (None, "columns"), ("A;1;2;IT", "columns"), ("A,0,2,IT", "quantity"), ("A,1e999,2,IT", "quantity"), ("A,nan,2,IT", "quantity"), ("A,,2,IT", "quantity"), ("A,1_0,2,IT", "quantity"), ("A,x,y,IT", "quantity"), ("A,1,-1,IT", "avg_cost"), ("A,1,free,IT", "avg_cost"), ("A,1e2,0,IT", None), ("A,₹ 5,INR1.5,IT", None), (" \r", "columns")]
    got = {r[0]: r[1] for r in rows(badrows.parse(lines(spark, *[c[0] for c in cases])), "line_id", "reason")}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]
    assert badrows.rejected(lines(spark, *[c[0] for c in cases])).count() == sum(c[1] is not None for c in cases)


def test_loaded_values_headers_and_empty(spark, rows):
    df = lines(spark, '"A","1,000","Rs 2.50",""', "bad")
    assert rows(badrows.loaded(df)) == [(0, "A", 1000.0, 2.5, "Unknown")]
    assert badrows.parse(df.selectExpr("line_id", "file_name", "1 AS line_no", "raw_line")).count() == 0
    assert badrows.parse(df.limit(0)).count() == 0


def test_very_long_line(spark):
    long = "A" * 200_000 + ",1,2,IT"
    assert badrows.parse(lines(spark, long, "\"" + "x" * 3000, "," * 5000, "A," + "9" * 5000 + ",1,IT")).filter("reason IS NULL").count() == 1


def brute(line, most):
    """Least number of quotes and delimiters to insert or delete until the line is a clean row of four fields."""
    import re

    clean = re.compile(r'^(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*$')
    ok = lambda s: clean.match(s) and len(re.findall(r'(?:^|,)("(?:[^"]|"")*"|[^",]*)', s)) == 4
    seen = {line}
    for cost in range(most + 1):
        if any(map(ok, seen)):
            return cost
        seen = {t for s in seen for i in range(len(s) + 1) for t in ([s[:i] + c + s[i:] for c in '",'] + ([s[:i] + s[i + 1 :]] if s[i : i + 1] in ('"', ",") and s[i : i + 1] else []))}
    return most + 1


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet='a",', max_size=7))
def test_cost_is_least(line):
    got, want = badrows.cheapest(line, 4)[0], brute(line, 3)
    # A quote put beside a quoted one is one edit to the program and to the search alike.
    assert got == want or (got > 3 and want > 3)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(['"', ",", "a", '""', '"b"', '"c,d"', ",,"]), max_size=12).map("".join))
def test_the_free_path_is_the_program_without_edits(line):
    """What costs nothing by the whole program is followed to the same cells; all else gets the program's costs."""
    whole, alone = badrows.cheapest(line, 4), badrows.cheapest(line)[0]
    quoting, cost, edits, cells = badrows.parsed(line)
    assert (quoting, cost) == (alone, whole[0])
    assert cells == (whole[2] if whole[0] == 0 else None) and edits == "; ".join(whole[1])
    assert (badrows.free(line) is not None) == (alone == 0)


def test_edits_tell_what_is_wrong():
    assert badrows.cheapest('A"B,1,2,IT', 4)[:2] == (1, ["delete quote at 1"])
    assert badrows.cheapest("A,1,2,Oil, Gas", 4)[0] == 1
    assert all(badrows.cheapest(",".join(p), 4)[0] == 0 for p in itertools.product(("a", '"b,c"'), repeat=4))
