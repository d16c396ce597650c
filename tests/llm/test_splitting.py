from hypothesis import given, settings
from hypothesis import strategies as st

from sarafa.llm import splitting as S

GAPS = st.sampled_from([" ", "  ", "\n", "\n\n", "\t", " ", "  ", "\r\n"])
WORDS = st.sampled_from(["profit", "Rs", "1,234", "fell.", "grew;", "(a)", "-", "next", "why?", "आय।"])


def whole(text, parts, limit, overlap):
    words = text.split()
    got = []
    for k, (a, n, lead, piece) in enumerate(parts):
        w = piece.split()
        assert len(w) == n + lead <= limit and w[lead:] == words[a : a + n]
        if k:
            assert lead == overlap and w[:overlap] == (parts[k - 1][3].split()[-overlap:] if overlap else [])
        got += w[lead:]
    assert got == words


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(WORDS, GAPS), min_size=1, max_size=420), st.sampled_from(["table", "paragraph", None, " PARAGRAPH", ""]), st.sampled_from([(120, 20), (30, 5), (10, 0), (12, 11)]))
def test_pieces_are_whole_and_bounded(parts, kind, sizes):
    text = "".join(w + g for w, g in parts)
    limit, overlap = sizes
    got = S.split(text, kind, None, limit, overlap)
    assert (len(got) > 1) == (len(text.split()) > limit)
    whole(text, got, limit, overlap)


def test_cuts_at_the_strongest_boundary_near_the_middle():
    text = " ".join(["word"] * 65) + " end.\n\nNew " + " ".join(["word"] * 70)
    parts = S.split(text, "paragraph")
    assert len(parts) == 2 and parts[0][3].rstrip().endswith("end.") and parts[1][0] == 66
    table = "\n".join("\t".join(["cell. x"] * 4) for _ in range(30))
    assert all(p[3].endswith("\n") for p in S.split(table, "table")[:-1])


def test_cuts_at_the_only_sentence_end_of_a_stretch_wherever_it_is():
    strength = [S.SPACE] * 205
    strength[100], strength[107] = S.BLANK_LINE, S.SENTENCE
    assert S.cuts(strength) == [100, 107]
    strength[107], strength[150] = S.LINE, S.CLAUSE
    assert S.cuts(strength) == [100, 150]


def test_layout_from_section_and_lines():
    assert S.layout(None, "Balance sheet", "a\t1\nb\t2\nplain") == "table"
    assert S.layout(" Table ", None, "") == "table" and S.layout("para", "Balance sheet", "a\t1") == "prose"


def test_table_of_chunks(spark, rows):
    long = "word " * 121
    df = spark.createDataFrame([("a", None, None, None), ("b", "  ", None, None), ("c", "x", "heading", "s"), ("d", long, None, None), ("d", long, None, None), ("e", "w " * 100_000, "table", None)], "chunk_id string, text string, element_kind string, section string").selectExpr("*", "1 AS piece", "2 AS piece_no")
    assert rows(S.oversized(df)) == [("d",), ("d",), ("e",)]
    p = S.pieces(df).filter("chunk_id = 'e'").agg({"n_new": "sum", "n_overlap": "max"}).first()
    assert p[0] == 100_000 and p[1] == 20
    assert S.pieces(df.limit(0)).count() == 0


def test_chunks_of_the_corpus(tables):
    texts = {r.chunk_id: r.text for r in tables("chunks").collect() if r.text and r.text.strip()}
    got: dict = {}
    for r in S.pieces(tables("chunks")).orderBy("chunk_id", "piece_no").collect():
        got.setdefault(r.chunk_id, []).append((r.first_word, r.n_new, r.n_overlap, r.piece))
    assert set(got) == set(texts)
    for c, parts in got.items():
        whole(texts[c], parts, 120, 20)
