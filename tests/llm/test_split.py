import pytest

from lodestone.llm.split import oversized, piece_spans, split_oversized


@pytest.mark.parametrize("text", ["", "a", "word " * 400, "x" * 1000, "Satz eins. Satz zwei! " * 60, "第一句。第二句！" * 100, "para one.\n\npara two is longer; with clauses\n- item\n- item\n" * 20, "👍🏽" * 300, "é" * 500, "\n" * 400])
@pytest.mark.parametrize("limit, overlap", [(50, 0), (50, 10), (120, 30), (7, 3)])
def test_spans_cover_and_overlap(text, limit, overlap):
    spans = piece_spans(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b in spans)
    assert "".join(text[a if n == 0 else a + overlap : b] for n, (a, b) in enumerate(spans)) == text
    for (_, end), (start, later) in zip(spans, spans[1:]):
        assert start == end - overlap and later > end


def test_strongest_boundary_wins():
    text = "One sentence here. Another one there.\n\nSecond paragraph follows now. It ends."
    first = piece_spans(text, 45, 0)[0]
    assert text[: first[1]].endswith("\n\n")
    assert text[: piece_spans("One sentence here. Another one there.", 30, 0)[0][1]] == "One sentence here. "


def test_bad_overlap():
    with pytest.raises(ValueError):
        piece_spans("abc", 5, 5)


def test_rows(spark):
    rows = [(1, "short", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 50, "x"), (4, "word " * 50, "y"), (None, "tail " * 20, None)]
    df = spark.createDataFrame(rows, "k int, t string, piece string")
    pieces = split_oversized(df, ["k"], "t", 60, 10).toPandas()
    assert set(pieces.k.dropna()) == {1, 4}
    assert (pieces.piece.str.len() <= 60).all()
    found = [r.k for r in oversized(df, ["k"], "t", 60, 10).collect()]
    assert sorted(found, key=str) == [4, None]
    assert split_oversized(df.limit(0), ["k"], "t", 60, 10).count() == 0
