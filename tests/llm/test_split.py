from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import split as S

PART = st.sampled_from(["word ", "Ein Satz endet hier. ", "\n\n", "\n", "，短句", "。", "x" * 70, "你" * 55, ", ", "é", "https://a/b-c ", "# head\n", "1. item\n", " "])


@settings(max_examples=200, deadline=None)
@given(st.lists(PART, max_size=60).map("".join), st.integers(1, 40), st.integers(0, 12))
def test_round_trip_size_and_overlap(text, most, overlap):
    pieces = S.cut(text, most, overlap)
    if len(text) // 4 <= most:
        assert pieces == []
        return
    assert "".join(text[own:end] for own, _, end, _ in pieces) == text
    assert all((end - begin) // 4 < most and end > own >= begin for own, begin, end, _ in pieces)
    assert all(own - begin <= 4 * overlap for own, begin, _, _ in pieces)
    assert all(begin >= pieces[k][0] for k, (_, begin, _, _) in enumerate(pieces[1:]))


def test_weak_boundaries_are_merged_first():
    text = "One two. Three four.\n\nFive six. Seven eight.\n\nNine ten. End."
    ends = [text[own:end] for own, _, end, _ in S.cut(text, 7, 0)]
    assert ends == ["One two. Three four.\n\n", "Five six. Seven eight.\n\n", "Nine ten. End."]


def test_long_run_without_boundaries():
    pieces = S.cut("漢" * 1000, 25, 5)
    assert len(pieces) > 9 and all(k == S.CHARACTER for *_, k in pieces[:-1]) and pieces[1][0] - pieces[1][1] == 20


def test_table(spark):
    limits = spark.createDataFrame([("general", 10, 2), ("qa", 20, 2)], "method string, max_tokens int, overlap_tokens int")
    rows = [("a", "x" * 44, '{"method": "qa"}'), ("b", "x" * 44, '{"method": "qa"'), ("c", "x" * 44, None), ("d", "x" * 43, "{}"), ("e", "x" * 44, '{"method": 5}'), ("f", None, None), ("g", "x" * 90, '{"method": "qa"}'), ("c", "x" * 44, None), ("h", "x" * 44, '{"method": "QA"}')]
    df = spark.createDataFrame([(*r, "z") for r in rows], "id string, content string, meta string, chunk_id string")
    pieces = S.split_pieces(df, limits).distinct()
    assert {r["chunk_id"] for r in pieces.collect()} == {"b", "c", "e", "g", "h"}
    assert pieces.where("chunk_id = 'c'").count() == len(S.cut("x" * 44, 10, 2))
    assert S.split_pieces(df.where("false"), limits).count() == 0 and S.split_pieces(df, limits.where("false")).count() == 0
