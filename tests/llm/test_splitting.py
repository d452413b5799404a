from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm.splitting import cut_text, split_oversized, with_profile

TEXT = st.text(alphabet=st.sampled_from("ab й.!, \n。，字́"), max_size=200)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(1, 60), st.integers(0, 59))
def test_pieces_cover_the_text(text, limit, overlap):
    spans = cut_text(text, limit, overlap)
    overlap = min(overlap, limit - 1)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    if len(text) > limit:
        assert all(b - a <= limit for a, b in spans)
        assert all(x[1] - y[0] == overlap and y[0] > x[0] for x, y in zip(spans, spans[1:]))
    else:
        assert spans == [(0, len(text))]


def test_prefers_sentences_to_words():
    text = "One two three four. Five six seven eight nine ten."
    assert text[: cut_text(text, 30, 0)[0][1]] == "One two three four. "
    assert cut_text("x" * 25, 10, 2) == [(0, 10), (8, 18), (16, 25)]


def test_rows_and_dirty_values(spark):
    rows = [(1, "a" * 25, "short", "scene"), (1, "a" * 25, "short", "scene"), (2, None, "short", None), (3, "", "short", ""), (4, "b" * 25, None, None), (5, "c" * 25, "unknown", ""), (6, "d" * 10, "short", "")]
    df = spark.createDataFrame(rows, "row_id bigint, text string, chunker string, boundary_after string").withColumn("piece_no", F.lit(7))
    profiles = spark.createDataFrame([("short", 10, 2), ("default", 20, 0)], "chunker string, max_chunk_chars int, overlap_chars int")

    def run(d):
        return split_oversized(with_profile(d, profiles), ["row_id"], F.col("text"), F.col("max_chunk_chars"), F.col("overlap_chars"), F.col("boundary_after")).collect()

    out = run(df)
    assert sorted(r.row_id for r in out) == [1, 1, 4]
    pieces = next(r.pieces for r in out if r.row_id == 1)
    assert [p.boundary_after for p in pieces] == ["", "", "scene"] and next(r.pieces for r in out if r.row_id == 4)[-1].boundary_after is None
    assert run(df.limit(0)) == []
