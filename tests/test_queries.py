from quire.plans import pages, reference


def test_suspicious_changes_over_the_whole_pipeline(spark, tmp_path):
    rows = [(1, "Ему было 25 лет, и -- она ушла."), (1, None), (1, "Он ждал..."), (2, None), (3, "[1],,,,,,,, 7"), (None, "да")]
    spark.createDataFrame(rows, "book_id bigint, text string").write.parquet(f"{tmp_path}/manifest_chunks.parquet")
    got = {r.book_id: r for r in reference.a9_suspicious_changes(spark, str(tmp_path)).collect() if r.n_before is not None and r.book_id is not None}
    assert set(got) == {1, 3}
    one, three = got[1], got[3]
    # "Ему было двадцать пять лет, и — она ушла." and "Он ждал…"
    assert (one.median_before, one.n_before, one.marks_before) == (20.5, 2, 5)
    assert (one.median_after, one.n_after, one.marks_after) == (24.5, 2, 4)
    assert not one.median_changed and not one.count_changed
    # ", семь"
    assert (three.marks_before, three.marks_after, three.marks_lost) == (8, 1, True)


def test_recordings_are_made_one_at_a_time(spark, tmp_path):
    rows = [(1, None, None), (2, "а" * 100, 900), (3, "", 100)]
    spark.createDataFrame(rows, "row_id bigint, text string, pause_after_ms int").write.parquet(f"{tmp_path}/chunk_specs.parquet")
    df = pages.q7_recordings(spark, str(tmp_path))
    got = {r.row_id: r for r in df.collect()}
    assert {k: r.duration_ms for k, r in got.items()} == {1: 300.0, 2: 2700.0, 3: 400.0}
    assert {k: r.silences for k, r in got.items()} == {1: 0, 2: 1, 3: 0}
    assert [tuple(x) for x in got[2].kept] == [(0, 1650), (2100, 2700)]
    # no column of the plan holds a recording
    assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()
