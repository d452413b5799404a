import io
import zipfile

from pyspark.sql import functions as F

from quire.operators import dialogue, manifest, review, structure
from quire.sources import loaders
from quire.streaming import events

CHUNKS = "row_id bigint, book_id bigint, chapter_index int, chunk_index int, voice_label string, text string, boundary_after string, pause_after_ms int, synthesized boolean, failed boolean, audio_file string"


def chunks(spark):
    rows = [(1, 1, 0, 5, "men", "ab", "", 100, True, False, "f"), (2, 1, 0, 5, "men", "c", "scene", 900, False, False, None), (3, 1, 0, 9, "women", None, None, None, None, None, None), (4, 1, 1, 0, "men", "Один. Два.", "", 0, True, True, "")]
    return spark.createDataFrame(rows, CHUNKS)


def test_manifest(spark):
    c = chunks(spark)
    assert {r.row_id: r.chunk_index for r in manifest.renumber(c).collect()} == {1: 0, 2: 1, 3: 2, 4: 0}
    t = {r.row_id: (r.pause_before_ms, r.start_ms) for r in manifest.timeline(c, F.lit(10)).collect()}
    assert t == {1: (0, 0)}
    spoken = c.withColumn("synthesized", F.lit(True)).withColumn("audio_file", F.lit("f"))
    t = {r.row_id: (r.pause_before_ms, r.start_ms) for r in manifest.timeline(spoken, F.lit(10)).collect()}
    assert t == {1: (0, 0), 2: (300, 310), 3: (900, 1220), 4: (0, 0)}
    assert sorted(r.row_id for r in manifest.flatten(manifest.nest(c)).collect()) == [1, 2, 3, 4]
    halves = manifest.split_at(c, spark.createDataFrame([(4, 5)], "row_id bigint, split_at int")).filter("chapter_index = 1").orderBy("chunk_index").collect()
    assert [h.text for h in halves] == ["Один.", "Два."]
    merged = manifest.merge_with_next(c, spark.createDataFrame([(1,)], "row_id bigint")).filter("chapter_index = 0").orderBy("chunk_index").collect()
    assert [(m.text, m.boundary_after) for m in merged] == [("ab c", "scene"), (None, None)]
    assert manifest.renumber(c.limit(0)).count() == 0


def test_dialogue(spark):
    rows = spark.createDataFrame([(1, 0, 0, "— Это ты? — спросила она. — Да.\nТишина."), (2, 0, 1, None)], "row_id bigint, c int, i int, text string")
    lines = dialogue.dialogue_lines(rows, ["c", "i"]).orderBy("line_index", "part").collect()
    assert [(x.line, x.is_dialogue) for x in lines] == [("Это ты?", True), ("спросила она.", False), ("Да.", True), ("Тишина.", False)]
    told = dialogue.attribute(dialogue.dialogue_lines(rows, ["c", "i"]), ["c"], ["i", "line_index", "part"]).orderBy("line_index", "part").collect()
    assert [t.role for t in told] == ["female", "narrator", "male", "narrator"]
    packed = spark.createDataFrame([("Aa bb. Cc dd. Ee.",)], "t string").select(dialogue.chunk_text(F.col("t"), 14).alias("o")).first().o
    assert packed == ["Aa bb. Cc dd.", "Ee."]


def test_structure(spark):
    lines = [("Глава 3", "chapter_numeric"), ("ГЛАВА двадцать первая", "chapter_word"), ("Chapter twelve", "chapter_en"), ("Тарау бірінші", "chapter_kk"), ("Chapter IV", "chapter_en"), ("第三章", "chapter_zh"), ("Bob 2", "chapter_uz"), ("Глава о другом", None), ("", None)]
    got = spark.createDataFrame([(x,) for x, _ in lines], "l string").select(structure.chapter_kind(F.col("l")).alias("k")).collect()
    assert [g.k for g in got] == [k for _, k in lines]


def test_review(spark):
    rows = spark.createDataFrame([(1, "Это сл0во ,и так!!!!"), (2, None), (3, "")], "row_id bigint, text string")
    kinds = {r.kind for r in review.issues(rows, ["row_id"]).collect()}
    assert kinds == {"digit_in_word", "space_before_mark", "too_many_marks"}
    decisions = spark.createDataFrame([(1, 0, "Это ", "сл0во", " ", "слово")], "row_id bigint, ord int, before string, original string, after string, replacement string")
    assert review.apply_decisions(rows, decisions).filter("row_id = 1").first().text.startswith("Это слово")
    assert spark.createDataFrame([("api_key=abc Bearer x.y",)], "t string").select(review.redact(F.col("t")).alias("o")).first().o == "api_key=[redacted] Bearer [redacted]"


def test_loaders(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Первый\n\nВторой".encode("cp1251"))
    (tmp_path / "b.fb2").write_text("<FictionBook><body><section><title><p>T</p></title><p>One</p><section><p>Two</p></section></section></body></FictionBook>")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("c.xhtml", "<html><body><h1>T</h1><p>Three</p></body></html>")
    (tmp_path / "c.epub").write_bytes(data.getvalue())
    (tmp_path / "d.docx").write_bytes(b"broken")
    rows = loaders.read_books(spark, str(tmp_path)).collect()
    texts = {(r.format, r.raw_text) for r in rows if r.error is None}
    assert texts == {("txt", "Первый"), ("txt", "Второй"), ("fb2", "One"), ("fb2", "Two"), ("epub", "Three")}
    assert [r.format for r in rows if r.error] == ["docx"]
    assert loaders.checksums(spark, str(tmp_path)).count() == 4


def test_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame([("2024-01-01 10:05:00", "a", 1.0), ("2024-01-01 10:55:00", "a", 2.0), ("2024-01-01 11:05:00", "b", 3.0)], "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    e.write.parquet(str(tmp_path / "in"))
    s = events.windowed_counts(events.read_stream(spark, str(tmp_path / "in"), "ts timestamp, event_type string, value double"))
    s.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, events.windowed_counts(e).collect()))
