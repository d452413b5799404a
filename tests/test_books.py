import io
import struct
import wave
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import metrics
from quire.operators import audio, characters, chunking, manifest, ocr, review, stress, structure, works
from quire.sources import loaders

P = "book_id bigint, pos int, text string"


def paragraphs(spark, *texts, book=1):
    return spark.createDataFrame([(book, i, t) for i, t in enumerate(texts)], P)


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


# structure


def test_works_and_chapters(spark):
    df = paragraphs(spark, "вступление, довольно длинное", "Книга 1", "Глава 1", "текст первой главы", "Глава 2\nтекст второй", "Том второй. Зима", "Глава 1", "конец всей книги", None)
    got = works.chapters(df, ["pos"]).orderBy("pos").collect()
    assert [(r.work, r.chapter) for r in got] == [(0, 0), (1, 0), (1, 1), (1, 1), (1, 2), (2, 2), (2, 3), (2, 3), (2, 3)]
    assert [r.kind for r in works.heading_hits(df).orderBy("pos").collect()] == ["work_cyrillic", "chapter_numeric", "chapter_numeric", "work_cyrillic", "chapter_numeric"]
    table = works.chapter_table(works.chapters(df, ["pos"]), ["pos"])
    assert table.filter("title = 'Глава 2'").count() == 1 and works.sanity(table).count() == 1 and works.chapters(df.limit(0), ["pos"]).count() == 0
    summary = works.structure_summary(table).first()
    assert summary.work_count == 2 and summary.repeated_titles == ["глава 1"] and summary.needs_review


def test_running_sums_equal_a_window(spark):
    import random

    rng = random.Random(1)
    df = spark.createDataFrame([(b if rng.random() < 0.5 else 1, i, "x" * rng.randint(0, 5)) for i, b in enumerate(rng.choices(range(5), k=400))], P)
    got = {(r.book_id, r.pos): r.s for r in works.running_sums(df, "book_id", ["pos"], {"s": F.length("text")}).collect()}
    total: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r.book_id, r.pos)):
        total[r.book_id] = total.get(r.book_id, 0) + len(r.text)
        assert got[r.book_id, r.pos] == total[r.book_id]


def test_orphans_and_resets(spark):
    df = paragraphs(spark, "Глава 1", "a", "Глава 2", "b", "Глава 3", "c", "Глава [М", "d", "Глава о жизни и смерти")
    assert [r.pos for r in works.orphan_headings(df, works.heading_hits(df)).collect()] == [6]
    books = paragraphs(spark, "1. Первая повесть", "слова", "Глава 1", "a", "Глава 2", "b", "c", "d", "Глава 1", "e")
    assert {(r.pos, r.title) for r in works.works_from_resets(books, ["pos"]).collect()} == {(0, "1. Первая повесть"), (8, None)}


def test_contents(spark):
    text = "Введение\nОглавление\nГЛАВА 1. Начало пути ..... 5\n1. Медведь и лиса ... 7\n2. Зимовье ... 9\n2.1. Печка в доме ... 10\nЗаключение\n" + "x" * 210 + "\nНачало пути\nконец"
    docs = spark.createDataFrame([(1, text), (2, "нет"), (3, None)], "doc_id bigint, text string").filter("text IS NOT NULL")
    assert [tuple(r) for r in works.contents_ranges(docs).collect()] == [(1, 1, 7)]
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    got = works.entries(lines).filter("pos BETWEEN 2 AND 6").orderBy("pos").collect()
    assert [(r.title, r.level) for r in got] == [("Начало пути", 0), ("Медведь и лиса", 1), ("Зимовье", 1), ("Печка в доме", 1), ("Заключение", 0)]
    body = works.entries_in_body(docs, works.entries(lines), works.contents_ranges(docs)).collect()
    assert [(r.pos, r.title) for r in body] == [(8, "Начало пути")]
    triples = spark.createDataFrame([(1, "Книга 1\nБольшая река\n7\nКнига 2\nЛес\nслово")], "doc_id bigint, text string")
    assert [tuple(r) for r in works.work_titles(triples).collect()] == [(1, 1, "Большая река")]


def test_overlap_and_special_paragraphs(spark):
    df = paragraphs(spark, "aaaa", "bbbb", "cccc")
    ranges = spark.createDataFrame([(1, 5, 7)], "book_id bigint, start int, end int")
    assert [r.pos for r in works.overlapping(df, ["pos"], ranges).collect()] == [1]
    s = paragraphs(spark, "Всё проходит в этом мире, из старой книги", "Глава 1", "Аннотация", "Это повесть о реке и людях у реки.", "да", "Ещё одна повесть о реке и людях.")
    got = {r.pos: r.section for r in works.special_paragraphs(s, ["book_id"], ["pos"]).collect()}
    assert got == {0: "epigraph", 1: None, 2: "annotation", 3: "annotation", 4: None, 5: None}
    segs = spark.createDataFrame([(1, 7, "повесть о реке и людях")], "book_id bigint, segment bigint, text string")
    assert [tuple(r) for r in works.mark_segments(segs, works.special_paragraphs(s, ["book_id"], ["pos"]), ["book_id"]).collect()] == [(1, 7, "annotation")]


def test_noise_among_numeric_headings(spark):
    rows = [(1, i, "numeric_heading", f"{n}. Слово") for i, n in enumerate((1, 2, 1, 2, 1))] + [(2, i, "numeric_heading", f"{i}. Слово") for i in range(5)]
    hits = structure.numbered(spark.createDataFrame(rows, "book_id bigint, pos int, kind string, line string"))
    assert {r.book_id for r in structure.without_numeric_noise(hits, ["pos"]).collect()} == {2}


# segments and chunks


def test_boundaries(spark):
    f = lambda a, b: spark.range(1).select(chunking.stronger(F.lit(a), F.lit(b)).alias("x")).first().x
    assert f("", "scene") == "scene" and f("chapter", "paragraph") == "chapter" and f(None, "odd") == ""


C = "row_id bigint, book_id bigint, chapter_index int, chunk_index int, voice_label string, voice_id string, speaker string, text string, boundary_after string, pause_after_ms int"


def test_islands_and_chunks(spark):
    rows = [(1, 1, 0, 0, "men", "m", "a", "Раз.", "", 0), (2, 1, 0, 1, "men", "m", "a", "Два.", "speaker", 0), (3, 1, 0, 2, "women", "w", None, "Три.", None, 300), (4, 1, 0, 3, "women", "w", None, "Четыре.", "scene", 900), (5, 1, 0, 4, "women", "w", None, " ", "", 0)]
    df = spark.createDataFrame(rows, C)
    got = chunking.chunks_of_segments(df, ["book_id", "chapter_index"], ["chunk_index", "row_id"], ["voice_label", "speaker"]).orderBy("island").collect()
    assert [(r.text, r.boundary_after, r.pause_after_ms) for r in got] == [("Раз. Два.", "speaker", 0), ("Три.", "", 300), ("Четыре.", "scene", 900)]
    one = chunking.coalesce_chunks(df, ["book_id", "chapter_index"], ["chunk_index", "row_id"], ["voice_label"], 12).orderBy("chunk_index").collect()
    assert [(r.text, r.chunks) for r in one] == [("Раз. Два.", 2), ("Три. Четыре.", 2), ("", 1)]
    assert chunking.chunks_of_segments(df.limit(0), ["book_id", "chapter_index"], ["chunk_index"], ["voice_label"]).count() == 0


def test_tidying(spark):
    run = lambda chunks, f: spark.createDataFrame([(chunks,)], "c array<string>").select(f(F.col("c")).alias("x")).first().x
    assert run(["Он ушёл. А потом", "снег пошёл."], chunking.without_dangling) == ["Он ушёл.", "А потом снег пошёл."]
    assert run(["Он ушёл.", "Да"], lambda c: chunking.without_tiny(c, 50)) == ["Он ушёл. Да"] and run(["Да", "Он ушёл."], lambda c: chunking.without_tiny(c, 50)) == ["Да Он ушёл."]
    assert run([], chunking.without_dangling) == []


def test_chapters(spark):
    text = "Первый абзац.\n\nВторой.\n\n***\n\n" + "Длинное предложение тут. " * 5 + "\n\nКонец."
    got = [(r.text[:12], r.boundary_after) for r in value(spark, text, lambda c: chunking.chunk_chapter(c, 60))]
    assert got[0] == ("Первый абзац", "scene") and got[-1] == ("Конец.", "chapter") and all(b == "paragraph" for _, b in got[1:-1])
    assert value(spark, "", chunking.chunk_chapter) == [] and value(spark, None, chunking.chunk_chapter) is None


def test_speakers(spark):
    said = "Он сказал: «Иди сюда». Потом взял книгу «Дом» со стола."
    assert [(x.text, x.is_dialogue) for x in value(spark, said, chunking.quoted_speech)] == [("Он сказал:", False), ("Иди сюда", True), (". Потом взял книгу", False), ("«Дом»", False), ("со стола.", False)]
    assert value(spark, "— Да, — ответил Иван Петров.", chunking.speaker_named) == "Иван Петров" and value(spark, "Тишина.", chunking.speaker_named) is None
    rows = [(1, 1, 0, 0, "men", "", "", "«Ну вот»", "", 0), (2, 1, 0, 1, "narrator", "", "", "подумал и прошептал Иван", "", 0), (3, 1, 0, 2, "men", "female_a", "9", "Да", "", 0)]
    got = {r.row_id: (r.tag_speaker, r.cue_emotion, r.is_thought) for r in chunking.repaired_speakers(spark.createDataFrame(rows, C), ["book_id"], ["chunk_index"]).collect()}
    assert got == {1: ("Иван", "whisper", True), 2: (None, None, False), 3: (None, "whisper", False)}
    assert [tuple(r) for r in chunking.assignment_issues(spark.createDataFrame(rows, C)).collect()] == [(1, "speaker_is_no_person"), (3, "voice_of_other_gender")]


def test_answers(spark):
    text = 'так:\n```json\n[{"men": " Да "}, {"voice": "women", "text": "Нет"}, {"text": " "}]\n```'
    assert [(x.voice, x.text) for x in value(spark, text, chunking.parsed_items)] == [("men", "Да"), ("women", "Нет")]


# pages


def test_recognised_pages(spark):
    assert value(spark, ". ~ |", ocr.is_noise_line) and not value(spark, "Обычная строка текста.", ocr.is_noise_line)
    good = "Говорили, что старый плотник починил серебряную шкатулку на чердаке и никому ничего не сказал об этом."
    assert spark.createDataFrame([(good, "ru"), ("~#~ 12 §", "ru"), (None, "ru")], "t string, l string").select(ocr.is_usable(F.col("t"), F.col("l")).alias("u")).collect() == [(True,), (False,), (False,)]
    assert value(spark, "конец строки ГЛАВА IV начало\nГлава 2\nещё", ocr.split_at_headings) == ["конец строки", "ГЛАВА IV", "начало", "Глава 2", "ещё"]
    assert value(spark, "| Старый плот-\nник сидел у реки 17\n~ . |\n\nПотом ушёл.", ocr.clean_page) == "Старый плотник сидел у реки\n\nПотом ушёл."
    assert spark.range(1).select(ocr.drop_caps(F.lit("тром голова болела"), F.lit(True)).alias("x")).first().x == "Утром голова болела"
    v = spark.createDataFrame([(1, 1, 1, "native", good, 1, 1), (1, 1, 1, "ocr", good * 3, 1, 2), (1, 2, 1, "ocr", good, 1, 3), (1, 3, 1, "native", "x", 1, 4), (1, 4, 1, "native", None, 1, 5)], "book_id bigint, first_page int, page_count int, kind string, text string, extracted_at int, row_id bigint")
    got = {r.first_page: (r.chosen, r.reason) for r in ocr.choose_variant(v, F.lit("ru")).collect()}
    assert got == {1: ("ocr", "ocr_more_complete"), 2: ("ocr", "ocr_usable"), 3: ("native", "none_usable"), 4: (None, "none_usable")}


def test_geometry(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    e = spark.createDataFrame([(1, (0.0, 80.0, 50.0, 90.0), "b"), (1, (0.0, 95.0, 50.0, 99.0), "a"), (1, (10.0, 10.0, 20.0, 20.0), "cell")], f"page int, box {box}, text string")
    t = spark.createDataFrame([(1, (5.0, 5.0, 30.0, 30.0))], f"page int, box {box}")
    assert [r.text for r in ocr.reading_order(e, ["page"], t).orderBy("place").collect()] == ["a", "b"]


# stress and sound


def test_stress(spark):
    assert value(spark, "Да, нет.", stress.tokens) == ["Да", ", ", "нет", "."] and value(spark, "молоко", stress.vowels) == 3
    assert value(spark, "молоко", lambda c: stress.stressed(c, F.lit(3))) == "молоко́" and value(spark, "дом", lambda c: stress.stressed(c, F.lit(2))) == "дом"
    assert value(spark, "молоко́", lambda c: stress.rendered(c, "double_vowel")) == "молокоо" and value(spark, "Молоко", lambda c: stress.transferred(c, F.lit("молоко́"))) == "Молоко́"
    words = stress.words_of(spark.createDataFrame([(1, "Старый дом, река")], "id int, t string"), ["id"], "t")
    d = lambda *rows: spark.createDataFrame(rows, "word string, form string")
    got = {r.word: (r.form, r.origin) for r in stress.resolve(words, d(("река", "река́")), d(("река", "ре́ка"))).collect()}
    assert got == {"старый": (None, "unknown"), "дом": ("дом", "single"), "река": ("река́", "user")}
    with pytest.raises(ValueError):
        stress.rendered(F.lit("a"), "odd")


def wav(x, rate=8000, width=2):
    data = io.BytesIO()
    with wave.open(data, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes((np.asarray(x) * (127 if width == 1 else 32767) + (128 if width == 1 else 0)).astype("u1" if width == 1 else "<i2").tobytes())
    return data.getvalue()


def test_sound(spark):
    t = np.arange(8000)
    tone = 0.5 * np.sin(t * 0.3)
    gap = np.concatenate((tone, np.zeros(8000), tone))
    drop = np.concatenate((tone[:4000], np.zeros(1280), tone[:4000]))
    rows = [(1, wav(tone)), (2, wav(np.zeros(8000))), (3, wav(gap)), (4, b"no wav"), (5, None), (6, wav(np.sign(tone) * 0.9)), (7, wav(tone, width=1)), (8, wav([]))]
    m = audio.inspect(spark.createDataFrame(rows, "id int, content binary"), ["id"]).withColumn("issues", audio.issues(F.lit(1000.0))).withColumn("kept", audio.kept_ranges(F.col("silences"), F.col("duration_ms")))
    got = {r.id: r for r in m.collect()}
    assert got[1].duration_ms == 1000 and abs(got[1].peak - 0.5) < 0.01 and got[1].silences == [] and got[2].issues[0] == "silent" and got[4].error and got[5].error
    assert [(s.start_ms, s.end_ms, s.kind) for s in got[3].silences] == [(1000, 2000, "internal")] and [tuple(k) for k in got[3].kept] == [(0, 1450), (2000, 3000)]
    assert "clipping" in got[6].issues and abs(got[7].peak - 0.5) < 0.02 and got[8].duration_ms == 0
    assert audio.dropout_score(drop, 8000) > 0 and audio.repeat_score(np.concatenate((tone[:1600] * np.linspace(1, 0.1, 1600),) * 5), 8000) > 0.5 and struct.calcsize("<i") == 4


# metrics


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    assert metrics.edit_distance(a, b) == row[-1]


def test_alignment(spark):
    df = spark.createDataFrame([("a b c d", "a b x d d"), ("", ""), (None, "a"), ("", "a")], "e string, a string")
    got = [r.x for r in df.select(metrics.aligned(F.col("e"), F.col("a")).alias("x")).collect()]
    assert (got[0].wer, got[0].matched_ratio, got[0].repeated_score) == (0.5, 0.75, 0.2) and got[0].missing_spans[0].words == ["c"] and (got[1].wer, got[1].matched_ratio) == (0.0, 1.0) and got[2] is None and got[3].wer == 1.0
    assert metrics.correction_issues("Он ушёл домой.", "Он ушел домой.") == [] and "similarity" in metrics.correction_issues("Он ушёл домой.", "Совсем другое") and metrics.correction_issues("Дом у реки", "Дом у рeки", title=True) == []


# manifest, review, characters


def test_voices(spark):
    f = lambda v, fb: spark.range(1).select(manifest.role_for_voice(F.lit(v), F.lit(fb)).alias("x")).first().x
    assert f("MALE_deep", "female") == "male" and f("men", "") == "male" and f("malefic", "female") == "female" and f(None, "odd") == "narrator"
    o = manifest.generation_options(F.lit(0), F.lit(0), F.lit(0))["seed"], manifest.generation_options(F.lit(0), F.lit(0), F.lit(1))["seed"]
    assert spark.range(1).select(o[0].alias("a"), o[1].alias("b")).first() == (42, 42 + 10007 + 101 + 7919)
    c = spark.createDataFrame([(1, "Иван", "sad", "", "men", ""), (2, None, None, "epigraph", None, "narrator_calm")], "row_id bigint, speaker string, emotion string, section_kind string, voice_label string, voice_id string")
    over = spark.createDataFrame([("speaker:Иван|emotion:sad", "x"), ("speaker:Иван", "y"), ("section:epigraph", "z")], "key string, voice string")
    assert {r.row_id: r.voice for r in manifest.resolve_voices(c, over, ["row_id"]).collect()} == {1: "x", 2: "z"}
    with pytest.raises(Exception):
        manifest.migrate(c, F.lit(3)).collect()


def test_manifest_round_trip(spark, tmp_path):
    rows = [(1, 1, 0, 1, "men", "m", "a", "Два", "", 5), (2, 1, 0, 0, None, None, None, None, None, None), (3, 2, 4, 0, "women", "w", "b", "", "scene", 0)]
    df = spark.createDataFrame(rows, C)
    loaders.write_manifest(manifest.nest(df), str(tmp_path / "m"))
    back = manifest.flatten(loaders.read_nested(spark, str(tmp_path / "m"), df)).select(*df.columns)
    assert sorted(map(tuple, back.collect())) == sorted(rows) and manifest.flatten(manifest.nest(df), chapter=5).count() == 1


def test_review_memory(spark):
    text = spark.createDataFrame([(1, "Да ,нет ,всё")], "row_id bigint, text string")
    got = review.occurrences(text, ["row_id"], "space_before_mark").orderBy("ord").collect()
    assert [(r.before, r.original, r.after) for r in got] == [("Да", " ,", "нет ,всё"), ("Да ,нет", " ,", "всё")]
    m = spark.createDataFrame([("a", "1", 1), ("b", "2", 5)], "original string, replacement string, updated_at int")
    n = spark.createDataFrame([("a", "3", 2), ("b", "4", 4), (None, "x", 9)], m.schema)
    assert {tuple(r)[:2] for r in review.upsert(m, n, ["original"]).collect()} == {("a", "3"), ("b", "2")}
    found = spark.createDataFrame([(1, "сл0во"), (2, "м0л")], "row_id bigint, first string")
    memory = spark.createDataFrame([("сл0во", "слово", True, True, 1), ("м0л", "мол", True, False, 1)], "original string, replacement string, confirmed boolean, auto_apply_safe boolean, updated_at int")
    assert {r.row_id: r.status for r in review.resolve(found, memory).collect()} == {1: "resolved", 2: "pending"}
    done = review.progress(spark.createDataFrame([(1,)], "row_id bigint"), found, ["row_id"]).first()
    assert (done.pending, done.resolved, done.percent) == (1, 1, 50.0)
    safe = lambda w: spark.range(1).select(review.safe_to_repeat(F.lit("digit_in_word"), F.lit(w)).alias("x")).first().x
    assert safe("сл0во") and not safe("СЛ0ВО") and not safe("сл00во") and not safe("0слово")


def test_characters(spark):
    rows = [(1, 1, 0, 0, "men", "", "Иван", "Да.", "", 0), (2, 1, 1, 0, "men", "", " иван ", "Нет.", "", 0), (3, 1, 1, 1, "narrator", "", None, "Шёл снег.", "", 0), (4, 1, 1, 2, "men", "", "", "Кто?", "", 0)]
    df = spark.createDataFrame(rows, C).withColumn("emotion", F.lit("calm"))
    got = {r.key: r for r in characters.character_bible(df).collect()}
    assert got["иван"].display_name in ("Иван", "иван") and got["иван"].segment_count == 2 and got["иван"].sample_lines == ["Да.", "Нет."] and got["narrator"].confidence == 1.0 and got["иван"].confidence == 0.81
    assert [r.row_id for r in characters.unresolved(df).collect()] == [4]
    assert characters.sample(df, ["book_id"], "row_id", 2).count() == 2


# files


def test_docx_and_manifest_files(spark, tmp_path):
    w = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'"
    p = lambda t, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Empty', 'Heading1')}{p('One', 'Heading1')}{p('Text')}</w:body></w:document>")
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    assert [(r.chapter_title, r.raw_text) for r in loaders.read_books(spark, str(tmp_path)).collect()] == [("One", "Text")]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.json").write_text('{"book_title": "B", "version": 2, "chapters": [{"chapter_index": 0, "chapter_title": "T", "chunks": [{"chunk_index": 0, "text": "Да"}]}]}')
    assert [(r.book_title, r.text) for r in loaders.read_manifest(spark, str(tmp_path / "m")).collect()] == [("B", "Да")]


def test_sinks(spark, tmp_path):
    ps = spark.createDataFrame([(1, 0, 2, "b", None), (1, 0, 1, "a", "A"), (2, 0, 0, "c", None), (2, 0, 1, None, None)], "book_id bigint, chapter_index int, para_index int, text string, normalized string")
    loaders.write_texts(ps, str(tmp_path / "t"))
    assert sorted(map(tuple, loaders.read_texts(spark, str(tmp_path / "t")).collect())) == [(1, 0, "a\n\nb"), (2, 0, "c")]
    assert sorted(map(tuple, loaders.spoken_text(ps).collect())) == [(1, 0, "A"), (2, 0, "c")]
    log = spark.createDataFrame([("load", "ok", "", "2024-01-01 00:00:00"), ("load", "ok", "", "2024-01-01 00:00:09")], "stage string, status string, details string, at string").withColumn("at", F.to_timestamp("at"))
    loaders.append_log(log, str(tmp_path / "log"))
    loaders.append_log(log, str(tmp_path / "log"))
    assert [tuple(r) for r in loaders.log_counters(spark, str(tmp_path / "log")).collect()] == [("load", "ok", 4, 9)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "002_chapter_02.txt").write_text("Два\n\nТри")
    (tmp_path / "c" / "notes.txt").write_text("x")
    assert [(r.chapter_index, r.raw_text) for r in loaders.read_chapter_directory(spark, str(tmp_path / "c")).collect()] == [(2, "Два"), (2, "Три")]


def test_front_matter(spark):
    body = ["Глава 1", "Глава 2", "Глава 3", "Глава 1", "текст", "Глава 2", "ещё"]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(body)] + [("b", i, t) for i, t in enumerate(body[:5])], "path string, pos int, raw_text string")
    got = [(r.path, r.pos) for r in loaders.without_front_matter(df).orderBy("path", "pos").collect()]
    assert got == [("a", i) for i in range(3, 7)] + [("b", i) for i in range(5)]


def test_production_quality(spark):
    from quire.operators import analytics

    rows = [(1, 1, 0, 0, "men", "", "a", "x", "", 400, True, None, "passed"), (2, 1, 0, 1, "men", "", "b", "x", "", 100, True, False, "warning"), (3, 1, 0, 2, "men", "", "c", "x", "", 0, None, False, None), (4, 1, 0, 3, "men", "", "c", "x", "", 0, True, True, "passed")]
    df = spark.createDataFrame(rows, C + ", synthesized boolean, deleted boolean, qa_status string")
    assert {r.row_id: (r.score, r.status) for r in analytics.production_qa(df).collect()} == {1: (100, "passed"), 2: (74, "review"), 3: (32, "resynthesize")}


def test_late_works_and_title_pages(spark):
    texts = ["Книга 1", "Книга 2"] + [f"Глава {i}" for i in range(1, 10)] + ["1. Поздняя повесть о реке", "Глава 1", "2. Другая поздняя повесть"]
    hits = works.heading_hits(paragraphs(spark, *texts))
    assert [(r.pos, r.line) for r in works.late_works(hits, ["pos"]).orderBy("pos").collect()] == [(11, "1. Поздняя повесть о реке"), (13, "2. Другая поздняя повесть")]
    assert works.late_works(works.heading_hits(paragraphs(spark, "Книга 1", "1. Поздняя повесть о реке")), ["pos"]).count() == 0
    doc = "Книга 1\nБольшая река\n7\nКнига 2\nТёмный лес\n90\n" + "x" * 210 + "\nБольшая река\nслова\nТемный лес\nконец"
    docs = spark.createDataFrame([(1, doc)], "doc_id bigint, text string")
    after = spark.createDataFrame([(1, 6)], "doc_id bigint, end_pos int")
    assert [(r.number, r.pos) for r in works.title_pages(docs, works.work_titles(docs), after).orderBy("number").collect()] == [(1, 7), (2, 9)]


def test_internal_sections(spark):
    long = "слово " * 2000
    df = paragraphs(spark, "Первая часть пути", long, long, "Вторая часть пути", long, "не заголовок, а строка")
    got = works.internal_sections(works.chapters(df, ["pos"]), ["pos"])
    assert [r.pos for r in got.orderBy("pos").collect()] == [0, 3] and works.internal_sections(works.chapters(df.filter("pos < 3"), ["pos"]), ["pos"]).count() == 0
