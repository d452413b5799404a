"""Queries of segments, chunks and speakers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import chunking, dialogue
from quire.plans.registry import query
from quire.sources.tables import table

_GROUP, _ORDER = ["book_id", "chapter_index"], ["chunk_index", "row_id"]
_W = "PARTITION BY book_id, chapter_index ORDER BY chunk_index, row_id"
_RANK = "coalesce(list_position(['', 'speaker', 'paragraph', 'scene', 'chapter'], lower(trim(coalesce({}, '')))), 1)"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest_chunks")


@query()
def d2_quoted_speech(spark: SparkSession, d: str) -> DataFrame:
    """Lines with quotations taken apart into speech and narration."""
    lines = _chunks(spark, d).select("row_id", F.posexplode(F.split("text", "\n")).alias("line_index", "line")).filter(F.col("line").contains("«"))
    return lines.select("row_id", "line_index", F.posexplode(chunking.quoted_speech(F.col("line"))).alias("part", "_p")).select("row_id", "line_index", "part", "_p.text", "_p.is_dialogue")


@query("SELECT row_id, 'ch' || lpad(CAST(chapter_index AS VARCHAR), 3, '0') || ':ord' || lpad(CAST(chunk_index AS VARCHAR), 4, '0') || ':line0000:' || substr(sha1(trim(text)), 1, 12) AS key FROM manifest_chunks")
def d4_line_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys by which annotations from outside find their lines."""
    return _chunks(spark, d).select("row_id", chunking.line_key(F.col("chapter_index"), F.col("chunk_index"), F.lit(0), F.col("text")).alias("key"))


@query("SELECT book_id, count(*) FILTER (voice_label = 'narrator') AS narrator, count(*) FILTER (voice_label = 'men') AS male, count(*) FILTER (voice_label = 'women') AS female, count(*) FILTER (coalesce(voice_label, '') NOT IN ('narrator', 'men', 'women')) AS unknown FROM manifest_chunks GROUP BY book_id")
def d5_attribution_counts(spark: SparkSession, d: str) -> DataFrame:
    label = F.coalesce("voice_label", F.lit(""))
    counts = {"narrator": label == "narrator", "male": label == "men", "female": label == "women", "unknown": ~label.isin("narrator", "men", "women")}
    return _chunks(spark, d).groupBy("book_id").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


@query(f"""
SELECT row_id, ['', 'speaker', 'paragraph', 'scene', 'chapter'][greatest({_RANK.format('boundary_after')}, {_RANK.format('nb')})] AS boundary_after, greatest(coalesce(pause_after_ms, 0), coalesce(np, 0)) AS pause_after_ms
FROM (SELECT *, lead(boundary_after) OVER w AS nb, lead(pause_after_ms) OVER w AS np FROM manifest_chunks WINDOW w AS ({_W}))""")
def d7_merged_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """The boundary and pause that each chunk would have if it were merged with the next."""
    from quire.operators.manifest import chapter_order

    w = chapter_order()
    rows = _chunks(spark, d).withColumns({"nb": F.lead("boundary_after").over(w), "np": F.lead("pause_after_ms").over(w)})
    return rows.select("row_id", chunking.stronger(F.col("boundary_after"), F.col("nb")).alias("boundary_after"), F.greatest(F.coalesce("pause_after_ms", F.lit(0)), F.coalesce("np", F.lit(0))).alias("pause_after_ms"))


_SAME = ["voice_label", "voice_id", "emotion", "speaker"]
_TUPLE = "{" + ", ".join(f"'{c}': coalesce({c}, '')" for c in _SAME) + "}"


@query(f"""
WITH r AS (SELECT * FROM manifest_chunks WHERE trim(text, ' ') <> ''), n AS (SELECT *, CASE WHEN lag({_TUPLE}) OVER w <> {_TUPLE} OR coalesce(lag(pause_after_ms) OVER w, 0) > 0 THEN 1 ELSE 0 END AS new FROM r WINDOW w AS ({_W}))
SELECT row_id, CAST(sum(new) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM n""")
def d8_islands(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of one voice, feeling and speaker."""
    return chunking.islands(_chunks(spark, d).filter("trim(text) <> ''"), _GROUP, _ORDER, _SAME, "pause_after_ms").select("row_id", "island")


@query()
def d8_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Those neighbours joined and cut to size."""
    return chunking.chunks_of_segments(_chunks(spark, d), _GROUP, _ORDER, _SAME)


@query()
def d9_coalesced(spark: SparkSession, d: str) -> DataFrame:
    """Chunks joined greedily with their like."""
    return chunking.coalesce_chunks(_chunks(spark, d), _GROUP, _ORDER, ["voice_id", "voice_label"], 600)


@query()
def d12_tidied(spark: SparkSession, d: str) -> DataFrame:
    """Documents in chunks, without dangling starts and tiny chunks."""
    t = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", dialogue.chunk_text(F.col("text"), 600, 200).alias("_c"))
    return t.select("doc_id", F.posexplode(chunking.without_tiny(chunking.without_dangling(F.col("_c")), 600)).alias("chunk_index", "text"))


@query()
def d13_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chapters: paragraphs packed, scenes and the chapter's end marked."""
    t = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(chunking.chunk_chapter(F.col("text"))).alias("chunk_index", "_x"))
    return t.select("doc_id", "chunk_index", "_x.*")


@query(f"""
WITH n AS (SELECT *, CASE WHEN coalesce(lag(voice_label) OVER w, voice_label, '') <> coalesce(voice_label, '') AND lag(row_id) OVER w IS NOT NULL THEN 1 ELSE 0 END AS new FROM manifest_chunks WINDOW w AS ({_W}))
SELECT book_id, chapter_index, CAST(island AS BIGINT) AS island, count(*) AS chunks, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM (SELECT *, sum(new) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS island FROM n) GROUP BY book_id, chapter_index, island""")
def d14_voice_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one voice in a chapter."""
    return chunking.islands(_chunks(spark, d), _GROUP, _ORDER, ["voice_label"]).groupBy(*_GROUP, "island").agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


@query()
def d15_windows(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of each document packed into windows of at most 2000 characters."""
    t = table(spark, d, "documents").filter("text IS NOT NULL")
    paragraphs = F.filter(F.split("text", r"\n[ \t]*\n+"), lambda p: F.trim(p) != "")
    return t.select("doc_id", F.posexplode(dialogue.pack(paragraphs, 2000, "\n\n")).alias("window", "text"))


@query("""
SELECT m.row_id, s.voice_label AS annotated_voice_label, s.chunker AS annotated_chunker FROM manifest_chunks m
LEFT JOIN (SELECT * FROM chunk_specs QUALIFY row_number() OVER (PARTITION BY book_id, chapter_index, chunk_index ORDER BY row_id DESC) = 1) s ON s.book_id = m.book_id AND s.chapter_index = m.chapter_index AND s.chunk_index = m.chunk_index""")
def d16_annotated(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with what the other table says of their place; its last row counts."""
    rows = table(spark, d, "chunk_specs").select("book_id", "chapter_index", "chunk_index", "row_id", "voice_label", "chunker")
    units = _chunks(spark, d).select("row_id", "book_id", "chapter_index", "chunk_index")
    return chunking.annotated(units, rows, ["book_id", "chapter_index", "chunk_index"], ["voice_label", "chunker"], "row_id").select("row_id", "annotated_voice_label", "annotated_chunker")


@query(rf"SELECT row_id, regexp_matches(text, '^\s*[—–-]\s') AS dash_speech, regexp_matches(text, '^\s*[«“„「]') AS quoted, regexp_matches(text, '(^|[^\p{{L}}])({chunking.VERBS})($|[^\p{{L}}])') AS has_verb FROM manifest_chunks WHERE text IS NOT NULL")
def d18_markers(spark: SparkSession, d: str) -> DataFrame:
    """Marks of direct speech in each chunk."""
    t, c = _chunks(spark, d).filter("text IS NOT NULL"), F.col("text")
    return t.select("row_id", c.rlike(r"^\s*[—–-]\s").alias("dash_speech"), c.rlike("^\\s*[«“„「]").alias("quoted"), c.rlike(rf"(?<![\p{{L}}])(?:{chunking.VERBS})(?![\p{{L}}])").alias("has_verb"))


_NAMED = rf"""coalesce(list_filter(regexp_extract_all(coalesce(text, ''), '(?:{chunking.VERBS})\s+([А-ЯЁ][а-яё]+(?:\s[А-ЯЁ][а-яё]+)?)', 1), lambda x: x <> '')[-1],
 list_filter(regexp_extract_all(coalesce(text, ''), '(?:{chunking.VERBS_EN})\s+([A-Z][a-z]+(?:\s[A-Z][a-z]+)?)|([A-Z][a-z]+)\s(?:{chunking.VERBS_EN})', 1), lambda x: x <> '')[-1], list_filter(regexp_extract_all(coalesce(text, ''), '([一-鿿]{{2,4}}?)(?:说|问|答|喊|道)[：:，]', 1), lambda x: x <> '')[-1])"""
_CUE = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '(?i){p}') THEN '{e}'" for e, p in chunking.CUES) + " END"


@query(f"SELECT row_id, {_NAMED} AS speaker FROM manifest_chunks WHERE {_NAMED} IS NOT NULL")
def d20_named_speakers(spark: SparkSession, d: str) -> DataFrame:
    """Speakers that a remark names."""
    return _chunks(spark, d).select("row_id", chunking.speaker_named(F.coalesce("text", F.lit(""))).alias("speaker")).filter("speaker IS NOT NULL")


@query(rf"""
WITH x AS (SELECT *, voice_label IN ('men', 'women') AS say, {_NAMED} AS name, {_CUE} AS cue, regexp_matches(coalesce(text, ''), '(?i)(?:{chunking.THOUGHTS})') AS think FROM manifest_chunks),
 y AS (SELECT *, NOT coalesce(lead(say) OVER w, true) AS na, NOT coalesce(lag(say) OVER w, true) AS nb, lead(name) OVER w AS ln, lead(cue) OVER w AS lc, lag(cue) OVER w AS bc, lead(think) OVER w AS lt FROM x WINDOW w AS ({_W}))
SELECT row_id, CASE WHEN coalesce(say, false) AND na THEN ln END AS tag_speaker, CASE WHEN coalesce(say, false) THEN coalesce(cue, CASE WHEN na THEN lc END, CASE WHEN nb THEN bc END) END AS cue_emotion,
 coalesce(say, false) AND regexp_matches(coalesce(text, ''), '^\s*[«“"]') AND coalesce(CASE WHEN na THEN lt END, false) AS is_thought FROM y""")
def d21_repaired_speakers(spark: SparkSession, d: str) -> DataFrame:
    """Speaker, feeling and thought that the remark beside speech tells."""
    return chunking.repaired_speakers(_chunks(spark, d), _GROUP, _ORDER).select("row_id", "tag_speaker", "cue_emotion", "is_thought")


@query(r"""
SELECT m.book_id, m.chapter_index, regexp_replace(string_agg(coalesce(m.text, ''), '' ORDER BY m.chunk_index, m.row_id), '\s+', '', 'g') = regexp_replace(string_agg(coalesce(m.text, ''), ' ' ORDER BY m.chunk_index, m.row_id), '\s+', '', 'g') AS preserved FROM manifest_chunks m GROUP BY m.book_id, m.chapter_index""")
def d24_preserved(spark: SparkSession, d: str) -> DataFrame:
    """Whether the chunks of a chapter are its text."""
    units = _chunks(spark, d).select(*_GROUP, *_ORDER, "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*_ORDER, F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), " ")
    return chunking.preserved(units, units.groupBy(*_GROUP).agg(joined.alias("text")), _GROUP, _ORDER)


@query(r"""
SELECT row_id, issue FROM (SELECT row_id, CASE WHEN voice_label = 'narrator' AND regexp_matches(coalesce(text, ''), '^\s*[—–-]\s') THEN 'dialogue_in_narrator_voice'
 WHEN voice_label = 'men' AND starts_with(voice_id, 'female') OR voice_label = 'women' AND starts_with(voice_id, 'male') THEN 'voice_of_other_gender'
 WHEN voice_label IN ('men', 'women') AND (name = '' OR regexp_matches(name, '^[0-9]+$')) THEN 'speaker_is_no_person'
 WHEN voice_label = 'men' AND regexp_matches(name, '(?:а|я|ова|ева|ина)$') AND regexp_matches(name, '^[А-ЯЁ][а-яё]+$') THEN 'gender_uncertain' END AS issue FROM (SELECT *, trim(coalesce(speaker, '')) AS name FROM manifest_chunks)) WHERE issue IS NOT NULL""")
def d26_assignments(spark: SparkSession, d: str) -> DataFrame:
    return chunking.assignment_issues(_chunks(spark, d))


@query("SELECT row_id, CASE WHEN voice_label IN ('narrator', 'men', 'women') THEN voice_label ELSE 'narrator' END AS voice, trim(text) AS text FROM chunk_specs WHERE trim(text) <> ''")
def d28_parsed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as a model would answer, and read again."""
    t = table(spark, d, "chunk_specs").filter("text IS NOT NULL")
    voice = F.when(F.col("voice_label").isin("men", "women", "narrator"), F.col("voice_label"))
    answer = F.concat(F.lit("```json\n"), F.to_json(F.array(F.struct(voice.alias("voice"), F.col("text").alias("text")))), F.lit("\n```"))
    return t.select("row_id", F.inline(chunking.parsed_items(answer)))
