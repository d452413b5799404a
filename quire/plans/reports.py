"""Queries of characters, samples, checks and sinks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import normalize
from quire.operators import characters, dialogue
from quire.plans.registry import query
from quire.sources import loaders
from quire.sources.tables import table


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest_chunks")


_KEYED = r"""(SELECT *, CASE WHEN bare = '' THEN 'narrator' ELSE lower(bare) END AS key, nullif(bare, '') AS name, coalesce(voice_label IN ('men', 'women'), false) AS spoken, nullif(trim(coalesce(emotion, ''), ' '), '') AS emo,
 substr(regexp_replace(trim(coalesce(text, ''), ' '), '\s+', ' ', 'g'), 1, 220) AS line FROM (SELECT *, regexp_replace(trim(coalesce(speaker, ''), ' '), '\s+', ' ', 'g') AS bare FROM manifest_chunks))"""


@query(f"""
WITH r AS {_KEYED}, c AS (SELECT book_id, key, count(*) AS segment_count, count(*) FILTER (spoken) AS direct_speech_count, count(DISTINCT chapter_index) AS chapter_count FROM r GROUP BY ALL),
 n AS (SELECT book_id, key, arg_min(name, (-n, name)) AS display_name, list(name ORDER BY name) AS aliases FROM (SELECT book_id, key, name, count(*) AS n FROM r WHERE name IS NOT NULL GROUP BY ALL) GROUP BY ALL),
 o AS (SELECT book_id, key, arg_min(voice_label, (-n, voice_label)) AS label FROM (SELECT book_id, key, voice_label, count(*) AS n FROM r WHERE spoken GROUP BY ALL) GROUP BY ALL),
 e AS (SELECT book_id, key, list(emo || ':' || n ORDER BY -n, emo) AS emotions FROM (SELECT book_id, key, emo, count(*) AS n FROM r WHERE emo IS NOT NULL GROUP BY ALL) GROUP BY ALL),
 l AS (SELECT book_id, key, list(line ORDER BY rn) AS sample_lines FROM (SELECT *, row_number() OVER (PARTITION BY book_id, key ORDER BY chapter_index, chunk_index, row_id) AS rn FROM r WHERE line <> '') WHERE rn <= 6 GROUP BY ALL)
SELECT book_id, key, coalesce(display_name, 'Narrator') AS display_name, CASE label WHEN 'men' THEN 'male' WHEN 'women' THEN 'female' ELSE 'narrator' END AS role, coalesce(aliases, []) AS aliases, direct_speech_count, segment_count, chapter_count, coalesce(emotions, []) AS emotions,
 coalesce(sample_lines, []) AS sample_lines, round(CASE WHEN key = 'narrator' THEN 1.0 ELSE least(98, greatest(25, CASE WHEN direct_speech_count > 0 THEN 35 ELSE 0 END + CASE WHEN segment_count >= 2 THEN 20 ELSE 0 END + CASE WHEN len(coalesce(aliases, [])) >= 2 THEN 10 ELSE 0 END
 + CASE WHEN emotions IS NOT NULL THEN 10 ELSE 0 END + least(10, 3 * chapter_count))) / 100 END, 3)::DOUBLE AS confidence
FROM c LEFT JOIN n USING (book_id, key) LEFT JOIN o USING (book_id, key) LEFT JOIN e USING (book_id, key) LEFT JOIN l USING (book_id, key)""")
def a2_character_bible(spark: SparkSession, d: str) -> DataFrame:
    return characters.character_bible(_chunks(spark, d))


@query("SELECT row_id, book_id, chapter_index FROM manifest_chunks WHERE voice_label IN ('men', 'women') AND trim(coalesce(speaker, ''), ' ') = ''")
def a2_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return characters.unresolved(_chunks(spark, d)).select("row_id", "book_id", "chapter_index")


@query("SELECT book_id, row_id FROM (SELECT book_id, row_id, row_number() OVER (PARTITION BY book_id ORDER BY sha1('17:' || CAST(row_id AS VARCHAR)), row_id) AS rn FROM manifest_chunks) WHERE rn <= 5")
def a10_samples(spark: SparkSession, d: str) -> DataFrame:
    """Five chunks of every book, the same at every run."""
    return characters.sample(_chunks(spark, d), ["book_id"], "row_id", 5).select("book_id", "row_id")


@query("""
WITH c AS (SELECT book_id, coalesce(qa_status, 'unchecked') AS status, list_filter([CASE WHEN coalesce(failed, false) THEN 'failed' END, CASE WHEN coalesce(len(rejected_audio_files), 0) > 0 THEN 'rejected' END], lambda x: x IS NOT NULL) AS issues FROM manifest_chunks),
 b AS (SELECT book_id, count(*) AS chunks, ['passed', 'unchecked', 'warning', 'failed', 'error'][max(CASE WHEN list_position(['passed', 'unchecked', 'warning', 'failed', 'error'], lower(status)) IS NULL THEN 2 ELSE list_position(['passed', 'unchecked', 'warning', 'failed', 'error'], lower(status)) END)] AS worst FROM c GROUP BY book_id),
 h AS (SELECT book_id, list(i || ':' || n ORDER BY i) AS histogram FROM (SELECT book_id, i, count(*) AS n FROM (SELECT book_id, unnest(issues) AS i FROM c) GROUP BY ALL) GROUP BY book_id)
SELECT book_id, chunks, worst, coalesce(histogram, []) AS histogram FROM b LEFT JOIN h USING (book_id)""")
def a11_check_summary(spark: SparkSession, d: str) -> DataFrame:
    """The worst status of each book and what was met."""
    issues = F.filter(F.array(F.when(F.coalesce("failed", F.lit(False)), "failed"), F.when(F.size(F.coalesce("rejected_audio_files", F.array().cast("array<string>"))) > 0, "rejected")), lambda x: x.isNotNull())
    return characters.check_summary(_chunks(spark, d).select("book_id", F.coalesce("qa_status", F.lit("unchecked")).alias("status"), issues.alias("issues")), ["book_id"])


@query()
def a13_cases(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a case: characters, paragraphs, chunks, and whether chunking kept its text."""
    t = table(spark, d, "documents").filter("text IS NOT NULL").withColumn("_c", dialogue.chunk_text(F.col("text"), 600, 200))
    same = normalize.without_space(F.array_join("_c", "")) == normalize.without_space(F.col("text"))
    return t.select("doc_id", F.length("text").alias("chars"), F.size(F.split("text", r"\n[ \t]*\n+")).alias("paragraphs"), F.size("_c").alias("chunks"), same.alias("text_preserved"))


_PARAGRAPHS = "(SELECT book_id, chapter_index, CAST(row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY chunk_index, row_id) AS INTEGER) AS para_index, text FROM manifest_chunks)"


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    from quire.operators.manifest import chapter_order

    return _chunks(spark, d).select("book_id", "chapter_index", F.row_number().over(chapter_order()).alias("para_index"), "text")


@query(f"SELECT book_id, chapter_index, string_agg(text, chr(10) || chr(10) ORDER BY para_index) AS text FROM {_PARAGRAPHS} WHERE text IS NOT NULL GROUP BY book_id, chapter_index")
def k1_chapter_texts(spark: SparkSession, d: str) -> DataFrame:
    return loaders.chapter_texts(_paragraphs(spark, d))


@query(f"""
SELECT book_id, chapter_index, string_agg(n, chr(10) || chr(10) ORDER BY para_index) AS text FROM (SELECT *, replace(regexp_replace(text, '\\.{{3,}}', '…', 'g'), chr(769), '') AS n FROM {_PARAGRAPHS}) WHERE n <> '' GROUP BY book_id, chapter_index""")
def k2_spoken_texts(spark: SparkSession, d: str) -> DataFrame:
    """Chapters for speech, from normalised paragraphs."""
    return loaders.spoken_text(_paragraphs(spark, d).withColumn("normalized", normalize.ellipsis(F.col("text"))))


@query(f"""
SELECT book_id, chapter_index, count(*) AS paragraphs, CAST(sum(length(text)) AS BIGINT) AS chars, arg_min(CASE WHEN length(text) > 121 THEN substr(text, 1, 120) || '…' ELSE text END, para_index) AS first_preview FROM {_PARAGRAPHS} WHERE text IS NOT NULL GROUP BY book_id, chapter_index""")
def k3_structure(spark: SparkSession, d: str) -> DataFrame:
    return loaders.book_structure(_paragraphs(spark, d)).select("book_id", "chapter_index", "paragraphs", "chars", F.col("previews")[0]["preview"].alias("first_preview"))


@query()
def k5_verification(spark: SparkSession, d: str) -> DataFrame:
    """What the neutral stages do to each book."""
    t = _chunks(spark, d).select("book_id", "text")
    return loaders.verification(t, normalize.normalized(t, "text", normalize.NEUTRAL))


@query("""
SELECT book_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS run_id
FROM (SELECT book_id, sha256('{"manifest":"' || CAST(book_id AS VARCHAR) || '","output_dir":"out","parameters":"' || CAST(schema_version AS VARCHAR) || '"}') AS h FROM books WHERE schema_version IS NOT NULL)""")
def k10_run_ids(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "books").filter("schema_version IS NOT NULL")
    return b.select("book_id", loaders.run_id(F.lit("out"), F.col("book_id").cast("string"), F.col("schema_version").cast("string")).alias("run_id"))
