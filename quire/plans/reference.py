"""Queries of the engine's own operators over the driver's tables, each with the SQL that says the same.

Every query runs over whole tables. Texts come from manifest_chunks, pages from pdf_pages, documents
from documents, an event log from events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import metrics, normalize
from quire.operators import analytics, dialogue, manifest, review, structure
from quire.plans.registry import ORACLES, TEXTS, query, texts
from quire.sources.tables import spread, table
from quire.streaming import events

# Structure

def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pdf_pages")


_PAGE = """SELECT row_id, book_id, coalesce(list_sum(list_transform(page_text, lambda x: coalesce(length(x), 0))), 0) AS chars, coalesce(len(text_from_tables), 0) AS tables, coalesce(len(text_from_images), 0) AS images FROM pdf_pages"""


@query(f"""
SELECT row_id, CASE WHEN layer AND whole THEN 'scanned_with_ocr' WHEN NOT layer AND (images > 0 OR whole) THEN 'scanned' WHEN layer AND images > 0 THEN 'hybrid' WHEN layer THEN 'programmatic' ELSE 'unknown' END AS page_class
FROM (SELECT *, chars >= 40 OR tables > 0 AS layer, images / greatest(images + blocks, 1) >= 0.65 AS whole FROM (SELECT *, coalesce(len(page_text), 0) AS blocks FROM ({_PAGE}) JOIN (SELECT row_id, page_text FROM pdf_pages) USING (row_id)))""")
def s10_page_class(spark: SparkSession, d: str) -> DataFrame:
    """The class of every page; the share of blocks that come from images stands for the share of its area."""
    chars = F.aggregate(F.coalesce("page_text", F.array().cast("array<string>")), F.lit(0), lambda a, x: a + F.coalesce(F.length(x), F.lit(0)))
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    images = size("text_from_images")
    ratio = images / F.greatest(images + size("page_text"), F.lit(1))
    return _pages(spark, d).select("row_id", structure.page_class(chars, size("text_from_tables"), ratio, images).alias("page_class"))


# Dialogue and chunks


@query()
def d1_dialogue_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "manifest_chunks").filter("text IS NOT NULL")
    return dialogue.dialogue_lines(rows, ["book_id", "chapter_index", "chunk_index", "row_id"])


def _attributed(spark: SparkSession, d: str) -> DataFrame:
    lines = d1_dialogue_lines(spark, d)
    return dialogue.attribute(lines, ["book_id", "chapter_index"], ["chunk_index", "row_id", "line_index", "part"])


@query()
def d3_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Lines per role and chapter."""
    return _attributed(spark, d).groupBy("book_id", "chapter_index", "role").agg(F.count(F.lit(1)).alias("lines"))


@query()
def d6_segments(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.segments(_attributed(spark, d), ["book_id", "chapter_index"], ["chunk_index", "row_id", "line_index", "part"])


@query(r"""
SELECT row_id, CAST(len(list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?…»”")])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS INTEGER) AS sentences FROM manifest_chunks WHERE text IS NOT NULL""")
def d10_sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sentences by closing marks alone."""
    return table(spark, d, "manifest_chunks").filter("text IS NOT NULL").select("row_id", F.size(dialogue.simple_sentences(F.col("text"))).alias("sentences"))


@query()
def d11_chunked(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed into chunks of at most 600 characters."""
    t = table(spark, d, "documents").filter("text IS NOT NULL")
    return t.select("doc_id", F.posexplode(dialogue.chunk_text(F.col("text"), 600, 200)).alias("chunk_index", "text"))


@query(r"""
SELECT row_id, issue FROM (SELECT row_id, CASE
 WHEN voice_label = 'narrator' AND regexp_matches(coalesce(text, ''), '^\s*[—–]\s') THEN 'narrator_opens_speech'
 WHEN voice_label IN ('men', 'women') AND regexp_matches(coalesce(text, ''), '[,!?…]\s[—–]\s\p{Ll}') THEN 'embedded_author_tag'
 WHEN voice_label IN ('men', 'women') AND NOT regexp_matches(coalesce(text, ''), '[—–«“"「]') AND coalesce(text, '') <> '' THEN 'speech_without_mark' END AS issue FROM manifest_chunks) WHERE issue IS NOT NULL""")
def d25_boundary_issues(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.boundary_issues(table(spark, d, "manifest_chunks"))


# Manifest


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest_chunks")


_LATEST = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_index, chunk_index ORDER BY updated_at DESC NULLS LAST, ingested_at DESC NULLS LAST, row_id DESC) AS _rn FROM manifest_chunks) WHERE _rn = 1)"""


@query(f"SELECT row_id, book_id, chapter_index, chunk_index, text FROM {_LATEST}")
def m_latest(spark: SparkSession, d: str) -> DataFrame:
    return manifest.latest(_chunks(spark, d)).select("row_id", "book_id", "chapter_index", "chunk_index", "text")


@query("SELECT row_id, book_id, chapter_index, CAST(row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY chunk_index, row_id) - 1 AS INTEGER) AS chunk_index FROM manifest_chunks")
def m8_renumber(spark: SparkSession, d: str) -> DataFrame:
    return manifest.renumber(_chunks(spark, d)).select("row_id", "book_id", "chapter_index", "chunk_index")


@query("""
SELECT role, CASE role WHEN 'male' THEN 'men' WHEN 'female' THEN 'women' ELSE 'narrator' END AS label, count(*) AS n FROM (SELECT coalesce(
 CASE WHEN starts_with(v, 'male_') OR v IN ('male', 'men') THEN 'male' WHEN starts_with(v, 'female_') OR v IN ('female', 'women') THEN 'female' WHEN starts_with(v, 'narrator_') OR v = 'narrator' THEN 'narrator' END,
 CASE WHEN voice IN ('male', 'female', 'narrator', 'unknown') THEN voice END, 'narrator') AS role FROM (SELECT lower(trim(coalesce(voice_id, ''))) AS v, voice FROM manifest_chunks)) GROUP BY role""")
def m3_voice_roles(spark: SparkSession, d: str) -> DataFrame:
    role = manifest.role_for_voice(F.col("voice_id"), F.col("voice"))
    return _chunks(spark, d).select(role.alias("role")).withColumn("label", manifest.voice_label(F.col("role"))).groupBy("role", "label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT row_id, book_id, chapter_index, chunk_index FROM manifest_chunks WHERE NOT coalesce(deleted, false) AND NOT (coalesce(synthesized, false) AND coalesce(audio_file, '') <> '')")
def m10_pending(spark: SparkSession, d: str) -> DataFrame:
    return manifest.pending(_chunks(spark, d)).select("row_id", "book_id", "chapter_index", "chunk_index")


@query("""
SELECT row_id, CASE WHEN att > 0 THEN (42 + (CAST(chapter_index AS BIGINT) + 1) * 10007 + (chunk_index + 1) * 101 + att * 7919) % 2147483647 ELSE 42 END AS seed,
 CASE WHEN att >= 2 THEN 0.525 ELSE 0.7 END::DOUBLE AS temperature, CASE WHEN att >= 2 THEN 1.25 ELSE 1.1 END::DOUBLE AS repetition_penalty
FROM (SELECT *, coalesce(len(rejected_audio_files), 0) AS att FROM manifest_chunks)""")
def m12_retry_options(spark: SparkSession, d: str) -> DataFrame:
    """Options of the next synthesis of every chunk, by how often its audio was rejected."""
    attempt = F.size(F.coalesce("rejected_audio_files", F.array().cast("array<string>")))
    options = manifest.generation_options(F.col("chapter_index").cast("bigint"), F.col("chunk_index"), attempt)
    return _chunks(spark, d).select("row_id", *[c.alias(n) for n, c in options.items()])


@query("""
SELECT book_id, chapter_index, count(*) AS total, count(*) FILTER (s = 'passed') AS passed, count(*) FILTER (s = 'warning') AS warning, count(*) FILTER (s IN ('failed', 'error')) AS failed,
 count(*) FILTER (s NOT IN ('passed', 'warning', 'failed', 'error')) AS unchecked FROM (SELECT *, lower(trim(coalesce(qa_status, ''))) AS s FROM manifest_chunks) WHERE NOT coalesce(deleted, false) GROUP BY book_id, chapter_index""")
def m16_quality_summary(spark: SparkSession, d: str) -> DataFrame:
    return manifest.quality_summary(_chunks(spark, d))


@query("""
WITH c AS (SELECT * FROM manifest_chunks WHERE NOT coalesce(deleted, false) AND coalesce(synthesized, false) AND coalesce(audio_file, '') <> '')
SELECT row_id, pause_before_ms, sum(pause_before_ms + duration_ms) OVER w - duration_ms AS start_ms FROM (
 SELECT *, CAST(length(coalesce(text, '')) * 60 AS BIGINT) AS duration_ms, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE greatest(CASE WHEN lag(voice_label) OVER w = voice_label THEN 300 ELSE 600 END, coalesce(lag(pause_after_ms) OVER w, 0)) END AS pause_before_ms
 FROM c WINDOW w AS (PARTITION BY book_id, chapter_index ORDER BY chunk_index, row_id)) WINDOW w AS (PARTITION BY book_id, chapter_index ORDER BY chunk_index, row_id)""")
def m17_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Starts of the synthesised chunks in their chapter's audio, at 60 ms a character."""
    return manifest.timeline(_chunks(spark, d), F.length(F.coalesce("text", F.lit(""))).cast("bigint") * 60).select("row_id", "pause_before_ms", "start_ms")


@query("SELECT * FROM manifest_chunks")
def m2_nested_and_back(spark: SparkSession, d: str) -> DataFrame:
    """Nest the chapters of the manifest and take them apart again: no field is lost."""
    return manifest.flatten(manifest.nest(_chunks(spark, d)))


@query("SELECT book_id, chapter_index, CAST(count(*) AS INTEGER) AS chunks, arg_min(text, (chunk_index, row_id)) AS first_text FROM manifest_chunks GROUP BY book_id, chapter_index")
def m1_nested(spark: SparkSession, d: str) -> DataFrame:
    return manifest.nest(_chunks(spark, d)).select("book_id", "chapter_index", F.size("chunks").alias("chunks"), F.col("chunks")[0]["fields"]["text"].alias("first_text"))


_ROLE = "CASE l WHEN 'men' THEN 'male' WHEN 'women' THEN 'female' WHEN 'narrator' THEN 'narrator' ELSE CASE WHEN starts_with(v, 'male_') OR v IN ('male', 'men') THEN 'male' WHEN starts_with(v, 'female_') OR v IN ('female', 'women') THEN 'female' ELSE 'narrator' END END"
_VOICED = f"""(SELECT *, {_ROLE} AS role FROM (SELECT *, lower(trim(coalesce(voice_label, ''))) AS l, lower(trim(coalesce(voice_id, ''))) AS v, trim(coalesce(speaker, '')) AS name, lower(trim(coalesce(section_kind, ''))) AS part,
 CASE WHEN lower(trim(coalesce(emotion, ''))) IN ('', 'neutral', 'calm') THEN '' ELSE trim(emotion) END AS feeling FROM manifest_chunks))"""


@query(f"""
SELECT key, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter([CASE WHEN name <> '' AND feeling <> '' THEN 'speaker:' || name || '|emotion:' || feeling END, CASE WHEN name <> '' THEN 'speaker:' || name END,
 CASE WHEN part <> '' THEN 'section:' || part END, role, CASE WHEN l <> '' THEN l END, '__all__'], lambda k: k IS NOT NULL AND k <> ''))) AS key FROM {_VOICED}) GROUP BY key""")
def m13_voice_keys(spark: SparkSession, d: str) -> DataFrame:
    """How often each key of a voice override is asked for."""
    c = F.col
    keys = manifest.voice_keys(c("speaker"), c("emotion"), c("section_kind"), manifest.canonical_role(c("voice_label"), c("voice_id")), c("voice_label"))
    return _chunks(spark, d).select(F.explode(keys).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH o AS (SELECT 'speaker:' || speaker AS key, max(voice_id) AS voice, 2 AS p FROM manifest_chunks WHERE trim(coalesce(speaker, '')) <> '' AND speaker = trim(speaker) GROUP BY speaker HAVING count(*) >= 3)
SELECT c.row_id, coalesce(o.voice, 'narrator_calm') AS voice FROM {_VOICED} c LEFT JOIN o ON c.name <> '' AND o.key = 'speaker:' || c.name""")
def m13_voice_overrides(spark: SparkSession, d: str) -> DataFrame:
    """The voice of every chunk: that of its speaker where the speaker has one, else the one for all."""
    named = _chunks(spark, d).filter("trim(speaker) <> '' AND speaker = trim(speaker)").groupBy("speaker").agg(F.max("voice_id").alias("voice"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    overrides = named.select(F.concat(F.lit("speaker:"), "speaker").alias("key"), "voice").unionByName(spark.createDataFrame([("__all__", "narrator_calm")], "key string, voice string"))
    return manifest.resolve_voices(_chunks(spark, d), overrides, ["row_id"])


@query("""
SELECT row_id, CASE WHEN 'failed' IN (s) OR s = 'error' THEN 'failed' WHEN s = 'warning' THEN 'warning' WHEN s = 'passed' THEN 'passed' ELSE 'unchecked' END AS status FROM (SELECT row_id, lower(coalesce(qa_status, '')) AS s FROM manifest_chunks)""")
def m15_worst_status(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("row_id", manifest.worst_status(F.array("qa_status")).alias("status"))


@query("SELECT row_id, coalesce(voice_label, 'narrator') AS voice_label, coalesce(boundary_after, '') AS boundary_after, coalesce(pause_after_ms, 0) AS pause_after_ms, coalesce(deleted, false) AS deleted, 2 AS schema_version FROM manifest_chunks")
def m9_migrated(spark: SparkSession, d: str) -> DataFrame:
    return manifest.migrate(_chunks(spark, d), F.lit(1)).select("row_id", "voice_label", "boundary_after", "pause_after_ms", "deleted", "schema_version")


@query()
def m11_retry_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where over-long chunks would be cut for another try."""
    return _chunks(spark, d).select("row_id", manifest.retry_offset(F.col("text")).alias("split_at")).filter("split_at IS NOT NULL")


@query("""
SELECT m.row_id, coalesce(p.new_text, m.text) AS text, CASE WHEN p.new_text IS NULL THEN m.synthesized ELSE false END AS synthesized, CASE WHEN p.new_text IS NULL THEN m.audio_file END AS audio_file
FROM manifest_chunks m LEFT JOIN (SELECT row_id, trim(text) AS new_text FROM manifest_chunks WHERE text <> trim(text)) p USING (row_id)""")
def m5_update_text(spark: SparkSession, d: str) -> DataFrame:
    """Trim texts as a patch; the audio of changed rows is reset."""
    patches = _chunks(spark, d).filter(F.col("text") != F.trim("text")).select("row_id", F.trim("text").alias("new_text"))
    return manifest.update_text(_chunks(spark, d), patches).select("row_id", "text", "synthesized", "audio_file")


@query("""
WITH h AS (SELECT *, CAST(floor(length(text) / 2) AS INTEGER) AS mid FROM manifest_chunks),
 p AS (SELECT *, CASE WHEN length(text) > 900 AND trim(substr(text, 1, mid), ' ') <> '' AND trim(substr(text, mid + 1), ' ') <> '' THEN [trim(substr(text, 1, mid), ' '), trim(substr(text, mid + 1), ' ')] ELSE [text] END AS parts FROM h)
SELECT row_id, book_id, chapter_index, CAST(row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY chunk_index, row_id, i) - 1 AS INTEGER) AS chunk_index, parts[i + 1] AS text FROM (SELECT *, unnest(range(len(parts))) AS i FROM p)""")
def m6_split(spark: SparkSession, d: str) -> DataFrame:
    """Chunks beyond 900 characters cut in the middle, chapters renumbered."""
    cuts = _chunks(spark, d).filter(F.length("text") > 900).select("row_id", F.floor(F.length("text") / 2).cast("int").alias("split_at"))
    return manifest.split_at(_chunks(spark, d), cuts).select("row_id", "book_id", "chapter_index", "chunk_index", "text")


@query("""
WITH x AS (SELECT *, lead(text) OVER w AS nt, lead(row_id) OVER w AS nr, coalesce(lag(length(text) < 12) OVER w, false) AS gone0, length(text) < 12 AS mine FROM manifest_chunks WINDOW w AS (PARTITION BY book_id, chapter_index ORDER BY chunk_index, row_id))
SELECT row_id, CAST(row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY chunk_index, row_id) - 1 AS INTEGER) AS chunk_index,
 CASE WHEN coalesce(mine, false) AND nr IS NOT NULL THEN concat_ws(' ', text, nt) ELSE text END AS text FROM x WHERE NOT gone0""")
def m7_merge(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of fewer than 12 characters joined with the next one."""
    return manifest.merge_with_next(_chunks(spark, d), _chunks(spark, d).filter(F.length("text") < 12).select("row_id")).select("row_id", "chunk_index", "text")


def _voice_sql() -> str:
    """The voice of a chunk of ``_VOICED``, as SQL."""
    number = "('0x' || substr(sha1(lower(role || ':' || name)), 1, 8))::BIGINT"
    felt = lambda r: "CASE lower(feeling) " + " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in manifest.EMOTION_VOICES[r].items()) + " END"
    by_role = " ".join(f"WHEN '{r}' THEN coalesce(" + (f"CASE WHEN name <> '' THEN {list(v)!r}[{number} % {len(v)} + 1] END, " if r != "narrator" else "") + f"{felt(r)}, '{v[0]}')" for r, v in manifest.VOICES.items())
    return f"CASE WHEN part IN ('annotation', 'epigraph') THEN 'narrator_wise' ELSE CASE role {by_role} END END"


@query(f"SELECT row_id, {_voice_sql()} AS voice FROM {_VOICED}")
def m14_auto_voice(spark: SparkSession, d: str) -> DataFrame:
    """A stable voice for every chunk."""
    c = F.col
    return _chunks(spark, d).select("row_id", manifest.auto_voice(manifest.canonical_role(c("voice_label"), c("voice_id")), c("speaker"), c("emotion"), c("section_kind")).alias("voice"))


# Analytics


@query("""
WITH r AS (SELECT *, CASE WHEN trim(coalesce(speaker, '')) = '' THEN 'narrator' ELSE trim(speaker) END AS role, CASE WHEN coalesce(emotion, '') = '' THEN 'neutral' ELSE emotion END AS emo FROM manifest_chunks WHERE NOT coalesce(deleted, false)),
 e AS (SELECT book_id, role, emo, count(*) AS n, min((chapter_index, chunk_index, row_id)) AS first FROM r GROUP BY ALL),
 m AS (SELECT book_id, role, emo AS main_emotion FROM (SELECT *, row_number() OVER (PARTITION BY book_id, role ORDER BY n DESC, first) AS rn FROM e) WHERE rn = 1)
SELECT book_id, role, count(*) AS chunks, count(*) FILTER (voice_label <> 'narrator') AS spoken_chunks, coalesce(sum(length(text)), 0)::BIGINT AS chars, any_value(main_emotion) AS main_emotion, count(DISTINCT chapter_index) AS chapters
FROM r JOIN m USING (book_id, role) GROUP BY book_id, role""")
def a1_role_inventory(spark: SparkSession, d: str) -> DataFrame:
    return analytics.role_inventory(_chunks(spark, d))


_FORMAL = "('chapter_title', 'preface', 'epilogue', 'annotation')"


@query(f"""
WITH x AS (SELECT *, lower(trim(coalesce(boundary_after, ''))) AS b, lower(trim(coalesce(section_kind, ''))) AS s, coalesce(text, '') AS t, lower(trim(coalesce(emotion, ''))) AS e, coalesce(pause_after_ms, 0) AS p, coalesce(nullif(lower(trim(speaker)), ''), lower(voice_label)) AS k FROM manifest_chunks),
 y AS (SELECT *, CASE WHEN lag(row_id) OVER w IS NULL OR lag(p) OVER w >= 1500 OR lag(b) OVER w IN ('scene', 'chapter') OR s IN {_FORMAL} THEN 1 ELSE 0 END AS starts, length(t) - length(translate(t, '!?', '')) AS marks,
  lead(k) OVER w AS nk, lead(row_id) OVER w AS nr FROM x WINDOW w AS (PARTITION BY book_id, chapter_index ORDER BY chunk_index, row_id)),
 z AS (SELECT *, CASE WHEN s IN {_FORMAL} THEN 'low' WHEN marks >= 2 OR regexp_matches(e, 'angry|fear|panic|shout|shouting|tense|furious|scared') THEN 'high'
  WHEN marks = 1 OR e IN ('joyful','happy','excited','playful','cheerful','sad','tired','weak','whisper','quiet','melancholy','exhausted') THEN 'medium' ELSE 'low' END AS tension FROM y)
SELECT book_id, chapter_index, chunk_index, row_id, sum(starts) OVER (PARTITION BY book_id, chapter_index ORDER BY chunk_index, row_id ROWS UNBOUNDED PRECEDING)::BIGINT AS scene, tension,
 CASE WHEN s IN {_FORMAL} THEN 'measured' WHEN regexp_matches(e, 'sad|tired|weak|whisper|quiet|melancholy|exhausted') THEN 'slow' WHEN tension = 'high' THEN 'urgent' WHEN length(t) < 80 AND e IN ('joyful','happy','excited','playful','cheerful') THEN 'brisk' ELSE 'natural' END AS pace,
 CASE WHEN contains(e, 'whisper') OR s = 'aside' THEN 'quiet' WHEN tension = 'high' OR contains(t, '!') THEN 'firm' ELSE 'normal' END AS volume,
 CAST(greatest(p, CASE WHEN b IN ('scene', 'chapter') THEN 1500 ELSE 0 END, CASE WHEN s IN {_FORMAL} THEN 900 ELSE 0 END, CASE WHEN contains(t, '...') OR contains(t, '…') THEN 450 ELSE 0 END, CASE WHEN nr IS NULL THEN 0 WHEN nk <> k THEN 600 ELSE 120 END) AS INTEGER) AS pause
FROM z""")
def a5_director(spark: SparkSession, d: str) -> DataFrame:
    return analytics.director_rows(_chunks(spark, d))


@query(f"""
WITH d AS ({ORACLES['a5_director']}), p AS (SELECT book_id, chapter_index, scene, tension, count(*) AS n, min((chunk_index, row_id)) AS first FROM d GROUP BY ALL)
SELECT book_id, chapter_index, scene, CAST(sum(n) AS BIGINT) AS chunks, arg_min(tension, (-n, first)) AS dominant_tension FROM p GROUP BY ALL""")
def a5_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Scenes of each chapter and their dominant tension."""
    return analytics.scenes(_chunks(spark, d))


@query("""
SELECT row_id, score, CASE WHEN severe THEN 'resynthesize' WHEN score >= 82 THEN 'passed' ELSE 'review' END AS status FROM (SELECT row_id, NOT coalesce(synthesized, false) OR s IN ('failed', 'error') AS severe, greatest(0, 100
 - CASE WHEN NOT coalesce(synthesized, false) THEN 60 ELSE 0 END - CASE WHEN qa_status IS NULL THEN 8 WHEN s IN ('failed', 'error') THEN 38 WHEN s = 'warning' THEN 18 WHEN s NOT IN ('', 'passed') THEN 10 ELSE 0 END
 - CASE WHEN coalesce(pause_after_ms, 0) > 3500 THEN 8 ELSE 0 END - CASE WHEN nk IS NOT NULL AND nk <> k AND coalesce(pause_after_ms, 0) < 350 THEN 8 ELSE 0 END) AS score
 FROM (SELECT *, lead(k) OVER (PARTITION BY book_id, chapter_index ORDER BY chunk_index, row_id) AS nk FROM (SELECT *, lower(trim(coalesce(qa_status, ''), ' ')) AS s, lower(trim(coalesce(nullif(trim(speaker, ' '), ''), nullif(trim(voice_label, ' '), ''), ''), ' ')) AS k FROM manifest_chunks)) WHERE NOT coalesce(deleted, false))""")
def a6_production_qa(spark: SparkSession, d: str) -> DataFrame:
    return analytics.production_qa(_chunks(spark, d)).select("row_id", "score", "status")


@query(r"""
SELECT book_id, count(DISTINCT chapter_index) AS chapters, count(*) FILTER (_HEADING_) AS headings, count(*) AS paragraphs, sum(length(text))::BIGINT AS chars, sum(len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '')))::BIGINT AS words, sum(length(text) - length(replace(text, '!', '')))::BIGINT AS exclamations,
 sum(length(text) - length(replace(text, '?', '')))::BIGINT AS questions, sum(length(text) - length(replace(text, '…', '')))::BIGINT AS ellipses, sum(length(text) - length(replace(text, '—', '')))::BIGINT AS dashes, sum(length(text) - length(replace(text, chr(65533), '')))::BIGINT AS replacements, median(length(text))::DOUBLE AS median_chars
FROM (SELECT *, regexp_extract(text, '^\s*([^\n]*)', 1) AS line FROM manifest_chunks WHERE text IS NOT NULL) GROUP BY book_id""".replace("_HEADING_", structure.kind_sql("line", (*structure.CHAPTER_PATTERNS, *structure.WORK_PATTERNS)) + " IS NOT NULL"))
def a7_book_stats(spark: SparkSession, d: str) -> DataFrame:
    return analytics.book_stats(_chunks(spark, d).select("book_id", "chapter_index", "text"))


@query("""
WITH b AS (SELECT DISTINCT text AS heading FROM chunk_specs WHERE length(text) < 40), a AS (SELECT DISTINCT text AS heading FROM manifest_chunks WHERE length(text) < 40)
SELECT heading, 'preserved' AS status FROM (SELECT * FROM b INTERSECT SELECT * FROM a) UNION ALL SELECT heading, 'missing' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT heading, 'added' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def a8_heading_diff(spark: SparkSession, d: str) -> DataFrame:
    """Short texts of the two chunk tables compared as sets."""
    short = lambda t: table(spark, d, t).filter(F.length("text") < 40).select(F.col("text").alias("heading"))
    return review.heading_diff(short("chunk_specs"), short("manifest_chunks"))


@query()
def a9_suspicious_changes(spark: SparkSession, d: str) -> DataFrame:
    """What the whole pipeline changes in each book."""
    t = _chunks(spark, d).select("book_id", "text")
    return review.suspicious_changes(t, normalize.normalized(spread(t), "text", normalize.RUSSIAN))


@query("""
SELECT book_id, first_chapter, last_chapter, n_chapters, first_text FROM (
 SELECT book_id, min(chapter_index) AS first_chapter, max(chapter_index) AS last_chapter, count(DISTINCT chapter_index) AS n_chapters, arg_min(coalesce(text, ''), row_id) AS first_text FROM manifest_chunks GROUP BY book_id)""")
def a10_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """First and last chapter of each book and its first text."""
    return _chunks(spark, d).groupBy("book_id").agg(
        F.min("chapter_index").alias("first_chapter"), F.max("chapter_index").alias("last_chapter"), F.countDistinct("chapter_index").alias("n_chapters"), F.min_by(F.coalesce("text", F.lit("")), "row_id").alias("first_text")
    )


@query("""
SELECT language, chunker, count(*) AS books FROM (SELECT coalesce(tts_language, '') AS language, coalesce(nullif(chunker, ''), 'default') AS chunker FROM books) GROUP BY ROLLUP (language, chunker)""")
def k6_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Books per language and chunker, with totals."""
    b = table(spark, d, "books").select(F.coalesce("tts_language", F.lit("")).alias("language"), F.coalesce(F.nullif(F.col("chunker"), F.lit("")), F.lit("default")).alias("chunker"))
    return b.rollup("language", "chunker").agg(F.count(F.lit(1)).alias("books"))


@query("""
SELECT b.book_id, p.n_profiles, p.speech, m.n_chunks FROM books b LEFT JOIN (SELECT book_id, count(*) AS n_profiles, sum(direct_speech_count)::BIGINT AS speech FROM character_profiles GROUP BY book_id) p USING (book_id)
LEFT JOIN (SELECT book_id, count(*) AS n_chunks FROM manifest_chunks GROUP BY book_id) m USING (book_id)""")
def a2_book_overview(spark: SparkSession, d: str) -> DataFrame:
    """Profiles and chunks per book; both sides are aggregated before the joins."""
    p = table(spark, d, "character_profiles").groupBy("book_id").agg(F.count(F.lit(1)).alias("n_profiles"), F.sum("direct_speech_count").alias("speech"))
    m = _chunks(spark, d).groupBy("book_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return table(spark, d, "books").select("book_id").join(p, "book_id", "left").join(m, "book_id", "left")


@query("""
SELECT DISTINCT m.row_id, p.profile_id FROM manifest_chunks m JOIN (
 SELECT book_id, name, min(profile_id) AS profile_id FROM (SELECT book_id, profile_id, unnest(list_distinct(list_append(coalesce(aliases, []), display_name))) AS name FROM character_profiles) WHERE name IS NOT NULL GROUP BY book_id, name) p
 ON m.book_id = p.book_id AND m.speaker = p.name""")
def a3_alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first profile that lists a chunk's speaker among its names."""
    names = table(spark, d, "character_profiles").select("book_id", "profile_id", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("display_name"))).alias("speaker")).filter("speaker IS NOT NULL")
    lookup = names.groupBy("book_id", "speaker").agg(F.min("profile_id").alias("profile_id"))
    return _chunks(spark, d).select("row_id", "book_id", "speaker").join(lookup, ["book_id", "speaker"]).select("row_id", "profile_id")


# Metrics, review, identity


@query()
def q2_matching_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every text against itself with what a normalisation changes, aligned by words."""
    t = texts(spark, d).filter("text IS NOT NULL").select("src", "row_id", normalize.asr_text(F.col("text")).alias("a"), normalize.asr_text(F.regexp_replace("text", r"\\d+|«[^»]*»", "")).alias("b"))
    return t.select("src", "row_id", metrics.aligned(F.col("a"), F.col("b")).alias("x")).select("src", "row_id", F.round("x.matched_ratio", 6).alias("matched"), F.round("x.repeated_score", 6).alias("repeated"), F.size("x.missing_spans").alias("missing"), F.size("x.extra_spans").alias("extra"))


@query()
def q4_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Every text scored against the latest other delivery of its chunk, as if that were a transcript."""
    c = table(spark, d, "manifest_chunks").filter("text IS NOT NULL").select("book_id", "chapter_index", "chunk_index", "row_id", normalize.asr_text(F.col("text")).alias("a"), "character_confidence")
    other = c.select("book_id", "chapter_index", "chunk_index", F.col("row_id").alias("other"), F.col("a").alias("b"))
    pairs = c.join(other, ["book_id", "chapter_index", "chunk_index"]).filter("row_id < other").withColumn("x", metrics.aligned(F.col("a"), F.col("b")))
    issues = metrics.transcript_issues(F.col("a"), F.col("b"), F.col("x"), metrics.char_error_rate(F.col("a"), F.col("b")), F.lit("ru"), F.lit(""), F.col("character_confidence"))
    return pairs.select("row_id", "other", issues.alias("issues")).withColumn("status", metrics.transcript_status(F.col("issues")))


@query()
def q5_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Whether what the neutral stages make of a text is a mere correction of it."""
    t = table(spark, d, "chunk_specs").filter("text IS NOT NULL").select("row_id", "text", F.col("text").alias("clean"))
    return normalize.normalized(t, "clean", normalize.NEUTRAL).select("row_id", metrics.validated(F.col("text"), F.col("clean")).alias("v")).select("row_id", F.col("v.issues").alias("issues"))


@query()
def q6_titles(spark: SparkSession, d: str) -> DataFrame:
    """The same for titles."""
    t = table(spark, d, "books").select("book_id", "book_title", normalize.dashes(normalize.quotes(F.col("book_title"))).alias("clean")).filter("book_title IS NOT NULL")
    return t.select("book_id", metrics.validated(F.col("book_title"), F.col("clean"), title=True)["issues"].alias("issues"))


@query()
def q1_error_rates(spark: SparkSession, d: str) -> DataFrame:
    """Word and character error rates of the normalised against the raw text, of all texts."""
    t = spread(texts(spark, d).filter("text IS NOT NULL")).select("src", "row_id", F.col("text").alias("raw"), normalize.asr_text(F.col("text")).alias("clean"))
    return t.select("src", "row_id", F.round(metrics.word_error_rate(F.col("raw"), F.col("clean")), 6).alias("wer"), F.round(metrics.char_error_rate(F.col("raw"), F.col("clean")), 6).alias("cer"))


#: The same patterns without look-around: what stood there is taken as well, which changes no count of matches apart.
_ISSUES = {
    "missing_space": "[а-яёА-ЯЁ][,.:;][а-яёА-ЯЁ]", "repeated_comma": ",{2,}", "two_dots": r"\.{2}(?:[^.]|$)", "space_before_mark": r"\s[,.:;!?]", "too_many_marks": "[!?]{3,}", "mixed_script": "[а-яёА-ЯЁ][a-zA-Z]|[a-zA-Z][а-яёА-ЯЁ]",
    "digit_in_word": r"(?:^|[^\p{L}\p{N}-])[0-9]*[а-яёА-ЯЁ]+[036][а-яёА-ЯЁ]+", "long_run": "(?i)[бвгджзклмнпрстфхцчшщ]{5,}|[аеёиоуыэюя]{5,}",
}


@query("SELECT kind, count(*) AS texts, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, len(regexp_extract_all(text, '{p}')) AS n FROM {TEXTS}" for k, p in _ISSUES.items()) + ") WHERE n > 0 GROUP BY kind")
def r1_issue_counts(spark: SparkSession, d: str) -> DataFrame:
    """Texts and places per kind of issue, of all kinds and texts."""
    return review.issues(texts(spark, d), ["src", "row_id"]).groupBy("kind").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"))


@query(r"""
SELECT src, row_id, CAST(i AS INTEGER) AS ord, right(array_to_string(list_transform(range(i), lambda j: gaps[j + 1] || hits[j + 1]), '') || gaps[i + 1], 40) AS before, hits[i + 1] AS original,
 left(gaps[i + 2] || array_to_string(list_transform(range(i + 1, len(hits)), lambda j: hits[j + 1] || gaps[j + 2]), ''), 40) AS after
FROM (SELECT *, unnest(range(len(hits))) AS i FROM (SELECT src, row_id, regexp_extract_all(text, '\s[,.:;!?]') AS hits, string_split_regex(text, '\s[,.:;!?]') AS gaps FROM """ + TEXTS + r""" WHERE regexp_matches(text, '\s[,.:;!?]')))""")
def r2_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Every space before a mark, with its context."""
    return review.occurrences(texts(spark, d), ["src", "row_id"], "space_before_mark")


@query()
def r3_yo_issues(spark: SparkSession, d: str) -> DataFrame:
    """Words that the corpus writes with ё elsewhere."""
    from quire.operators import paragraphs

    t = _chunks(spark, d).select("row_id", "text")
    return paragraphs.words_to_replace(t, [], ["row_id"], "text", paragraphs.yo_dictionary(t.select("text"), ratio=1))


@query(r"""
SELECT DISTINCT w AS token, regexp_matches(core, '^[А-Яа-яЁё][А-Яа-яЁё0-9]+[А-Яа-яЁё]$') AND regexp_matches(core, '^[^0-9]*[0-9][^0-9]*(?:[0-9][^0-9]*)?$') AND NOT regexp_matches(core, '[0-9]{2}') AND core <> upper(core) AS safe
FROM (SELECT w, replace(w, '-', '') AS core FROM (SELECT unnest(regexp_extract_all(text, '[А-Яа-яЁё0-9-]*[А-Яа-яЁё][0-9][А-Яа-яЁё0-9-]*')) AS w FROM """ + TEXTS + "))")
def r8_safe_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Which words with digits in them may be corrected everywhere."""
    words = texts(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit("([А-Яа-яЁё0-9-]*[А-Яа-яЁё][0-9][А-Яа-яЁё0-9-]*)"), F.lit(1))).alias("token")).distinct()
    return words.select("token", review.safe_to_repeat(F.lit("digit_in_word"), F.col("token")).alias("safe"))


@query("SELECT nickname, lang, full_name FROM (SELECT *, row_number() OVER (PARTITION BY nickname, lang ORDER BY length(full_name) DESC, full_name DESC) AS rn FROM nickname_list WHERE nickname IS NOT NULL AND lang IS NOT NULL) WHERE rn = 1")
def r7_upserted(spark: SparkSession, d: str) -> DataFrame:
    """A remembered table taken up again: of each key the row with the latest mark stays."""
    t = table(spark, d, "nickname_list").withColumn("updated_at", F.struct(F.length("full_name").alias("a"), F.col("full_name").alias("b")))
    return review.upsert(t, t, ["nickname", "lang"]).select("nickname", "lang", "full_name")


@query("""
SELECT b.book_id, CASE WHEN trim(coalesce(source_format, '')) <> '' AND trim(coalesce(book_title, '')) <> '' THEN 'src_' || substr(sha1(source_format || '|' || lower(trim(book_title))), 1, 16) ELSE 'text_' || substr(sha1(coalesce(t.text, '')), 1, 16) END AS stable_id
FROM books b LEFT JOIN (SELECT book_id, string_agg(text, chr(10) || chr(10) ORDER BY chapter_index, chunk_index, row_id) FILTER (text <> '') AS text FROM manifest_chunks GROUP BY book_id) t USING (book_id)""")
def i1_stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """An id of each book: of its format and source (the title stands for the path here), else of its text."""
    b = table(spark, d, "books")
    known = (F.trim(F.coalesce("source_format", F.lit(""))) != "") & (F.trim(F.coalesce("book_title", F.lit(""))) != "")
    source = F.concat(F.lit("src_"), F.substring(F.sha1(F.concat("source_format", F.lit("|"), F.lower(F.trim("book_title")))), 1, 16))
    some = b.filter(~known).select("book_id")
    parts = F.sort_array(F.collect_list(F.struct("chapter_index", "chunk_index", "row_id", "text")))
    text = _chunks(spark, d).filter("text <> ''").join(some, "book_id", "left_semi").groupBy("book_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("t"))
    return b.join(text, "book_id", "left").select("book_id", F.when(known, source).otherwise(F.concat(F.lit("text_"), F.substring(F.sha1(F.coalesce("t", F.lit(""))), 1, 16))).alias("stable_id"))


@query("SELECT text_key, count(*) AS n FROM (SELECT substr(sha1(coalesce(text, '') || '|' || coalesce(chunker, '')), 1, 16) AS text_key FROM manifest_chunks) GROUP BY text_key HAVING count(*) > 1")
def i2_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Texts with their settings that a cache keyed by content would answer."""
    key = F.substring(F.sha1(F.concat(F.coalesce("text", F.lit("")), F.lit("|"), F.coalesce("chunker", F.lit("")))), 1, 16)
    return _chunks(spark, d).groupBy(key.alias("text_key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(r"SELECT DISTINCT voice_id, trim(regexp_replace(lower(voice_id), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM manifest_chunks WHERE voice_id IS NOT NULL")
def i3_voice_ids(spark: SparkSession, d: str) -> DataFrame:
    """Voices with ids fit for file names."""
    return _chunks(spark, d).filter("voice_id IS NOT NULL").select("voice_id", F.regexp_replace(F.regexp_replace(F.lower("voice_id"), "[^a-z0-9]+", "_"), "^_+|_+$", "").alias("slug")).distinct()


@query("SELECT count(DISTINCT text) AS n_texts, count(*) AS n_rows FROM manifest_chunks WHERE text IS NOT NULL")
def a14_distinct(spark: SparkSession, d: str) -> DataFrame:
    t = _chunks(spark, d).filter("text IS NOT NULL")
    return t.agg(F.countDistinct(F.sha2("text", 256)).alias("n_texts"), F.count(F.lit(1)).alias("n_rows"))


# Events


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def e1_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    return events.windowed_counts(table(spark, d, "events"))
