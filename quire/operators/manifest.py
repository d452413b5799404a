"""The chunk manifest as a table: ordering, DML, state and timeline.

Chunks are rows (book_id, chapter_index, chunk_index, ...); order is always explicit, ties are broken by
``row_id``. All windows are partitioned by (book_id, chapter_index), so a hot book spreads over its chapters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SAME_VOICE_MS, VOICE_CHANGE_MS = 300, 600


def chapter_order() -> WindowSpec:
    return Window.partitionBy("book_id", "chapter_index").orderBy("chunk_index", "row_id")


def latest(chunks: DataFrame) -> DataFrame:
    """One row per natural key: the one updated last, then ingested last, then with the largest id."""
    w = Window.partitionBy("book_id", "chapter_index", "chunk_index").orderBy(F.desc("updated_at"), F.desc("ingested_at"), F.desc("row_id"))
    return chunks.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def is_excluded(df: DataFrame) -> Column:
    """Deleted, or left out of speech where the table has a column that says so."""
    flags = [c for c in ("deleted", "excluded_from_tts") if c in df.columns]
    return reduce(lambda a, c: a | F.coalesce(c, F.lit(False)), flags, F.lit(False))


def renumber(chunks: DataFrame) -> DataFrame:
    """``chunk_index`` counted from 0 without gaps within each chapter."""
    return chunks.withColumn("chunk_index", F.row_number().over(chapter_order()) - 1)


def role_for_voice(voice_id: Column, fallback: Column) -> Column:
    """The role that a voice id names or begins with, in any case; else the fallback; unknown is the narrator."""
    v = F.lower(F.trim(F.coalesce(voice_id, F.lit(""))))
    role = F.when(v.startswith("male_") | v.isin("male", "men"), "male").when(v.startswith("female_") | v.isin("female", "women"), "female").when(v.startswith("narrator_") | (v == "narrator"), "narrator")
    return F.coalesce(role, F.when(fallback.isin("male", "female", "narrator", "unknown"), fallback), F.lit("narrator"))


def voice_label(role: Column) -> Column:
    return F.when(role == "male", "men").when(role == "female", "women").otherwise("narrator")


def pending(chunks: DataFrame, failed_only: bool = False) -> DataFrame:
    """Chunks that still need audio: not deleted and not synthesised with a file."""
    done = F.coalesce("synthesized", F.lit(False)) & (F.coalesce("audio_file", F.lit("")) != "")
    rows = chunks.filter(~is_excluded(chunks) & ~done)
    return rows.filter(F.coalesce("failed", F.lit(False))) if failed_only else rows


def generation_options(chapter: Column, chunk: Column, attempt: Column, seed: int = 42, temperature: float = 0.7, repetition: float = 1.1) -> dict[str, Column]:
    """Options of a synthesis: those given at attempt 0, a seed of its own from the first repetition on, cooler and less
    repetitive from the second."""
    base = seed if seed >= 0 else 1_000_003
    new_seed = F.pmod(F.lit(base).cast("bigint") + (chapter + 1) * 10007 + (chunk + 1) * 101 + attempt * 7919, F.lit(2147483647))
    return {
        "seed": F.when(attempt > 0, new_seed).otherwise(F.lit(seed).cast("bigint")),
        "temperature": F.round(F.when(attempt >= 2, F.greatest(F.lit(0.35), F.lit(temperature * 0.75))).otherwise(F.lit(temperature)), 4),
        "repetition_penalty": F.round(F.when(attempt >= 2, F.least(F.lit(2.0), F.lit(repetition + 0.15))).otherwise(F.lit(repetition)), 4),
    }


def nest(chunks: DataFrame) -> DataFrame:
    """A row per chapter with all fields of its chunks nested in order, for the JSON sink; a book's chapters stay rows, as a whole
    book in one row would not bound the memory of a task."""
    fields = [c for c in chunks.columns if c not in ("book_id", "chapter_index", "chunk_index", "row_id")]
    return chunks.groupBy("book_id", "chapter_index").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "row_id", F.struct(*fields).alias("fields")))).alias("chunks")) if not any(_map_in(f.dataType) for f in chunks.schema) else _nest_ordered(chunks, fields)


def _map_in(kind) -> bool:
    return "map<" in kind.simpleString()


def _nest_ordered(chunks: DataFrame, fields: list[str]) -> DataFrame:
    """As ``nest`` where a field holds a map, which has no order: sorted by the keys alone."""
    packed = F.collect_list(F.struct("chunk_index", "row_id", F.struct(*fields).alias("fields")))
    by_key = F.array_sort(packed, lambda a, b: F.when(a["chunk_index"] < b["chunk_index"], -1).when(a["chunk_index"] > b["chunk_index"], 1).when(a["row_id"] < b["row_id"], -1).otherwise(1))
    return chunks.groupBy("book_id", "chapter_index").agg(by_key.alias("chunks"))


def flatten(chapters: DataFrame, chapter: int | None = None) -> DataFrame:
    """Chunks of nested chapters; ``chapter`` is counted from 1 and filters before anything is taken apart."""
    if chapter is not None:
        chapters = chapters.filter(F.col("chapter_index") == chapter - 1)
    return chapters.select("book_id", "chapter_index", F.inline("chunks")).select("book_id", "chapter_index", "chunk_index", "row_id", "fields.*")


def update_text(chunks: DataFrame, patches: DataFrame) -> DataFrame:
    """Replace texts by (row_id, new_text) and reset the audio of the rows that change; the last patch of a row wins by text order."""
    p = patches.groupBy("row_id").agg(F.max("new_text").alias("_new"))
    changed = F.col("_new").isNotNull()
    return (
        chunks.join(p, "row_id", "left")
        .withColumns({"synthesized": F.when(changed, False).otherwise(F.col("synthesized")), "failed": F.when(changed, False).otherwise(F.col("failed")), "audio_file": F.when(~changed, F.col("audio_file")), "text": F.coalesce("_new", "text")})
        .drop("_new")
    )


def split_at(chunks: DataFrame, cuts: DataFrame) -> DataFrame:
    """Cut rows at (row_id, split_at) code points into two, if neither half is blank, and renumber."""
    c = cuts.groupBy("row_id").agg(F.min("split_at").alias("_at"))
    left, right = F.trim(F.substring("text", F.lit(1), F.col("_at"))), F.trim(F.substring("text", F.col("_at") + 1, F.length("text")))
    halves = F.when((left != "") & (right != ""), F.array(left, right)).otherwise(F.array("text"))
    rows = chunks.join(c, "row_id", "left").select("*", F.posexplode(halves).alias("_half", "_text"))
    w = Window.partitionBy("book_id", "chapter_index").orderBy("chunk_index", "row_id", "_half")
    return rows.withColumns({"text": F.col("_text"), "chunk_index": F.row_number().over(w) - 1}).drop("_at", "_half", "_text")


def merge_with_next(chunks: DataFrame, targets: DataFrame) -> DataFrame:
    """Join each row of (row_id) with the next of its chapter; pause and boundary of the second win where it has some."""
    w = chapter_order()
    rows = chunks.join(targets.select("row_id").distinct().withColumn("_merge", F.lit(True)), "row_id", "left")
    rows = rows.withColumns({"_next": F.lead("text").over(w), "_nb": F.lead("boundary_after").over(w), "_np": F.lead("pause_after_ms").over(w), "_gone": F.coalesce(F.lag("_merge").over(w), F.lit(False)), "_has": F.lead("row_id").over(w).isNotNull()})
    on = F.coalesce("_merge", F.lit(False)) & F.col("_has")
    rows = rows.withColumns({
        "text": F.when(on, F.concat_ws(" ", "text", "_next")).otherwise(F.col("text")),
        "boundary_after": F.when(on & (F.coalesce("_nb", F.lit("")) != ""), F.col("_nb")).otherwise(F.col("boundary_after")),
        "pause_after_ms": F.when(on & (F.coalesce("_np", F.lit(0)) > 0), F.col("_np")).otherwise(F.col("pause_after_ms")),
    })
    return renumber(rows.filter(~F.col("_gone")).drop("_merge", "_next", "_nb", "_np", "_gone", "_has"))


def timeline(chunks: DataFrame, duration_ms: Column) -> DataFrame:
    """Start of each chunk in its chapter's audio: durations and pauses before it.

    Only chunks that are not excluded, are synthesised and have an audio file take part. The pause before a chunk is the largest of that for the same or a changed voice and what the chunk
    before it asks for; the first has none.
    """
    chunks = chunks.filter(~is_excluded(chunks) & F.coalesce("synthesized", F.lit(False)) & (F.coalesce("audio_file", F.lit("")) != ""))
    w = chapter_order()
    before = F.lag("voice_label").over(w)
    wanted = F.greatest(F.when(before == F.col("voice_label"), SAME_VOICE_MS).otherwise(VOICE_CHANGE_MS), F.coalesce(F.lag("pause_after_ms").over(w), F.lit(0)))
    gap = F.when(F.row_number().over(w) == 1, 0).otherwise(wanted)
    rows = chunks.withColumns({"pause_before_ms": gap, "duration_ms": duration_ms})
    total = F.sum(F.col("pause_before_ms") + F.col("duration_ms")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("start_ms", total - F.col("duration_ms"))


def quality_summary(chunks: DataFrame) -> DataFrame:
    """Chunks per chapter and quality status; an error has failed, whatever is no status counts as unchecked."""
    status = F.lower(F.trim(F.coalesce("qa_status", F.lit(""))))
    status = F.when(status == "error", "failed").otherwise(status)
    return chunks.filter(~is_excluded(chunks)).groupBy("book_id", "chapter_index").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "passed").alias("passed"),
        F.count_if(status == "warning").alias("warning"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(~status.isin("passed", "warning", "failed")).alias("unchecked"),
    )


#: Voices per role, and those that an emotion or a section asks for.
VOICES = {"narrator": ("narrator_calm", "narrator_wise", "narrator_energetic"), "male": ("male_young", "male_confident", "male_deep", "male_lively", "male_regional"), "female": ("female_warm", "female_bright", "female_playful", "female_gentle")}
EMOTION_VOICES = {
    "narrator": {"excited": "narrator_energetic", "joyful": "narrator_energetic", "cheerful": "narrator_energetic", "wise": "narrator_wise"},
    "male": {"angry": "male_confident", "tense": "male_confident", "assertive": "male_confident", "sad": "male_deep", "whisper": "male_deep", "excited": "male_lively", "joyful": "male_lively", "cheerful": "male_lively"},
    "female": {"angry": "female_bright", "tense": "female_bright", "assertive": "female_bright", "sad": "female_gentle", "whisper": "female_gentle", "excited": "female_playful", "joyful": "female_playful", "cheerful": "female_playful"},
}
SECTION_VOICES = {"annotation": "narrator_wise", "epigraph": "narrator_wise"}


def canonical_role(label: Column, voice_id: Column) -> Column:
    """narrator, male or female: what the voice label says, else the voice id."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.when(low == "men", "male").when(low == "women", "female").when(low == "narrator", "narrator").otherwise(role_for_voice(voice_id, F.lit("narrator")))


def _emotion(c: Column) -> Column:
    e = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.lower(e).isin("", "neutral", "calm"), "").otherwise(e)


def auto_voice(role: Column, speaker: Column, emotion: Column, section: Column) -> Column:
    """A stable voice of a chunk: its section's, else by a hash of role and speaker, else its emotion's, else the first of the role."""
    name, feeling, part = F.trim(F.coalesce(speaker, F.lit(""))), F.lower(_emotion(emotion)), F.lower(F.trim(F.coalesce(section, F.lit(""))))
    number = F.conv(F.substring(F.sha1(F.lower(F.concat_ws(":", role, name))), 1, 8), 16, 10).cast("bigint")
    out = F.lit(VOICES["narrator"][0])
    for r, voices in VOICES.items():
        own = F.array(*map(F.lit, voices))
        felt = F.lit(None).cast("string")
        for e, v in EMOTION_VOICES[r].items():
            felt = F.when(feeling == e, v).otherwise(felt)
        named = F.when((name != "") & (F.lit(r) != "narrator"), F.get(own, (number % len(voices)).cast("int")))
        out = F.when(role == r, F.coalesce(named, felt, F.lit(voices[0]))).otherwise(out)
    for s, v in SECTION_VOICES.items():
        out = F.when(part == s, v).otherwise(out)
    return out


def voice_keys(speaker: Column, emotion: Column, section: Column, role: Column, label: Column) -> Column:
    """The keys under which a voice may be set for a chunk, most specific first."""
    name, feeling = F.trim(F.coalesce(speaker, F.lit(""))), _emotion(emotion)
    part, low = F.lower(F.trim(F.coalesce(section, F.lit("")))), F.lower(F.trim(F.coalesce(label, F.lit(""))))
    keys = F.array(
        F.when((name != "") & (feeling != ""), F.concat(F.lit("speaker:"), name, F.lit("|emotion:"), feeling)), F.when(name != "", F.concat(F.lit("speaker:"), name)), F.when(part != "", F.concat(F.lit("section:"), part)), role, F.when(low != "", low), F.lit("__all__"),
    )
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != "")))


def resolve_voices(chunks: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, voice)``: the override (key, voice) of the most specific key of each chunk; chunks without one give no row."""
    k = voice_keys(F.col("speaker"), F.col("emotion"), F.col("section_kind"), canonical_role(F.col("voice_label"), F.col("voice_id")), F.col("voice_label"))
    rows = chunks.select(*keys, F.posexplode(k).alias("_pos", "key"))
    one = overrides.groupBy("key").agg(F.max("voice").alias("voice"))
    return rows.join(one, "key").groupBy(*keys).agg(F.min_by("voice", "_pos").alias("voice"))


#: Schema versions that are understood; what older manifests lack.
SCHEMA_VERSION = 2
DEFAULTS = {"voice_label": "narrator", "boundary_after": "", "pause_after_ms": 0, "synthesized": False, "failed": False, "deleted": False}


def migrate(chunks: DataFrame, version: Column) -> DataFrame:
    """Fields that an older manifest lacks filled with their defaults; a newer version is an error when it is read."""
    known = F.coalesce(version, F.lit(1))
    for name, value in DEFAULTS.items():
        if name in chunks.columns:
            chunks = chunks.withColumn(name, F.coalesce(name, F.lit(value)))
    checked = F.when(known > SCHEMA_VERSION, F.raise_error(F.concat(F.lit("unknown schema version "), known))).otherwise(F.lit(SCHEMA_VERSION))
    return chunks.withColumn("schema_version", checked.cast("int"))


def worst_status(statuses: Column) -> Column:
    """The worst of an array of check results: failed, warning, passed if all passed, else unchecked."""
    s = F.transform(F.filter(statuses, lambda x: x.isNotNull()), lambda x: F.lower(x))
    return F.when(F.exists(s, lambda x: x.isin("failed", "error")), "failed").when(F.array_contains(s, "warning"), "warning").when((F.size(s) > 0) & F.forall(s, lambda x: x == "passed"), "passed").otherwise("unchecked")


#: A chunk is cut for a repetition at the mark nearest to its middle, so far from both ends.
RETRY_MARGIN, RETRY_CHARS = 20, 180


def retry_offset(text: Column) -> Column:
    """Where an over-long chunk is best cut: after the sentence end, clause or space nearest to its middle; null if it is short."""

    def nearest(pattern: str) -> Column:
        ends = F.filter(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.when(F.substring(text, i, 1).rlike(pattern) & (i >= RETRY_MARGIN) & (i <= F.length(text) - RETRY_MARGIN), i)), lambda i: i.isNotNull())
        best = F.array_min(F.transform(ends, lambda i: F.struct(F.abs(2 * i - F.length(text)).alias("far"), i.alias("at"))))
        return best["at"]

    return F.when(F.length(text) >= RETRY_CHARS, F.coalesce(nearest("[.!?…]"), nearest("[,;:]"), nearest(r"\s")))
