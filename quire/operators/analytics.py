"""Set-oriented analytics over the manifest: roles, scenes, quality, book statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pauses in milliseconds and words that tell an energy.
SCENE_MS, ELLIPSIS_MS, CHANGE_MS, SAME_MS = 1500, 450, 600, 120
HIGH = ("angry", "fear", "panic", "shout", "shouting", "tense", "furious", "scared")
LOW = ("sad", "tired", "weak", "whisper", "quiet", "melancholy", "exhausted")
BRIGHT = ("joyful", "happy", "excited", "playful", "cheerful")
FORMAL = ("chapter_title", "preface", "epilogue", "annotation")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def role_inventory(chunks: DataFrame) -> DataFrame:
    """Roles of each book: chunks, spoken chunks, characters, chapters and the most frequent emotion.

    A null or empty speaker is the narrator. Ties of the emotion go to the one met first.
    """
    order = F.struct("chapter_index", "chunk_index", "row_id")
    rows = chunks.filter(~F.coalesce("deleted", F.lit(False))).withColumns({
        "role": F.when(F.coalesce(F.trim("speaker"), F.lit("")) == "", "narrator").otherwise(F.trim("speaker")),
        "emotion": F.when(F.coalesce("emotion", F.lit("")) == "", "neutral").otherwise(F.col("emotion")),
        "o": order,
    })
    per_emotion = rows.groupBy("book_id", "role", "emotion").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("first"), F.count_if(F.col("voice_label") != "narrator").alias("spoken"), F.sum(F.length("text")).alias("chars"))
    chapters = rows.groupBy("book_id", "role").agg(F.countDistinct("chapter_index").alias("chapters"))
    roles = per_emotion.groupBy("book_id", "role").agg(
        F.sum("n").alias("chunks"), F.sum("spoken").alias("spoken_chunks"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.min_by("emotion", F.struct(-F.col("n"), F.col("first"))).alias("main_emotion")
    )
    return roles.join(chapters, ["book_id", "role"])


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike("|".join(words))


def director_rows(chunks: DataFrame) -> DataFrame:
    """Scene, tension, pace and pause of every chunk.

    A scene begins after a long pause, a scene or chapter boundary, or with a formal section, and at the
    start of a chapter's rows; scenes are counted per chapter.
    """
    w = Window.partitionBy("book_id", "chapter_index").orderBy("chunk_index", "row_id")
    boundary = F.lower(F.trim(F.coalesce("boundary_after", F.lit(""))))
    section = F.lower(F.trim(F.coalesce("section_kind", F.lit(""))))
    text = F.coalesce("text", F.lit(""))
    emotion = F.lower(F.trim(F.coalesce("emotion", F.lit(""))))
    rows = chunks.withColumns({"_b": boundary, "_s": section, "_t": text, "_e": emotion, "_p": F.coalesce("pause_after_ms", F.lit(0)), "_k": F.coalesce(F.nullif(F.lower(F.trim("speaker")), F.lit("")), F.lower("voice_label"))})
    starts = F.lag("row_id").over(w).isNull() | (F.lag("_p").over(w) >= SCENE_MS) | F.lag("_b").over(w).isin("scene", "chapter") | F.col("_s").isin(*FORMAL)
    marks = F.length("_t") - F.length(F.translate("_t", "!?", ""))
    tension = F.when(F.col("_s").isin(*FORMAL), "low").when((marks >= 2) | contains_any(F.col("_e"), HIGH), "high").when((marks == 1) | F.col("_e").isin(*BRIGHT, *LOW), "medium").otherwise("low")
    next_key = F.lead("_k").over(w)
    pause = F.greatest(
        F.col("_p"), F.when(F.col("_b").isin("scene", "chapter"), SCENE_MS).otherwise(0), F.when(F.col("_s").isin(*FORMAL), 900).otherwise(0), F.when(F.col("_t").contains("...") | F.col("_t").contains("…"), ELLIPSIS_MS).otherwise(0),
        F.when(F.lead("row_id").over(w).isNull(), 0).when(next_key != F.col("_k"), CHANGE_MS).otherwise(SAME_MS),
    )
    rows = rows.withColumns({"starts": starts, "tension": tension, "pause": pause})
    rows = rows.withColumn("scene", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pace = F.when(F.col("_s").isin(*FORMAL), "measured").when(contains_any(F.col("_e"), LOW), "slow").when(F.col("tension") == "high", "urgent").when((F.length("_t") < 80) & F.col("_e").isin(*BRIGHT), "brisk").otherwise("natural")
    volume = F.when(F.col("_e").contains("whisper") | (F.col("_s") == "aside"), "quiet").when((F.col("tension") == "high") | F.col("_t").contains("!"), "firm").otherwise("normal")
    return rows.withColumns({"pace": pace, "volume": volume}).select("book_id", "chapter_index", "chunk_index", "row_id", "scene", "tension", "pace", "volume", F.col("pause").cast("int").alias("pause"))


def scenes(chunks: DataFrame) -> DataFrame:
    """Scenes with their chunks and dominant tension; ties go to the tension met first."""
    d = director_rows(chunks)
    per = d.groupBy("book_id", "chapter_index", "scene", "tension").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("chunk_index", "row_id")).alias("first"))
    return per.groupBy("book_id", "chapter_index", "scene").agg(F.sum("n").alias("chunks"), F.min_by("tension", F.struct(-F.col("n"), F.col("first"))).alias("dominant_tension"))


#: Scores that pass; the longest pause and the shortest one between two speakers, in milliseconds.
PASS_SCORE, LONGEST_MS, HANDOFF_MS = 82, 3500, 350


def production_qa(chunks: DataFrame, checks: tuple[tuple[str, str, int], ...] = (("qa_status", "artifact_qa", 38),)) -> DataFrame:
    """Score of every chunk that is not deleted: 100 less penalties, with the issues found and a status.

    ``checks``: (column with the status of a check, its name, the penalty if it failed). A check that failed or audio that is missing asks for
    a new synthesis whatever the score; else the score decides. The next chunk, whose speaker matters for the pause, is taken
    before deleted ones are left out.
    """
    w = Window.partitionBy("book_id", "chapter_index").orderBy("chunk_index", "row_id")
    speaker = F.lower(F.trim(F.coalesce(F.nullif(F.trim("speaker"), F.lit("")), F.nullif(F.trim("voice_label"), F.lit("")), F.lit(""))))
    pause = F.coalesce("pause_after_ms", F.lit(0))
    rows = chunks.withColumns({"_key": speaker}).withColumn("_next", F.lead("_key").over(w)).filter(~F.coalesce("deleted", F.lit(False)))
    rules = [("not_synthesized", ~F.coalesce("synthesized", F.lit(False)), 60, True)]
    for column, name, penalty in checks:
        status = F.lower(F.trim(F.coalesce(column, F.lit(""))))
        rules += [(f"{name}_missing", F.col(column).isNull(), 8, False), (f"{name}_failed", status.isin("failed", "error"), penalty, True), (f"{name}_warning", status == "warning", 18, False), (f"{name}_unchecked", ~status.isin("", "failed", "error", "warning", "passed"), 10, False)]
    rules += [("pause_too_long", pause > LONGEST_MS, 8, False), ("speaker_handoff_pause_short", F.col("_next").isNotNull() & (F.col("_next") != F.col("_key")) & (pause < HANDOFF_MS), 8, False)]
    found = F.filter(F.array(*[F.when(cond, F.struct(F.lit(name).alias("kind"), F.lit(penalty).alias("penalty"), F.lit(severe).alias("severe"))) for name, cond, penalty, severe in rules]), lambda x: x.isNotNull())
    rows = rows.withColumn("_i", found).withColumn("score", F.greatest(F.lit(0), F.lit(100) - F.aggregate("_i", F.lit(0), lambda a, x: a + x["penalty"])))
    status = F.when(F.exists("_i", lambda x: x["severe"]), "resynthesize").when(F.col("score") >= PASS_SCORE, "passed").otherwise("review")
    return rows.select("book_id", "chapter_index", "chunk_index", "row_id", "score", status.alias("status"), F.transform("_i", lambda x: x["kind"]).alias("issues"))


def book_stats(paragraphs: DataFrame) -> DataFrame:
    """Counts per book over (book_id, chapter_index, text): chapters, headings, paragraphs, characters, words and marks; null texts are no paragraphs."""
    from quire.operators.structure import is_heading

    t = paragraphs.filter("text IS NOT NULL")
    heading = is_heading(F.regexp_extract("text", r"^\s*([^\n]*)", 1))
    count = lambda p: F.sum(F.length("text") - F.length(F.translate("text", p, "")))
    return t.groupBy("book_id").agg(
        F.countDistinct("chapter_index").alias("chapters"), F.count_if(heading).alias("headings"), F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("text")).alias("chars"), F.sum(F.size(F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != ""))).alias("words"),
        count("!").alias("exclamations"), count("?").alias("questions"), count("…").alias("ellipses"), count("—").alias("dashes"), count("�").alias("replacements"), F.median(F.length("text")).alias("median_chars"),
    )
