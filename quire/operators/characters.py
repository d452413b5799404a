"""Characters of books: who they are by what they say, and reports on samples and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines kept of each character and their length.
LINES, LINE_CHARS = 6, 220


def character_key(speaker: Column) -> Column:
    """A name for comparison: small letters, single spaces; the narrator where there is none."""
    bare = F.regexp_replace(F.trim(F.coalesce(speaker, F.lit(""))), r"\s+", " ")
    return F.when(bare == "", "narrator").otherwise(F.lower(bare))


def character_bible(chunks: DataFrame) -> DataFrame:
    """A row per book and character: name, role, aliases, counts, emotions, lines and the confidence that it is one.

    The name is the spelling met most often (of several the smallest), the role the most frequent one that is not the narrator's.
    Confidence is a sum of evidence between .25 and .98; the narrator's is 1. Lines are the first ``LINES`` that are not blank,
    found by rank before anything is gathered.
    """
    rows = chunks.withColumns({
        "key": character_key(F.col("speaker")), "_name": F.nullif(F.regexp_replace(F.trim(F.coalesce("speaker", F.lit(""))), r"\s+", " "), F.lit("")), "_spoken": F.coalesce(F.col("voice_label").isin("men", "women"), F.lit(False)),
        "_emotion": F.nullif(F.trim(F.coalesce("emotion", F.lit(""))), F.lit("")), "_text": F.substring(F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), r"\s+", " "), 1, LINE_CHARS),
    })
    by = ["book_id", "key"]
    names = rows.groupBy(*by, "_name").agg(F.count(F.lit(1)).alias("n")).filter("_name IS NOT NULL").groupBy(*by).agg(F.min_by("_name", F.struct(-F.col("n"), F.col("_name"))).alias("display_name"), F.array_sort(F.collect_set("_name")).alias("aliases"))
    roles = rows.filter("_spoken").groupBy(*by, "voice_label").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.min_by("voice_label", F.struct(-F.col("n"), F.col("voice_label"))).alias("_label"))
    emotions = rows.filter("_emotion IS NOT NULL").groupBy(*by, "_emotion").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("_emotion").alias("e")))), lambda x: F.concat(x["e"], F.lit(":"), (-x["n"]).cast("string"))).alias("emotions"))
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("segment_count"), F.count_if("_spoken").alias("direct_speech_count"), F.countDistinct("chapter_index").alias("chapter_count"))
    w = Window.partitionBy(*by).orderBy("chapter_index", "chunk_index", "row_id")
    lines = rows.filter("_text <> ''").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= LINES).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_text"))), lambda x: x["_text"]).alias("sample_lines"))
    out = counts.join(names, by, "left").join(roles, by, "left").join(emotions, by, "left").join(lines, by, "left")
    none = F.array().cast("array<string>")
    evidence = F.when(F.col("direct_speech_count") > 0, 35).otherwise(0) + F.when(F.col("segment_count") >= 2, 20).otherwise(0) + F.when(F.size(F.coalesce("aliases", none)) >= 2, 10).otherwise(0) + F.when(F.col("emotions").isNotNull(), 10).otherwise(0) + F.least(F.lit(10), 3 * F.col("chapter_count"))
    confidence = F.when(F.col("key") == "narrator", 1.0).otherwise(F.least(F.lit(98), F.greatest(F.lit(25), evidence)) / 100)
    return out.select(
        *by, F.coalesce("display_name", F.lit("Narrator")).alias("display_name"), F.when(F.col("_label") == "men", "male").when(F.col("_label") == "women", "female").otherwise("narrator").alias("role"), F.coalesce("aliases", none).alias("aliases"),
        "direct_speech_count", "segment_count", "chapter_count", F.coalesce("emotions", none).alias("emotions"), F.coalesce("sample_lines", none).alias("sample_lines"), F.round(confidence, 3).alias("confidence"),
    )


def unresolved(chunks: DataFrame) -> DataFrame:
    """Spoken chunks that nobody is named for."""
    return chunks.filter(F.col("voice_label").isin("men", "women") & (F.trim(F.coalesce("speaker", F.lit(""))) == ""))


def sample(rows: DataFrame, group: list[str], key: str, n: int, seed: int = 17) -> DataFrame:
    """``n`` rows of each group, drawn by a hash of seed and key: the same rows at every run and partitioning."""
    draw = F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    w = Window.partitionBy(*group).orderBy(draw, key)
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


#: Statuses from good to bad.
SEVERITY = ("passed", "unchecked", "warning", "failed", "error")


def check_summary(checks: DataFrame, group: list[str]) -> DataFrame:
    """(*group, chunks, worst, histogram) of checked chunks (*group, status, issues): the worst status and how often each issue was met."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITY)), F.lower(F.coalesce("status", F.lit("unchecked")))).cast("int"), F.lit(0))
    rank = F.when(rank == 0, 2).otherwise(rank)
    base = checks.groupBy(*group).agg(F.count(F.lit(1)).alias("chunks"), F.element_at(F.array(*map(F.lit, SEVERITY)), F.max(rank)).alias("worst"))
    met = checks.select(*group, F.explode("issues").alias("issue")).groupBy(*group, "issue").agg(F.count(F.lit(1)).alias("n"))
    hist = met.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("issue", "n"))), lambda x: F.concat(x["issue"], F.lit(":"), x["n"].cast("string"))).alias("histogram"))
    return base.join(hist, group, "left").withColumn("histogram", F.coalesce("histogram", F.array().cast("array<string>")))
