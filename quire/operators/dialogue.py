"""Dialogue lines, speaker attribution, voice segments and chunks, without row-at-a-time code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Verbs of a remark and what they tell of the speaker.
MALE = r"\b(?:сказал|спросил|ответил|крикнул|прошептал|удивился|said he|he said|он)\b"
FEMALE = r"\b(?:сказала|спросила|ответила|крикнула|прошептала|удивилась|she said|said she|она)\b"


def dialogue_lines(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``(*keys, line_index, part, is_dialogue, line)``: lines taken apart into speech and remark.

    A line that opens with a dash is speech up to a dash before a small letter; the remark ends at the
    next dash before a capital, where the speech resumes. Other lines are narration.
    """
    lines = rows.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_index", "_line")).filter(F.trim("_line") != "")
    bare = F.regexp_replace("_line", r"^\s*[—–-]\s+", "")
    speech = F.regexp_extract(bare, r"^(.*?)(?:\s[—–]\s(?=\p{Ll})(.*))?$", 1)
    after = F.regexp_extract(bare, r"^.*?\s[—–]\s(?=\p{Ll})(.*)$", 1)
    remark = F.regexp_extract(after, r"^(.*?)(?:\s[—–]\s(?=\p{Lu})(.*))?$", 1)
    again = F.regexp_extract(after, r"^.*?\s[—–]\s(?=\p{Lu})(.*)$", 1)
    piece = lambda c, d: F.struct(F.trim(c).alias("line"), F.lit(d).alias("is_dialogue"))
    parts = F.when(F.col("_line").rlike(r"^\s*[—–-]\s+"), F.filter(F.array(piece(speech, True), piece(remark, False), piece(again, True)), lambda x: x["line"] != "")).otherwise(F.array(piece(F.col("_line"), False)))
    return lines.select(*keys, "line_index", F.posexplode(parts).alias("part", "_p")).select(*keys, "line_index", "part", F.col("_p.is_dialogue").alias("is_dialogue"), F.col("_p.line").alias("line"))


def attribute(lines: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add ``role``: narrator, male or female. A remark with a gender anchors the speech before it in its line;
    other speech takes turns from the last anchor on, male first. One window per chapter, no loop."""
    w = Window.partitionBy(*group).orderBy(*order)
    gender = F.when(F.col("line").rlike(FEMALE), "female").when(F.col("line").rlike(MALE), "male")
    rows = lines.withColumn("_g", F.when(~F.col("is_dialogue"), gender))
    same = (F.lead("line_index").over(w) == F.col("line_index"))
    rows = rows.withColumn("_anchor", F.when(F.col("is_dialogue") & same, F.lead("_g").over(w)))
    rows = rows.withColumn("_island", F.count("_anchor").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spoken = Window.partitionBy(*group, "_island").orderBy(*order)
    rows = rows.withColumns({"_turn": F.sum(F.col("is_dialogue").cast("int")).over(spoken.rowsBetween(Window.unboundedPreceding, 0)), "_first": F.first("_anchor", ignorenulls=True).over(spoken.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    first = F.coalesce("_first", F.lit("male"))
    other = F.when(first == "male", "female").otherwise("male")
    role = F.when(~F.col("is_dialogue"), "narrator").when(F.col("_turn") % 2 == 1, first).otherwise(other)
    return rows.withColumn("role", role).drop("_g", "_anchor", "_island", "_turn", "_first")


def segments(lines: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Neighbouring lines of one role as one segment: (*group, segment_index, role, lines, text)."""
    w = Window.partitionBy(*group).orderBy(*order)
    change = F.coalesce((F.lag("role").over(w) != F.col("role")).cast("int"), F.lit(0))
    rows = lines.withColumn("_c", change).withColumn("segment_index", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy(*group, "segment_index", "role").agg(F.sort_array(F.collect_list(F.struct(*order, "line"))).alias("_l"))
    return parts.select(*group, "segment_index", "role", F.size("_l").alias("lines"), F.array_join(F.transform("_l", lambda x: x["line"]), " ").alias("text"))


def simple_sentences(c: Column) -> Column:
    """Sentences by their closing marks alone."""
    return F.filter(F.split(F.regexp_replace(c, r"^\s+|\s+$", ""), r"(?<=[.!?…»”\")])\s+"), lambda s: s != "")


def pack(parts: Column, limit: int, glue: str = " ") -> Column:
    """Greedy packing of an array of texts into pieces of at most ``limit`` characters (a longer part stays alone)."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["cur"] == "") | (F.length(acc["cur"]) + len(glue) + F.length(x) <= limit)
        joined = F.when(acc["cur"] == "", x).otherwise(F.concat(acc["cur"], F.lit(glue), x))
        return F.when(fits, F.struct(acc["done"].alias("done"), joined.alias("cur"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), x.alias("cur")))

    return F.aggregate(parts, start, step, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))


def chunk_text(c: Column, limit: int = 900, sentence_limit: int = 200) -> Column:
    """Sentences packed into chunks; a sentence beyond the limit is first broken at clauses, then at words."""
    fine = lambda s: F.when(F.length(s) <= limit, F.array(s)).otherwise(F.flatten(F.transform(F.split(s, r"(?<=[,;:—])\s+"), lambda x: F.when(F.length(x) <= sentence_limit, F.array(x)).otherwise(pack(F.split(x, r"\s+"), sentence_limit)))))
    return pack(F.flatten(F.transform(simple_sentences(c), fine)), limit)


def boundary_issues(chunks: DataFrame) -> DataFrame:
    """Chunks whose speech and narration are mixed up: ``(row_id, issue)``, the first that fits.

    Narrator text that opens like speech, speech with the remark still in it, or speech without a mark of it.
    """
    text, label = F.coalesce("text", F.lit("")), F.col("voice_label")
    spoken = label.isin("men", "women")
    issue = (
        F.when((label == "narrator") & text.rlike(r"^\s*[—–]\s"), "narrator_opens_speech")
        .when(spoken & text.rlike(r"[,!?…]\s[—–]\s\p{Ll}"), "embedded_author_tag")
        .when(spoken & ~text.rlike(r"[—–«“\"「]") & (text != ""), "speech_without_mark")
    )
    return chunks.withColumn("issue", issue).filter("issue IS NOT NULL").select("row_id", "issue")
