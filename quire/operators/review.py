"""Issues for review, remembered corrections, decisions, and reports on what a change did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is looked for: kind, pattern, severity, confidence.
PATTERNS = (
    ("missing_space", r"[а-яёА-ЯЁ][,.:;][а-яёА-ЯЁ]", "medium", 0.85),
    ("repeated_comma", r",{2,}", "high", 0.95),
    ("two_dots", r"[.]{2}(?![.])", "medium", 0.80),
    ("space_before_mark", r"\s[,.:;!?]", "low", 0.75),
    ("too_many_marks", r"[!?]{3,}", "low", 0.70),
    ("mixed_script", r"[а-яёА-ЯЁ][a-zA-Z]|[a-zA-Z][а-яёА-ЯЁ]", "medium", 0.80),
    ("digit_in_word", r"(?<![\p{L}\p{N}-])[0-9]*[а-яёА-ЯЁ]+[036][а-яёА-ЯЁ]+", "medium", 0.75),
    ("long_run", r"(?iu)[бвгджзклмнпрстфхцчшщ]{5,}|[аеёиоуыэюя]{5,}", "low", 0.50),
)


def issues(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``(*keys, kind, severity, confidence, n, first)``: how often each kind is met in a text, and its first fragment.

    Each pattern goes over a text once; only texts that have a match are taken apart further.
    """
    found = F.array(*[F.when(F.col(text).rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(sev).alias("severity"), F.lit(conf).alias("confidence"), F.regexp_count(text, F.lit(p)).alias("n"), F.regexp_substr(text, F.lit(p)).alias("first"))) for k, p, sev, conf in PATTERNS])
    return rows.select(*keys, F.inline(F.filter(found, lambda x: x.isNotNull())))


#: Characters of context on either side of an issue, and of a hint that is remembered.
CONTEXT, HINT = 40, 20


def occurrences(rows: DataFrame, keys: list[str], kind: str, text: str = "text") -> DataFrame:
    """``(*keys, ord, before, original, after)``: every match of a kind with its context. The text between matches gives the places."""
    pattern = next(p for k, p, *_ in PATTERNS if k == kind)
    hits, gaps = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern)
    some = rows.filter(F.col(text).rlike(pattern)).select(*keys, hits.alias("_h"), gaps.alias("_g"), F.posexplode(hits).alias("ord", "original"))
    joined = lambda a, b: F.array_join(F.transform(F.slice(F.arrays_zip(F.col("_g"), F.col("_h")), a, b), lambda x: F.concat(F.coalesce(x["_g"], F.lit("")), F.coalesce(x["_h"], F.lit("")))), "")
    before = F.concat(joined(F.lit(1), F.col("ord")), F.get("_g", F.col("ord")))
    after = joined(F.col("ord") + 2, F.size("_g"))
    return some.select(*keys, "ord", F.right(before, F.lit(CONTEXT)).alias("before"), "original", F.left(after, F.lit(CONTEXT)).alias("after"))


def context_hint(before: Column, after: Column) -> Column:
    return F.concat(F.right(before, F.lit(HINT)), F.lit("|"), F.left(after, F.lit(HINT)))


def safe_to_repeat(kind: Column, token: Column) -> Column:
    """Whether a correction may be applied everywhere: a word of Cyrillic letters with one or two lone digits inside, not all capitals."""
    core = F.replace(token, F.lit("-"), F.lit(""))
    shape = core.rlike("^[А-Яа-яЁё][А-Яа-яЁё0-9]+[А-Яа-яЁё]$") & core.rlike("^[^0-9]*[0-9][^0-9]*(?:[0-9][^0-9]*)?$") & ~core.rlike("[0-9]{2}")
    return (kind == "digit_in_word") & shape & (core != F.upper(core))


def upsert(memory: DataFrame, new: DataFrame, keys: list[str], order: str = "updated_at") -> DataFrame:
    """Remembered rows with the new ones: of one key the row updated last stays; of two of one time the new one."""
    rows = memory.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in memory.columns if c not in keys]
    best = rows.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.col("_new"))).alias("_r"))
    return best.select(*keys, "_r.*").select(*memory.columns)


def progress(decisions: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(pending, resolved, percent) of the issues of a review."""
    done = found.select(*keys).distinct().join(decisions.select(*keys).distinct().withColumn("_done", F.lit(1)), keys, "left")
    return done.agg(F.count_if(F.col("_done").isNull()).alias("pending"), F.count("_done").alias("resolved")).withColumn("percent", F.round(100.0 * F.col("resolved") / F.greatest(F.col("pending") + F.col("resolved"), F.lit(1)), 1))


def resolve(found: DataFrame, memory: DataFrame) -> DataFrame:
    """Issues with the remembered correction of their fragment: (original, replacement, confirmed, auto_apply_safe, updated_at)."""
    best = memory.filter("confirmed AND auto_apply_safe").groupBy(F.col("original").alias("first")).agg(F.max_by("replacement", "updated_at").alias("replacement"))
    return found.join(best, "first", "left").withColumn("status", F.when(F.col("replacement").isNull(), "pending").otherwise("resolved"))


def apply_decisions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Replace fragments: ``decisions`` (row_id, ord, before, original, after, replacement), applied in order where the context fits."""
    d = decisions.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("ord", "before", "original", "after", "replacement"))).alias("_d"))
    fixed = F.aggregate("_d", F.col("text"), lambda t, x: F.replace(t, F.concat(x["before"], x["original"], x["after"]), F.concat(x["before"], x["replacement"], x["after"])))
    return rows.join(d, "row_id", "left").withColumn("text", F.when(F.col("_d").isNull(), F.col("text")).otherwise(fixed)).drop("_d")


def heading_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(heading, status) preserved, missing or added, over two tables of (heading)."""
    b, a = before.select("heading").distinct(), after.select("heading").distinct()
    tag = lambda df, s: df.withColumn("status", F.lit(s))
    return tag(b.intersect(a), "preserved").unionByName(tag(b.exceptAll(a), "missing")).unionByName(tag(a.exceptAll(b), "added"))


def suspicious_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per book, over (book_id, text): how medians, counts and marks changed, and whether that is suspicious."""
    marks = lambda c: F.regexp_count(c, F.lit(r"[.,!?;:…—]"))

    def side(df: DataFrame, p: str) -> DataFrame:
        # no filter on the text: it would be pushed through the stages that made the text, each named several times
        return df.groupBy("book_id").agg(F.median(F.length("text")).alias(f"median_{p}"), F.count("text").alias(f"n_{p}"), F.sum(marks(F.col("text"))).alias(f"marks_{p}")).filter(f"n_{p} > 0")

    j = side(before, "before").join(side(after, "after"), "book_id", "full")
    ratio = F.col("median_after") / F.nullif(F.col("median_before"), F.lit(0.0))
    return j.withColumns({
        "median_changed": F.coalesce((ratio > 2.5) | (ratio < 0.4), F.lit(True)),
        "count_changed": F.coalesce((F.col("n_after") > 3 * F.col("n_before")) | (F.col("n_after") < 0.3 * F.col("n_before")), F.lit(True)),
        "marks_lost": F.coalesce(F.col("marks_after") < 0.7 * F.col("marks_before"), F.lit(True)),
    })


def redact(c: Column) -> Column:
    """Secrets, bearer tokens and private paths out of a text."""
    c = F.regexp_replace(c, r"(?i)\b(api[_-]?key|token|secret|password)\b(\s*[:=]\s*)\S+", "$1$2[redacted]")
    c = F.regexp_replace(c, r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [redacted]")
    return F.regexp_replace(c, r"(?:/home/|/Users/|[A-Za-z]:\\Users\\)[^\s\"']+", "[path]")
