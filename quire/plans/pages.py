"""Queries of recognised pages, stress and recordings, with their SQL."""

from __future__ import annotations

import io
import wave

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import audio, ocr, stress
from quire.plans.registry import BLOCKS, TEXTS, blocks, query, texts
from quire.sources.tables import table

_X = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"
_N = lambda t, p: f"len(regexp_extract_all({t}, '{p}'))"
_CYR = r"[\x{0400}-\x{04FF}]"
_SYMBOLS = r"""coalesce(len(regexp_extract_all(text, '[^\p{L}\p{N}\p{M}\s.,;:!?…"''«»„“”()—–-]')) / nullif(length(text), 0), 0.0)"""


@query(rf"""
SELECT src, row_id, block, count(*) AS noise_lines FROM (SELECT *, {_N('x', _CYR)} AS cyr, {_N('x', r'[\p{L}\p{N}]')} AS alnum, length(x) AS n, length(x) - {_N('x', r'[\p{L}\p{N}]')} - {_N('x', r'\s')} AS marks FROM (
 SELECT *, {_X} AS x FROM (SELECT src, row_id, block, unnest(string_split(text, chr(10))) AS line FROM {BLOCKS})))
WHERE n > 0 AND (cyr = 0 AND alnum <= 2 OR cyr < 2 AND n <= 12 OR cyr = 0 AND marks / greatest(n, 1) > 0.35) GROUP BY src, row_id, block""")
def s16_noise_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = blocks(spark, d).select("src", "row_id", "block", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(ocr.is_noise_line(F.col("line"))).groupBy("src", "row_id", "block").agg(F.count(F.lit(1)).alias("noise_lines"))


@query()
def s16_noise_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).filter(ocr.is_noise_paragraph(F.col("text"))).select("src", "row_id", "block")


@query(rf"""
SELECT src, row_id, cyr >= 80 AND coalesce(cyr1 / nullif(let1, 0), 0) >= 0.3 AND coalesce(long / nullif(runs, 0), 0) >= 0.35 AND {_SYMBOLS} <= 0.06 AS body_usable FROM (
 SELECT *, {_N('text', _CYR)} AS cyr, {_N('substr(text, 1, 10000)', _CYR)} AS cyr1, {_N('substr(text, 1, 10000)', r'\p{L}')} AS let1, {_N('text', _CYR + '+')} AS runs, {_N('text', _CYR + '{3,}')} AS long FROM {TEXTS} WHERE text IS NOT NULL)""")
def s17_usable(spark: SparkSession, d: str) -> DataFrame:
    """Texts with enough readable Russian."""
    t, c, ru = texts(spark, d).filter("text IS NOT NULL"), F.col("text"), F.lit("ru")
    from quire.functions import language as L

    usable = (L.script_chars(c, ru) >= ocr.MIN_CHARS) & (L.script_ratio(c, ru) >= ocr.MIN_SCRIPT) & (L.readable_ratio(c, ru) >= ocr.MIN_READABLE) & (ocr.symbol_ratio(c) <= ocr.MAX_SYMBOLS)
    return t.select("src", "row_id", usable.alias("body_usable"))


@query()
def s18_variant_selection(spark: SparkSession, d: str) -> DataFrame:
    """Which text of a run of pages to take."""
    return ocr.choose_variant(table(spark, d, "pdf_text_variants"), F.lit("ru"))


@query()
def s13_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Blocks split where a heading stands in them."""
    return blocks(spark, d).select("src", "row_id", "block", F.posexplode(ocr.split_at_headings(F.col("text"))).alias("part", "text"))


@query()
def s15_clean_pages(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).select("src", "row_id", "block", ocr.clean_page(F.col("text")).alias("text"))


@query()
def s19_drop_caps(spark: SparkSession, d: str) -> DataFrame:
    """Blocks after a heading with the lost initial of their first word."""
    from pyspark.sql import Window

    from quire.operators import structure

    w = Window.partitionBy("src", "row_id").orderBy("block")
    b = blocks(spark, d).withColumn("after", F.coalesce(structure.is_heading(F.lag("text").over(w)), F.lit(False)))
    return b.select("src", "row_id", "block", ocr.drop_caps(F.col("text"), F.col("after")).alias("text"))


# stress

_TOK = "[А-Яа-яЁё́]+|[^А-Яа-яЁё́]+"


@query(f"SELECT row_id, len(regexp_extract_all(text, '{_TOK}')) AS tokens, array_to_string(regexp_extract_all(text, '{_TOK}'), '') = text AS lossless FROM manifest_chunks WHERE text IS NOT NULL")
def t1_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "manifest_chunks").filter("text IS NOT NULL").withColumn("_t", stress.tokens(F.col("text")))
    return t.select("row_id", F.size("_t").cast("bigint").alias("tokens"), (F.array_join("_t", "") == F.col("text")).alias("lossless"))


def _dictionaries(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    user = spark.createDataFrame([("плотник", "пло́тник"), ("мельник", "ме́льник")], "word string, form string")
    return user, spark.createDataFrame([("плотник", "плотни́к"), ("река", "река́"), ("старый", "ста́рый")], "word string, form string")


_WORDS = f"(SELECT row_id, lower(replace(t, '́', '')) AS word FROM (SELECT row_id, unnest(regexp_extract_all(text, '{_TOK}')) AS t FROM manifest_chunks) WHERE regexp_matches(t, '[А-Яа-яЁё]'))"
_V = f"len(regexp_extract_all(word, '[{stress.VOWELS}]'))"


@query(f"""
SELECT count(*) FILTER (o IN ('user', 'builtin')) AS known, count(*) FILTER (o = 'unknown') AS unknown, count(*) FILTER (o = 'single') AS single, count(DISTINCT CASE WHEN o = 'unknown' THEN word END) AS different_unknown, row_id
FROM (SELECT row_id, word, CASE WHEN {_V} <= 1 THEN 'single' WHEN word IN ('плотник', 'мельник') THEN 'user' WHEN word IN ('река', 'старый') THEN 'builtin' ELSE 'unknown' END AS o FROM {_WORDS}) GROUP BY row_id""")
def t4_stress_statistics(spark: SparkSession, d: str) -> DataFrame:
    words = stress.words_of(table(spark, d, "manifest_chunks"), ["row_id"], "text")
    return stress.statistics(stress.resolve(words, *_dictionaries(spark)), ["row_id"])


@query(f"""
SELECT word, CASE WHEN {_V} <= 1 THEN word ELSE coalesce(CASE word WHEN 'плотник' THEN 'пло́тник' WHEN 'мельник' THEN 'ме́льник' END, CASE word WHEN 'река' THEN 'река́' WHEN 'старый' THEN 'ста́рый' END) END AS form FROM (SELECT DISTINCT word FROM {_WORDS})""")
def t2_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Every word of the corpus with its stressed form."""
    words = stress.words_of(table(spark, d, "manifest_chunks"), ["row_id"], "text").select("word").distinct().withColumn("token", F.col("word"))
    return stress.resolve(words, *_dictionaries(spark)).select("word", "form")


@query(f"SELECT word, {_V} AS vowels FROM (SELECT DISTINCT word FROM {_WORDS})")
def t3_vowels(spark: SparkSession, d: str) -> DataFrame:
    words = stress.words_of(table(spark, d, "manifest_chunks"), ["row_id"], "text").select("word").distinct()
    return words.select("word", stress.vowels(F.col("word")).cast("bigint").alias("vowels"))


@query(f"SELECT row_id, replace(regexp_replace(replace(text, 'плотник', 'пло́тник'), '([{stress.VOWELS}])́', '\\1\\1', 'g'), '́', '') AS text FROM manifest_chunks")
def t5_rendered(spark: SparkSession, d: str) -> DataFrame:
    """Texts with the stress told by doubled vowels."""
    marked = F.replace("text", F.lit("плотник"), F.lit("пло́тник"))
    return table(spark, d, "manifest_chunks").select("row_id", stress.rendered(marked, "double_vowel").alias("text"))


# recordings: the tables have none, so each text is given a tone as long as it would be spoken


def _tone(n: int, g: int) -> bytes:
    t = np.arange(int(8 * (200 + 10 * n)))
    x = 0.4 * np.sin(t * 0.3) * (1 + 0.5 * np.sin(t * 0.001))
    x = np.concatenate((x, np.zeros(int(8 * g)), x[: len(x) // 2]))
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes((x * 32767).astype("<i2").tobytes())
    return buffer.getvalue()


@query()
def q7_recordings(spark: SparkSession, d: str) -> DataFrame:
    """Measures and issues of a tone for every text: its length, silence and loudness are known."""
    t = table(spark, d, "chunk_specs").select("row_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), F.coalesce("pause_after_ms", F.lit(0)).alias("g"))
    m = audio.inspect(t, ["row_id", "n"], "n", "g", render=_tone)
    return m.select("row_id", F.round("duration_ms", 1).alias("duration_ms"), F.size("silences").alias("silences"), audio.issues(200 + 15.0 * F.col("n")).alias("issues"), audio.kept_ranges(F.col("silences"), F.col("duration_ms")).alias("kept"))
