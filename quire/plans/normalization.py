"""Queries of the normalisation stages over all texts, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import language, normalize, russian
from quire.functions.rules import Rule, rules_sql
from quire.operators import paragraphs, structure
from quire.plans.registry import TEXTS, query, texts
from quire.sources.tables import spread, table


def _stage(name: str, sql: str | None, stage=None) -> None:
    """A stage over all texts."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        f = stage or getattr(normalize, name)
        return texts(spark, d).select("src", "row_id", f(F.col("text")).alias("text"))

    run.__name__ = f"n_{name}"
    query(f"SELECT src, row_id, {sql} AS text FROM {TEXTS}" if sql else None)(run)


_STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_stage("encoding_artifacts", r"regexp_replace(text, '[\x{FFFD}\x{FEFF}\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')")
_stage("common_mojibake", "replace(replace(replace(replace(replace(replace(text, 'АЂ', 'А'), 'Ãƒ', 'А'), 'вЂ“', '—'), 'вЂ”', '—'), 'вЂœ', '«'), 'вЂў', '»')")
_stage("whitespace", r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[\x{200B}-\x{200D}\x{FEFF}\x0C\x0B]', '', 'g'), '[ \t]+', ' ', 'g'), '(?m) +$', '', 'g'), '(?m)^ +', '', 'g')")
_stage("broken_lines", r"regexp_replace(text, '([а-яё,])\n([а-яё])', '\1 \2', 'g')")
_stage("ellipsis", r"regexp_replace(text, '\.{3,}', '…', 'g')")
_stage("repeated_commas", "regexp_replace(text, ',{2,}', ',', 'g')")
_stage("dashes", r"replace(regexp_replace(regexp_replace(text, '\s--\s', ' — ', 'g'), '\s–\s', ' — ', 'g'), '--', '—')")
_stage("punctuation_spacing", r"regexp_replace(regexp_replace(regexp_replace(text, '\s+([,.:;!?])', '\1', 'g'), '([,.:;!?])([а-яёА-ЯЁa-zA-Z])', '\1 \2', 'g'), ' {2,}', ' ', 'g')")
_stage("empty_lines", r"regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g')")
_stage("indents", r"regexp_replace(text, '(?m)^[ \t]+', '', 'g')")
_stage("square_brackets", r"regexp_replace(text, '\[\d{1,2}\]', '', 'g')")
_stage("text_hash", "substr(sha256(text), 1, 16)")
_stage("count_words", r"CASE WHEN text IS NULL THEN NULL ELSE CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS INTEGER) END")
_stage("page_numbers", r"regexp_replace(text, '(?m)^\s*\d{1,4}\s*$', '', 'g')")
_HYPHENS = (Rule("\\xad\\n", "", before=r"\p{L}\p{N}_", after=r"\p{L}\p{N}_"), Rule(r"([а-яёА-ЯЁ])\([ \t]*\r?\n(?:[ \t]*\r?\n)*[ \t]*([а-яёА-ЯЁ])", "{1}{2}"), Rule(r"([а-яёА-ЯЁ])-\n([а-яё])", "{1}{2}"))
_stage("hyphenated_words", rules_sql("text", _HYPHENS))
_stage("quotes", "translate(" + rules_sql("text", (Rule('"([^"]+)"', "«{1}»", not_before=r"\p{L}\p{N}_", not_after=r"\p{L}\p{N}_"),)) + ", '“”„', '«»«')")
_LETTERS = r"A-Za-z\x{0400}-\x{04FF}"
_stage("parenthesis_hyphens", rules_sql("text", (Rule(r"\([ \t\r\n]+", "", before=_LETTERS, after=_LETTERS), Rule(r"\(", "-", before="0-9" + _LETTERS, after="0-9" + _LETTERS))))
_stage("inline_footnotes", rf"regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (length({_STRIP('x')}) < 100 AND regexp_matches(x, '^\s*\d{{1,2}}\s+[а-яё]'))), chr(10)), '\[\d{{1,2}}\]', '', 'g')")
_stage("mixed_script", russian.mixed_script_sql("text"), russian.mixed_script)
_stage("brackets", rules_sql("text", russian.BRACKETS), russian.brackets)
_stage("glued_words", rules_sql("text", russian.GLUED), russian.glued_words)
_stage("particle_hyphens", rules_sql("text", russian.PARTICLES), russian.particle_hyphens)
_stage("split_words", rules_sql("text", russian.SPLIT_WORDS), russian.split_words)
_stage("abbreviations", russian.abbreviations_sql("text"), russian.abbreviations)
_stage("ocr_artifacts", None, russian.ocr_artifacts)
_stage("numbers", None, russian.numbers)
_stage("contextual_vse", None, russian.contextual_vse)
_stage("utf8_mojibake", None, russian.utf8_mojibake)
_stage("markup", None)
_stage("boilerplate", None)
_stage("spoken_punctuation", None)
_stage("asr_text", r"regexp_replace(regexp_replace(regexp_replace(translate(lower(text), 'ё', 'е'), '[^\p{L}\p{N}\p{M}\s]', ' ', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g')")
_stage("without_space", r"regexp_replace(text, '\s+', '', 'g')")
_stage("without_marks", r"regexp_replace(text, '[\s\p{P}]+', '', 'g')")
_stage("letters_only", r"lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g'))")

_ALL_KINDS = (*structure.CHAPTER_PATTERNS, *structure.WORK_PATTERNS)


@query(rf"""
WITH l AS (SELECT src, row_id, n, line, {_STRIP('line')} AS bare FROM (SELECT src, row_id, unnest(range(len(lines))) AS n, lines, lines[n + 1] AS line FROM (SELECT src, row_id, string_split(text, chr(10)) AS lines FROM {TEXTS} WHERE text IS NOT NULL))),
 h AS (SELECT *, {structure.kind_sql('bare', _ALL_KINDS)} IS NOT NULL AS heading, regexp_replace(bare, '\d+', '#', 'g') AS masked FROM l),
 c AS (SELECT *, NOT heading AND bare <> '' AND length(bare) < 100 AS counted FROM h),
 s AS (SELECT src, row_id, bare FROM c WHERE counted GROUP BY ALL HAVING count(*) >= 3), m AS (SELECT src, row_id, masked FROM c WHERE counted AND masked <> bare GROUP BY ALL HAVING count(*) >= 3)
SELECT c.src, c.row_id, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (heading OR (s.bare IS NULL AND m.masked IS NULL)), '') AS text
FROM c LEFT JOIN s ON s.src = c.src AND s.row_id = c.row_id AND s.bare = c.bare LEFT JOIN m ON m.src = c.src AND m.row_id = c.row_id AND m.masked = c.masked GROUP BY c.src, c.row_id""")
def n_repeated_headers(spark: SparkSession, d: str) -> DataFrame:
    """Lines that repeat within a text."""
    t = texts(spark, d).filter("text IS NOT NULL")
    return t.select("src", "row_id", normalize.repeated_headers(F.col("text")).alias("text"))


@query(rf"SELECT src, row_id, count(*) AS lines FROM (SELECT src, row_id, unnest(string_split(text, chr(10))) AS line FROM {TEXTS}) WHERE {russian.is_noise_line_sql('line')} GROUP BY ALL")
def n_noise_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of debris that misreading leaves, per text."""
    lines = texts(spark, d).select("src", "row_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(russian.is_noise_line(F.col("line"))).groupBy("src", "row_id").agg(F.count(F.lit(1)).alias("lines"))


@query()
def n_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """All Russian stages."""
    return normalize.normalized(spread(texts(spark, d).select("src", "row_id", "text")), "text", normalize.RUSSIAN)


_TRACKED = [s for s in normalize.NEUTRAL if s[0] in ("encoding_artifacts", "common_mojibake", "whitespace", "page_numbers", "empty_lines", "indents", "dashes", "ellipsis", "repeated_commas")]


@query(rf"""
WITH a AS (SELECT text AS t0, regexp_replace(text, '[\x{{FFFD}}\x{{FEFF}}\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS t1 FROM {TEXTS} WHERE text IS NOT NULL),
 b AS (SELECT *, replace(replace(replace(replace(replace(replace(t1, 'АЂ', 'А'), 'Ãƒ', 'А'), 'вЂ“', '—'), 'вЂ”', '—'), 'вЂœ', '«'), 'вЂў', '»') AS t2 FROM a),
 c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(t2, chr(160), ' '), '[\x{{200B}}-\x{{200D}}\x{{FEFF}}\x0C\x0B]', '', 'g'), '[ \t]+', ' ', 'g'), '(?m) +$', '', 'g'), '(?m)^ +', '', 'g') AS t3 FROM b),
 e AS (SELECT *, regexp_replace(t3, '(?m)^\s*\d{{1,4}}\s*$', '', 'g') AS t4 FROM c), f AS (SELECT *, regexp_replace(t4, '\n{{3,}}', chr(10) || chr(10), 'g') AS t5 FROM e), g AS (SELECT *, regexp_replace(t5, '(?m)^[ \t]+', '', 'g') AS t6 FROM f),
 h AS (SELECT *, replace(regexp_replace(regexp_replace(t6, '\s--\s', ' — ', 'g'), '\s–\s', ' — ', 'g'), '--', '—') AS t7 FROM g), i AS (SELECT *, regexp_replace(t7, '\.{{3,}}', '…', 'g') AS t8 FROM h), j AS (SELECT *, regexp_replace(t8, ',{{2,}}', ',', 'g') AS t9 FROM i)
SELECT stage, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN t0 <> t1 THEN 'encoding_artifacts' END, CASE WHEN t1 <> t2 THEN 'common_mojibake' END, CASE WHEN t2 <> t3 THEN 'whitespace' END, CASE WHEN t3 <> t4 THEN 'page_numbers' END, CASE WHEN t4 <> t5 THEN 'empty_lines' END,
 CASE WHEN t5 <> t6 THEN 'indents' END, CASE WHEN t6 <> t7 THEN 'dashes' END, CASE WHEN t7 <> t8 THEN 'ellipsis' END, CASE WHEN t8 <> t9 THEN 'repeated_commas' END], lambda x: x IS NOT NULL)) AS stage FROM j) GROUP BY stage""")
def n_changed_stages(spark: SparkSession, d: str) -> DataFrame:
    """How many texts each stage of a pipeline changes."""
    rows = normalize.normalized(texts(spark, d).filter("text IS NOT NULL").select("text"), "text", _TRACKED, tracked=True)
    return rows.select(F.explode("changed").alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT src, row_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 119) || '…' ELSE text END AS preview FROM {TEXTS}")
def n_truncate(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("src", "row_id", normalize.truncate(F.col("text"), 120).alias("preview"))


# words restored from the rest of their book


@query(r"""
WITH c AS (SELECT DISTINCT book_id, w FROM (SELECT book_id, unnest(regexp_extract_all(text, '[а-яё,;»—-]\s([А-ЯЁ][а-яё]{4,})', 1)) AS w FROM manifest_chunks)),
 m AS (SELECT book_id, key, min(w) AS new FROM (SELECT book_id, lower(substr(w, 2)) AS key, w FROM c) WHERE length(key) >= 4 GROUP BY book_id, key),
 t AS (SELECT row_id, book_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[А-Яа-яЁё-]+'), lambda x: lower(x)))) AS word FROM manifest_chunks)
SELECT t.row_id, t.word, m.new FROM t JOIN m ON m.book_id = t.book_id AND m.key = t.word""")
def n_dropped_initials(spark: SparkSession, d: str) -> DataFrame:
    """Words of a text that are a name of its book without the first letter."""
    chunks = table(spark, d, "manifest_chunks")
    return paragraphs.words_to_replace(chunks, ["book_id"], ["row_id"], "text", paragraphs.dropped_initials(paragraphs.names_of(chunks, ["book_id"], "text"), ["book_id"]))


@query()
def n_proper_names(spark: SparkSession, d: str) -> DataFrame:
    """The texts of each book with its names put right."""
    chunks = table(spark, d, "manifest_chunks").select("row_id", "book_id", "text")
    found = paragraphs.names_of(chunks, ["book_id"], "text")
    mapping = paragraphs.dropped_initials(found, ["book_id"]).unionByName(paragraphs.undoubled(found, ["book_id"]))
    return paragraphs.replace_words(chunks, ["book_id"], ["row_id"], "text", mapping).select("row_id", "text")


@query(r"""
WITH w AS (SELECT lower(x) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[А-Яа-яЁё]+')) AS x FROM manifest_chunks) GROUP BY 1),
 p AS (SELECT replace(word, 'ё', 'е') AS key, word, n FROM w WHERE contains(word, 'ё') AND replace(word, 'ё', 'е') <> 'все'), b AS (SELECT key, max_by(word, (n, word)) AS new, sum(n) AS n FROM p GROUP BY key)
SELECT key, new FROM b LEFT JOIN w ON w.word = b.key WHERE b.n >= 3 AND coalesce(w.n, 0) * 20 <= b.n""")
def n_yo_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Words whose spelling with ё leaves no doubt, from the corpus itself."""
    return paragraphs.yo_dictionary(table(spark, d, "manifest_chunks").select("text"))


@query()
def n_yoficate(spark: SparkSession, d: str) -> DataFrame:
    """Texts with ё restored."""
    chunks = table(spark, d, "manifest_chunks").select("row_id", "text")
    return paragraphs.yoficate(chunks, ["row_id"], "text", paragraphs.yo_dictionary(chunks.select("text")))


@query(r"""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY chunk_index, row_id) AS pos FROM manifest_chunks WHERE trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> ''),
 y AS (SELECT *, regexp_matches(text, '[а-яёА-ЯЁ][-(]\s*$') AND coalesce(regexp_matches(lead(text) OVER w, '^\s*[а-яёА-ЯЁ]'), false) AS fits FROM x WINDOW w AS (PARTITION BY book_id, chapter_index ORDER BY chunk_index, row_id)),
 z AS (SELECT *, pos - row_number() OVER (PARTITION BY book_id, chapter_index, fits ORDER BY chunk_index, row_id) AS run FROM y)
SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY book_id, chapter_index, run ORDER BY chunk_index, row_id) AS k FROM z WHERE fits) WHERE k % 2 = 1""")
def n_hyphen_joins(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose last word goes on in the next one."""
    return paragraphs.hyphen_joins(table(spark, d, "manifest_chunks"), ["book_id", "chapter_index"], ["chunk_index", "row_id"]).filter("joins").select("row_id")


@query()
def n_books(spark: SparkSession, d: str) -> DataFrame:
    """Whole books normalised: all stages, names put right, words joined across chunks."""
    chunks = table(spark, d, "manifest_chunks").select("row_id", "book_id", "chapter_index", "chunk_index", "text")
    return paragraphs.normalize_books(chunks, ["chunk_index", "row_id"], normalize.NEUTRAL).select("row_id", "text")


# languages and scripts

_BOOK_LANGUAGE = """CASE
 WHEN raw IN ('ru','rus','russian') OR base IN ('ru','rus','russian') AND raw NOT IN ('en','eng','english','zh','chi','chi-sim','chinese','kk','kaz','kazakh','kz','uz','uzb','uzbek') THEN 'ru'
 WHEN raw IN ('en','eng','english') OR base IN ('en','eng','english') THEN 'en'
 WHEN raw IN ('zh','chi','chi-sim','chinese') OR base IN ('zh','chi','chinese') THEN 'zh'
 WHEN raw IN ('kk','kaz','kazakh','kz') OR base IN ('kk','kaz','kazakh','kz') THEN 'kk'
 WHEN raw IN ('uz','uzb','uzbek') OR base IN ('uz','uzb','uzbek') THEN 'uz' ELSE 'ru' END"""


@query(f"""
SELECT lang, count(*) AS n FROM (SELECT {_BOOK_LANGUAGE} AS lang FROM (
 SELECT raw, split_part(raw, '-', 1) AS base FROM (SELECT lower(replace(trim(coalesce(language, '')), '_', '-')) AS raw FROM manifest_chunks)))
GROUP BY lang""")
def l1_language_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest_chunks").groupBy(language.book_language(F.col("language")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


_HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"


@query(rf"""
SELECT src, row_id, len(regexp_extract_all(text, '[\x{{0400}}-\x{{04FF}}]')) AS cyrillic, len(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{024F}}]')) AS latin, len(regexp_extract_all(text, '[{_HAN}]')) AS han,
 round(coalesce(len(regexp_extract_all(substr(text, 1, 10000), '[\x{{0400}}-\x{{04FF}}]')) / nullif(len(regexp_extract_all(substr(text, 1, 10000), '\p{{L}}')), 0), 0), 6)::DOUBLE AS ratio,
 round(coalesce(len(list_filter(regexp_extract_all(text, '[\x{{0400}}-\x{{04FF}}]+'), lambda w: length(w) >= 3)) / nullif(len(regexp_extract_all(text, '[\x{{0400}}-\x{{04FF}}]+')), 0), 0), 6)::DOUBLE AS readable FROM {TEXTS} WHERE text IS NOT NULL""")
def l2_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Characters per script, and how much of a text is Russian and reads as words."""
    t, c, ru = texts(spark, d).filter("text IS NOT NULL"), F.col("text"), F.lit("ru")
    count = lambda code: language.script_chars(c, F.lit(code)).cast("bigint")
    return t.select("src", "row_id", count("ru").alias("cyrillic"), count("en").alias("latin"), count("zh").alias("han"), F.round(language.script_ratio(c, ru), 6).alias("ratio"), F.round(language.readable_ratio(c, ru), 6).alias("readable"))


@query(rf"""
SELECT src, row_id, round(coalesce(cyr / nullif(letters, 0), 0), 6)::DOUBLE AS ratio, round(coalesce(long / nullif(words, 0), 0), 6)::DOUBLE AS readable FROM (
 SELECT src, row_id, len(regexp_extract_all(text, '[\x{{0400}}-\x{{04FF}}]')) AS cyr, len(regexp_extract_all(text, '\p{{L}}')) AS letters, len(regexp_extract_all(text, '[а-яёА-ЯЁ]+')) AS words, len(list_filter(regexp_extract_all(text, '[а-яёА-ЯЁ]+'), lambda w: length(w) >= 4)) AS long FROM {TEXTS} WHERE text IS NOT NULL)""")
def l3_cyrillic(spark: SparkSession, d: str) -> DataFrame:
    """Share of Cyrillic letters, and of Cyrillic words of four letters and more."""
    t, c = texts(spark, d).filter("text IS NOT NULL"), F.col("text")
    return t.select("src", "row_id", F.round(language.cyrillic_ratio(c), 6).alias("ratio"), F.round(language.readable_cyrillic(c), 6).alias("readable"))

