"""Queries of structure: headings, works, chapters, contents lists and special paragraphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import structure, works
from quire.plans.registry import BLOCKS, blocks, query
from quire.sources.tables import table

_ORDER = ["page_number", "row_id", "src", "block"]
_BY = "page_number, row_id, src, block"
_FIRST = r"trim(regexp_extract(regexp_replace(text, '^\s+', ''), '^([^\n]*)', 1))"
_LINES = f"(SELECT *, {_FIRST} AS line FROM {BLOCKS})"
_C, _W = structure.kind_sql("line", structure.CHAPTER_PATTERNS), f"CASE WHEN length(trim(line)) <= {structure.WORK_CHARS} THEN {structure.kind_sql('line', structure.WORK_PATTERNS)} END"
_DOC_LINES = "(SELECT doc_id, CAST(p AS INTEGER) AS pos, lines[p + 1] AS line FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)))"
_DIVIDED = f"(SELECT *, sum(CASE WHEN {_W} IS NOT NULL THEN 1 ELSE 0 END) OVER w AS work, sum(CASE WHEN {_C} IS NOT NULL THEN 1 ELSE 0 END) OVER w AS chapter FROM {_LINES} WINDOW w AS (PARTITION BY book_id ORDER BY {_BY} ROWS UNBOUNDED PRECEDING))"
_TABLE = rf"""(SELECT book_id, work, row_number() OVER (PARTITION BY book_id ORDER BY work, chapter) AS chapter, CASE WHEN chapter > 0 THEN {_FIRST.replace('text', 'head')} ELSE '' END AS title, paragraphs, chars FROM (
 SELECT book_id, work, chapter, arg_min(text, (page_number, row_id, src, block)) AS head, count(*) AS paragraphs, sum(length(regexp_replace(text, '[\s*#~=_-]+', '', 'g')))::BIGINT AS chars FROM {_DIVIDED} GROUP BY book_id, work, chapter) WHERE chars >= 10)"""


def _table(spark: SparkSession, d: str) -> DataFrame:
    return works.chapter_table(works.chapters(blocks(spark, d), _ORDER), _ORDER)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text").filter("text IS NOT NULL")


def _doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query(f"SELECT kind, count(*) AS n FROM (SELECT {structure.kind_sql('line', structure.CHAPTER_PATTERNS)} AS kind FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM {BLOCKS} UNION ALL SELECT line FROM {_DOC_LINES})) WHERE kind IS NOT NULL GROUP BY kind")
def c1_heading_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Lines of pages and documents by the kind of chapter heading they are."""
    lines = blocks(spark, d).select(F.explode(F.split("text", "\n")).alias("line")).unionByName(_doc_lines(spark, d).select("line"))
    return lines.select(structure.chapter_kind(F.col("line")).alias("kind")).filter("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT kind, count(*) AS n FROM (SELECT {_W} AS kind FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM {BLOCKS} UNION ALL SELECT line FROM {_DOC_LINES})) WHERE kind IS NOT NULL GROUP BY kind")
def c2_work_kinds(spark: SparkSession, d: str) -> DataFrame:
    lines = blocks(spark, d).select(F.explode(F.split("text", "\n")).alias("line")).unionByName(_doc_lines(spark, d).select("line"))
    return lines.select(structure.work_kind(F.col("line")).alias("kind")).filter("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT src, row_id, block, line, coalesce({_W}, {_C}) AS kind, {_W} IS NOT NULL AS is_work FROM {_LINES} WHERE coalesce({_W}, {_C}) IS NOT NULL")
def c3_heading_hits(spark: SparkSession, d: str) -> DataFrame:
    return works.heading_hits(blocks(spark, d)).select("src", "row_id", "block", "line", "kind", "is_work")


_HITS = rf"(SELECT *, coalesce(TRY_CAST(regexp_extract(line, '([0-9]{{1,6}})', 1) AS INTEGER), 0) AS number FROM (SELECT *, {_C} AS kind FROM {_LINES}) WHERE kind IS NOT NULL)"


@query(f"""
WITH h AS {_HITS}, m AS (SELECT *, number < max(number) OVER (PARTITION BY book_id ORDER BY {_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back FROM h WHERE kind = 'numeric_heading'),
 b AS (SELECT book_id FROM m GROUP BY book_id HAVING count(*) >= 3 AND avg(CASE WHEN back THEN 1 ELSE 0 END) > 0.25)
SELECT src, row_id, block, kind, number FROM h WHERE kind <> 'numeric_heading' OR book_id NOT IN (SELECT book_id FROM b)""")
def c4_headings(spark: SparkSession, d: str) -> DataFrame:
    """Chapter headings without the numbers of notes."""
    hits = works.heading_hits(blocks(spark, d)).withColumn("kind", structure.chapter_kind(F.col("line"))).filter("kind IS NOT NULL")
    return structure.without_numeric_noise(structure.numbered(hits), _ORDER).select("src", "row_id", "block", "kind", "number")


@query(rf"""
SELECT src, row_id, block, line FROM {_LINES} WHERE regexp_matches(line, '(?i)^\s*глава\s+\S{{1,10}}\s*$') AND {_C} IS NULL
 AND book_id IN (SELECT book_id FROM {_LINES} WHERE {_C} IS NOT NULL AND starts_with(lower(line), 'глава') GROUP BY book_id HAVING count(*) >= 3)""")
def c5_orphan_headings(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    return works.orphan_headings(b, works.heading_hits(b)).select("src", "row_id", "block", "line")


_RANGES = rf"""(SELECT doc_id, start_pos, CAST(coalesce(min(pos) FILTER (pos > start_pos AND length(trim(line)) > 200), max(pos) + 1) AS INTEGER) AS end_pos FROM {_DOC_LINES}
 JOIN (SELECT doc_id, min(pos) AS start_pos FROM {_DOC_LINES} WHERE regexp_matches(line, '(?i)^\s*(?:оглавление|содержание|contents|table of contents)\s*$') GROUP BY doc_id) USING (doc_id) GROUP BY doc_id, start_pos)"""


@query(f"SELECT * FROM {_RANGES}")
def c6_contents(spark: SparkSession, d: str) -> DataFrame:
    """Where the contents list of each document lies, in lines."""
    return works.contents_ranges(_docs(spark, d))


def _entries_sql() -> str:
    kind = "CASE " + " ".join(f"WHEN regexp_matches(c, '{p}') THEN '{k}'" for k, p in works.ENTRIES) + " END"
    title = "CASE entry " + " ".join(f"WHEN '{k}' THEN regexp_extract(c, '{p}', 1)" for k, p in works.ENTRIES) + " END"
    return rf"""(WITH a AS (SELECT doc_id, pos, trim(line) AS b FROM {_DOC_LINES} WHERE length(trim(line)) >= 3), e AS (SELECT *, trim(regexp_replace(b, '\s*[.…·–—-]{{3,}}\s*[0-9]*\s*$', '')) AS c FROM a),
 k AS (SELECT *, {kind} AS entry FROM e WHERE length(c) >= 3), t AS (SELECT *, trim(regexp_replace({title}, '\s*[.…]+\s*$', '')) AS title, regexp_extract(c, '^\s*([0-9]+(?:\.[0-9]+)*)\.\s', 1) AS num FROM k WHERE entry IS NOT NULL),
 f AS (SELECT *, CASE WHEN entry = 'numbered' THEN length(num) - length(replace(num, '.', '')) ELSE 0 END AS l0 FROM t WHERE title <> '' AND (entry <> 'numbered' OR length(title) > 3)),
 g AS (SELECT *, first_value(CASE WHEN l0 = 0 THEN title END IGNORE NULLS) OVER w AS ft, min(CASE WHEN l0 = 0 AND entry <> 'numbered' THEN title END) OVER w AS lo, max(CASE WHEN l0 = 0 AND entry <> 'numbered' THEN title END) OVER w AS hi
  FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, pos, entry, title, nullif(regexp_extract(b, '\s+([0-9]+)\s*$', 1), '') AS page, CAST(CASE WHEN entry = 'numbered' AND l0 = 0 AND (coalesce(ft <> title, false) OR coalesce(lo <> title OR hi <> title, false)) THEN 1 ELSE l0 END AS INTEGER) AS level FROM g)"""


@query(f"SELECT * FROM {_entries_sql()}")
def c7_contents_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of contents lists among the lines of all documents."""
    return works.entries(_doc_lines(spark, d))


@query(f"""
SELECT src, row_id, block FROM (SELECT *, sum(length(text) + 2) OVER (PARTITION BY book_id ORDER BY {_BY} ROWS UNBOUNDED PRECEDING) - 2 AS stop FROM {BLOCKS}) WHERE stop - length(text) < 20000 AND stop > 10000""")
def c8_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that overlap the code points 10 000 to 20 000 of their book."""
    b = blocks(spark, d)
    ranges = b.select("book_id").distinct().select("book_id", F.lit(10000).alias("start"), F.lit(20000).alias("end"))
    return works.overlapping(b, _ORDER, ranges).select("src", "row_id", "block")


@query(rf"""
WITH e AS {_entries_sql()}, r AS {_RANGES}, t AS (SELECT e.doc_id, title, min(pos) AS seen FROM e JOIN r ON r.doc_id = e.doc_id AND pos > start_pos AND pos < end_pos WHERE length(title) > 5 GROUP BY e.doc_id, title)
SELECT l.doc_id, l.pos, arg_min(title, seen) AS title FROM {_DOC_LINES} l JOIN r ON r.doc_id = l.doc_id AND l.pos >= end_pos JOIN t ON t.doc_id = l.doc_id WHERE NOT regexp_matches(line, '\.{{3,}}') AND length(line) <= 200 AND contains(lower(line), lower(title)) GROUP BY l.doc_id, l.pos""")
def c9_entries_in_body(spark: SparkSession, d: str) -> DataFrame:
    """Lines after a contents list that hold one of its titles."""
    docs = _docs(spark, d)
    ranges = works.contents_ranges(docs)
    inside = works.entries(_doc_lines(spark, d)).join(ranges, "doc_id").filter("pos > start_pos AND pos < end_pos").select("doc_id", "pos", "title")
    return works.entries_in_body(docs, inside, ranges)


@query(rf"""
WITH l AS (SELECT doc_id, pos, trim(line) AS line FROM {_DOC_LINES} WHERE trim(line) <> ''), x AS (SELECT *, lead(line, 1) OVER w AS t, lead(line, 2) OVER w AS p FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, CAST(regexp_extract(line, '([0-9]+)$', 1) AS INTEGER) AS number, regexp_replace(t, '\s+', ' ', 'g') AS title FROM x WHERE regexp_matches(line, '(?i)^книга\s+[0-9]{{1,2}}$') AND regexp_matches(t, '^[А-Яа-яЁё][А-Яа-яЁё\s-]{{2,80}}$') AND regexp_matches(p, '^[0-9]{{1,4}}$')""")
def c10_work_titles(spark: SparkSession, d: str) -> DataFrame:
    return works.work_titles(_docs(spark, d))


@query()
def c12_works_from_resets(spark: SparkSession, d: str) -> DataFrame:
    """Where works begin in books that count their chapters from one again."""
    return works.works_from_resets(blocks(spark, d), _ORDER)


@query(f"SELECT src, row_id, block, CAST(work AS BIGINT) AS work, CAST(chapter AS BIGINT) AS chapter FROM {_DIVIDED}")
def c15_works_and_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Work and chapter of every block."""
    return works.chapters(blocks(spark, d), _ORDER).select("src", "row_id", "block", "work", "chapter")


@query(f"SELECT book_id, CAST(work AS BIGINT) AS work, CAST(chapter AS INTEGER) AS chapter, title, paragraphs, chars FROM {_TABLE}")
def c14_chapter_table(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d)


@query(rf"""
WITH t AS (SELECT *, regexp_matches(title, '(?i)^\s*глава\s+') AS g FROM {_TABLE})
SELECT book_id, CAST(chapter AS INTEGER) AS chapter, CASE WHEN g AND count(*) OVER (PARTITION BY book_id, work, g) >= 2 THEN regexp_extract(title, '(?i)^\s*(глава)\s+', 1) || ' ' || row_number() OVER (PARTITION BY book_id, work, g ORDER BY chapter) ELSE title END AS title FROM t""")
def c17_titles(spark: SparkSession, d: str) -> DataFrame:
    """Chapter titles counted anew."""
    return works.renumbered_titles(_table(spark, d)).select("book_id", "chapter", "title")


@query(rf"""
WITH t AS {_TABLE}, k AS (SELECT book_id, list(x ORDER BY x) AS r FROM (SELECT book_id, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS x FROM t GROUP BY ALL HAVING count(*) > 1) WHERE x <> '' GROUP BY book_id),
 c AS (SELECT book_id, greatest(count(DISTINCT CASE WHEN work > 0 THEN work END), 1) AS work_count, count(*) AS chapter_count FROM t GROUP BY book_id)
SELECT book_id, work_count, chapter_count, coalesce(r, []) AS repeated_titles, len(coalesce(r, [])) > 0 OR work_count >= 2 AS needs_review FROM c LEFT JOIN k USING (book_id)""")
def c18_summary(spark: SparkSession, d: str) -> DataFrame:
    return works.structure_summary(_table(spark, d))


@query(f"""
WITH w AS (SELECT book_id, work, count(*) AS n, count(*) FILTER (paragraphs <= 3) AS tiny, max(paragraphs) AS most, avg(paragraphs) AS mean FROM {_TABLE} GROUP BY book_id, work)
SELECT book_id, CAST(sum(n) AS BIGINT) AS total_chapters, round(sum(tiny) / sum(n), 6)::DOUBLE AS tiny_ratio, array_to_string(list_filter([CASE WHEN bool_or(n > 50) THEN 'too_many_chapters' END, CASE WHEN bool_or(n > 5 AND tiny / n > 0.7) THEN 'too_many_tiny_chapters' END,
 CASE WHEN bool_or(n > 3 AND most > 5 * mean) THEN 'very_uneven_distribution' END], lambda x: x IS NOT NULL), ',') AS reasons FROM w GROUP BY book_id""")
def c20_sanity(spark: SparkSession, d: str) -> DataFrame:
    return works.sanity(_table(spark, d))


@query(f"""
WITH h AS (SELECT book_id, count(*) FILTER ({_W} IS NOT NULL) AS works, count(*) FILTER ({_C} IS NOT NULL) AS chapters FROM {_LINES} GROUP BY book_id)
SELECT book_id, CASE WHEN works >= 2 THEN 'works' WHEN chapters > 0 THEN 'headings' ELSE 'single' END AS strategy FROM h""")
def c19_strategy(spark: SparkSession, d: str) -> DataFrame:
    """How each book is divided: by works, by headings, or not at all."""
    b = blocks(spark, d)
    counts = works.heading_hits(b).groupBy("book_id").agg(F.count_if("is_work").alias("w"), F.count_if(structure.chapter_kind(F.col("line")).isNotNull()).alias("c"))
    rows = b.select("book_id").distinct().join(counts, "book_id", "left")
    return rows.select("book_id", F.when(F.col("w") >= 2, "works").when(F.col("c") > 0, "headings").otherwise("single").alias("strategy"))


@query(r"""
WITH p AS (SELECT *, trim(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g')) AS t FROM manifest_chunks),
 q AS (SELECT *, regexp_matches(t, '(?i)^\s*(?:глава\s+(?:[0-9]+|[ivxlcdm|]+|[а-яё-]+)|chapter\s+\S+|пролог|эпилог)(?:$|[^\p{L}\p{N}_])') AS ch, regexp_matches(t, '(?i)^\s*(?:аннотация|annotation)\s*[.:]?\s*$') AS mk, len(regexp_extract_all(t, '[\p{L}\p{N}_]+')) AS words FROM p),
 r AS (SELECT *, words BETWEEN 5 AND 120 AND NOT ch AND NOT mk AS ok, row_number() OVER w AS n, coalesce(lead(ch) OVER w, false) AS nx FROM q WINDOW w AS (PARTITION BY book_id, chapter_index ORDER BY chunk_index, row_id)),
 s AS (SELECT *, coalesce(lag(mk) OVER w, false) OR coalesce(lag(ok) OVER w AND lag(mk, 2) OVER w, false) OR coalesce(lag(ok) OVER w AND lag(ok, 2) OVER w AND lag(mk, 3) OVER w, false) AS fol FROM r WINDOW w AS (PARTITION BY book_id, chapter_index ORDER BY chunk_index, row_id))
SELECT row_id, section FROM (SELECT row_id, CASE WHEN n <= 3 AND words BETWEEN 4 AND 28 AND length(t) <= 220 AND NOT ch AND NOT mk AND nx AND (regexp_matches(t, '(?i)(?:^|\s)(?:из|from)\s+[^.!?]{3,80}$') OR contains(coalesce(text, ''), chr(10))) THEN 'epigraph'
 WHEN mk OR (ok AND fol) THEN 'annotation' END AS section FROM s) WHERE section IS NOT NULL""")
def c21_special_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Epigraphs and annotations among the chunks."""
    return works.special_paragraphs(table(spark, d, "manifest_chunks"), ["book_id", "chapter_index"], ["chunk_index", "row_id"]).filter("section IS NOT NULL").select("row_id", "section")


@query()
def c22_marked_segments(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the one table that lie in a special paragraph of the other."""
    group = ["book_id", "chapter_index"]
    special = works.special_paragraphs(table(spark, d, "manifest_chunks"), group, ["chunk_index", "row_id"])
    return works.mark_segments(table(spark, d, "chunk_specs").select(*group, F.col("row_id").alias("segment"), "text"), special, group)


@query()
def c11_title_pages(spark: SparkSession, d: str) -> DataFrame:
    """Where the works that a contents list names begin."""
    docs = _docs(spark, d)
    return works.title_pages(docs, works.work_titles(docs), works.contents_ranges(docs).select("doc_id", "end_pos"))


@query()
def c13_late_works(spark: SparkSession, d: str) -> DataFrame:
    """Numbered headings that begin works."""
    return works.late_works(works.heading_hits(blocks(spark, d)), _ORDER)


@query(rf"""
WITH s AS (SELECT book_id, work FROM {_DIVIDED} GROUP BY book_id, work HAVING sum(length(text)) >= 30000 AND count(*) >= 4 AND max(chapter) = min(chapter)),
 t AS (SELECT book_id, work, src, row_id, block, trim(regexp_replace(text, '\s+', ' ', 'g')) AS title FROM {_DIVIDED}),
 u AS (SELECT * FROM t SEMI JOIN s USING (book_id, work) WHERE regexp_matches(title, '^[А-ЯЁ][А-Яа-яЁё0-9\s''%-]{{2,70}}$') AND lower(title) NOT IN ('содержание', 'оглавление'))
SELECT src, row_id, block, title FROM u SEMI JOIN (SELECT book_id, work FROM u GROUP BY book_id, work HAVING count(DISTINCT lower(title)) >= 2) v USING (book_id, work)""")
def c16_internal_sections(spark: SparkSession, d: str) -> DataFrame:
    """Title-like paragraphs inside large works without chapters."""
    return works.internal_sections(works.chapters(blocks(spark, d), _ORDER), _ORDER).select("src", "row_id", "block", "title")
