"""The structure of books: works, chapters, contents lists, special paragraphs.

Paragraphs are rows (book_id, pos, text), ``pos`` any column or struct that orders them. What counts along a whole book
(chapter and work numbers) is a prefix sum over range partitions, so no book is gathered in one task; windows only
run over the few rows that are headings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import structure
from quire.session import cut


def running_sums(df: DataFrame, group: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with inclusive running sums of ``values`` along ``order`` within each group.

    Rows are range-partitioned by group and order; each partition sums its own rows, and the small table of sums
    (partitions x groups in them) gives each partition what comes before it.
    """
    ranged = cut(df.withColumns({f"_v_{n}": c.cast("bigint") for n, c in values.items()}).repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()))
    of = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(group, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = sums.select(group, "_part", *[F.coalesce(F.sum(f"_t_{n}").over(of), F.lit(0)).alias(f"_b_{n}") for n in values])
    inside = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({n: F.sum(f"_v_{n}").over(inside) for n in values}).join(before, [group, "_part"])
    return out.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in values}).drop("_part", *[f"_v_{n}" for n in values], *[f"_b_{n}" for n in values])


def first_line(text: Column) -> Column:
    return F.trim(F.regexp_extract(F.regexp_replace(text, r"^\s+", ""), r"^([^\n]*)", 1))


def heading_hits(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs whose first line is a heading: with ``line``, ``kind`` and whether it is one of a work."""
    rows = paragraphs.withColumn("line", first_line(F.col("text"))).filter(F.col("line").rlike(structure.HEADING_HINT))
    rows = rows.withColumns({"_c": structure.chapter_kind(F.col("line")), "_w": structure.work_kind(F.col("line"))})
    return rows.withColumns({"kind": F.coalesce("_w", "_c"), "is_work": F.col("_w").isNotNull()}).filter("kind IS NOT NULL").drop("_c", "_w")


#: A chapter heading whose numeral was misread, the first chapter of a work, a numbered title.
ORPHAN, FIRST_CHAPTER = r"(?iu)^\s*глава\s+\S{1,10}\s*$", r"^\s*[Гг][Лл][Аа][Вв][Аа]\s+(?:1|I|i|[Пп]ервая)(?:$|[^\p{L}\p{N}_])"
NUMBERED_TITLE = r"^\s*[0-9]{1,2}\.\s+[А-Яа-яЁё][А-Яа-яЁё\s-]{2,80}$"
CONFIRMED, LOOK_BACK = 3, 7


def orphan_headings(paragraphs: DataFrame, hits: DataFrame) -> DataFrame:
    """Paragraphs that open like a chapter with a misread numeral, in books with ``CONFIRMED`` chapters of that kind or more."""
    sure = hits.filter(F.lower("line").startswith("глава")).groupBy("book_id").count().filter(F.col("count") >= CONFIRMED).select("book_id")
    lines = paragraphs.withColumn("line", first_line(F.col("text"))).filter(F.col("line").rlike(ORPHAN))
    return lines.filter(structure.chapter_kind(F.col("line")).isNull()).join(sure, "book_id", "left_semi")


def works_from_resets(paragraphs: DataFrame, order: list[str]) -> DataFrame:
    """(book_id, *order, title): where works begin in books that count their chapters from one again and again.

    That is a numbered title at most ``LOOK_BACK`` paragraphs before a first chapter, else the chapter itself.
    """
    w = Window.partitionBy("book_id").orderBy(*order)
    # paragraphs that can matter: first chapters and numbered titles; the distance is told by their place
    rows = running_sums(paragraphs, "book_id", order, {"place": F.lit(1)}).withColumn("line", F.regexp_replace("text", r"\s+", " "))
    rows = rows.filter(F.col("line").rlike(NUMBERED_TITLE) | first_line(F.col("text")).rlike(FIRST_CHAPTER)).withColumn("_first", first_line(F.col("text")).rlike(FIRST_CHAPTER))
    title = F.last(F.when(F.col("line").rlike(NUMBERED_TITLE), F.struct("place", *order, "line")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_t", title).filter("_first").withColumn("_near", F.col("place") - F.col("_t.place") <= LOOK_BACK)
    several = rows.groupBy("book_id").count().filter("count >= 2").select("book_id")
    near = F.coalesce("_near", F.lit(False))
    return rows.join(several, "book_id", "left_semi").select("book_id", *[F.when(near, F.col(f"_t.{o}")).otherwise(F.col(o)).alias(o) for o in order], F.when(near, F.col("_t.line")).alias("title"))


def chapters(paragraphs: DataFrame, order: list[str]) -> DataFrame:
    """``paragraphs`` with ``work``, ``chapter`` (both counted along the book, 0 before the first) of each."""
    kinds = paragraphs.withColumn("_line", first_line(F.col("text")))
    hint = F.col("_line").rlike(structure.HEADING_HINT)
    rows = kinds.withColumns({"_w": hint & structure.work_kind(F.col("_line")).isNotNull(), "_c": hint & structure.chapter_kind(F.col("_line")).isNotNull()})
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    return running_sums(rows, "book_id", order, {"work": flag("_w"), "chapter": flag("_c")}).drop("_line", "_w", "_c")


def chapter_table(divided: DataFrame, order: list[str]) -> DataFrame:
    """A row per chapter of ``chapters``: (book_id, work, chapter, title, paragraphs, chars); chapters of fewer than ten characters that
    are no separators are left out and the others numbered anew."""
    start = F.struct(*order)
    rows = divided.groupBy("book_id", "work", "chapter").agg(F.min_by("text", start).alias("_head"), F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length(F.regexp_replace("text", r"[\s*#~=_-]+", ""))).alias("chars"))
    kept = rows.filter("chars >= 10").withColumn("title", F.when(F.col("chapter") > 0, first_line(F.col("_head"))).otherwise(""))
    return kept.withColumn("chapter", F.row_number().over(Window.partitionBy("book_id").orderBy("work", "chapter"))).drop("_head")


def renumbered_titles(table: DataFrame) -> DataFrame:
    """Titles "Глава X" counted anew within each work that has two or more of them."""
    glava = F.col("title").rlike(r"(?iu)^\s*глава\s+")
    rows = table.withColumn("_g", glava)
    number = F.row_number().over(Window.partitionBy("book_id", "work", "_g").orderBy("chapter"))
    many = F.count(F.lit(1)).over(Window.partitionBy("book_id", "work", "_g")) >= 2
    return rows.withColumn("title", F.when(F.col("_g") & many, F.concat(F.regexp_extract("title", r"(?iu)^\s*(глава)\s+", 1), F.lit(" "), number)).otherwise(F.col("title"))).drop("_g")


def structure_summary(table: DataFrame) -> DataFrame:
    """Per book: works, chapters, titles met more than once, and whether someone should look."""
    titles = table.withColumn("_t", F.trim(F.regexp_replace(F.lower("title"), r"\s+", " "))).groupBy("book_id", "_t").agg(F.count(F.lit(1)).alias("n"))
    twice = titles.filter("n > 1 AND _t <> ''").groupBy("book_id").agg(F.array_sort(F.collect_list("_t")).alias("repeated_titles"))
    counts = table.groupBy("book_id").agg(F.greatest(F.countDistinct(F.when(F.col("work") > 0, F.col("work"))), F.lit(1)).alias("work_count"), F.count(F.lit(1)).alias("chapter_count"))
    out = counts.join(twice, "book_id", "left").withColumn("repeated_titles", F.coalesce("repeated_titles", F.array().cast("array<string>")))
    return out.withColumn("needs_review", (F.size("repeated_titles") > 0) | (F.col("work_count") >= 2))


#: A tiny chapter; the number of chapters, the share of tiny ones and the unevenness that are suspicious.
TINY, MANY, MOSTLY, UNEVEN = 3, 50, 0.7, 5.0


def sanity(table: DataFrame) -> DataFrame:
    """Per book: chapters, share of tiny ones, and the reasons why its chapters are suspicious."""
    works = table.groupBy("book_id", "work").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("paragraphs") <= TINY).alias("tiny"), F.max("paragraphs").alias("most"), F.avg("paragraphs").alias("mean"))
    book = works.groupBy("book_id").agg(
        F.sum("n").alias("total_chapters"), F.sum("tiny").alias("_tiny"), F.max(F.col("n") > MANY).alias("_many"),
        F.max((F.col("n") > 5) & (F.col("tiny") / F.col("n") > MOSTLY)).alias("_mostly"), F.max((F.col("n") > 3) & (F.col("most") > UNEVEN * F.col("mean"))).alias("_uneven"),
    )
    reasons = F.array(F.when(F.col("_many"), "too_many_chapters"), F.when(F.col("_mostly"), "too_many_tiny_chapters"), F.when(F.col("_uneven"), "very_uneven_distribution"))
    return book.select("book_id", "total_chapters", F.round(F.col("_tiny") / F.col("total_chapters"), 6).alias("tiny_ratio"), F.array_join(F.filter(reasons, lambda x: x.isNotNull()), ",").alias("reasons"))


# contents lists

CONTENTS = r"(?iu)^\s*(?:оглавление|содержание|contents|table of contents)\s*$"
#: A line longer than this is no entry: the list ends before it.
BODY = 200
#: The four kinds of entries, tried in order.
ENTRIES = (
    ("chapter", r"^\s*[Гг][Лл][Аа][Вв][Аа]\s+[0-9]+\.\s*(.+)$"),
    ("numbered", r"^\s*[0-9]+(?:\.[0-9]+)*\.\s+(.+)$"),
    ("word", r"^\s*((?:[Гг][Лл][Аа][Вв][Аа]|[Чч][Аа][Сс][Тт][Ьь])\s+[А-Яа-яЁё]+).*$"),
    ("section", r"^\s*((?:ВВЕДЕНИЕ|ЗАКЛЮЧЕНИЕ|ПОСЛЕСЛОВИЕ|ПРЕДИСЛОВИЕ|БИБЛИОГРАФИЯ|ЛИТЕРАТУРА|ПРИЛОЖЕНИ[ЕЯ]|[Вв]ведение|[Зз]аключение|[Пп]ослесловие|[Пп]редисловие|[Бб]иблиография|[Лл]итература|[Пп]риложени[ея]))\s*$"),
)


def contents_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos): the lines of the contents list of each document that has one, up to the first long line after it."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    marks = lines.filter(F.col("line").rlike(CONTENTS)).groupBy("doc_id").agg(F.min("pos").alias("start_pos"))
    ends = lines.join(marks, "doc_id").groupBy("doc_id", "start_pos").agg(F.min(F.when((F.col("pos") > F.col("start_pos")) & (F.length(F.trim("line")) > BODY), F.col("pos"))).alias("_long"), (F.max("pos") + 1).alias("_all"))
    return ends.select("doc_id", "start_pos", F.coalesce("_long", "_all").alias("end_pos"))


def entries(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, entry, title, page, level) of lines (doc_id, pos, line) of contents lists.

    The level of a numbered entry is the number of stops inside its number; one of level 0 counts as 1 once another title of
    level 0 stands before it.
    """
    bare = lines.withColumn("_b", F.trim("line")).filter(F.length("_b") >= 3).withColumn("_c", F.trim(F.regexp_replace("_b", r"\s*[.…·–—-]{3,}\s*[0-9]*\s*$", ""))).filter(F.length("_c") >= 3)
    kind = F.coalesce(*[F.when(F.col("_c").rlike(p), F.lit(k)) for k, p in ENTRIES])
    title = F.coalesce(*[F.when(F.col("entry") == k, F.regexp_extract("_c", p, 1)) for k, p in ENTRIES])
    rows = bare.withColumn("entry", kind).filter("entry IS NOT NULL").withColumn("title", F.trim(F.regexp_replace(title, r"\s*[.…]+\s*$", "")))
    rows = rows.filter("title <> '' AND (entry <> 'numbered' OR length(title) > 3)")
    number = F.regexp_extract("_c", r"^\s*([0-9]+(?:\.[0-9]+)*)\.\s", 1)
    rows = rows.withColumns({"page": F.nullif(F.regexp_extract("_b", r"\s+([0-9]+)\s*$", 1), F.lit("")), "_level": F.when(F.col("entry") == "numbered", F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))).otherwise(0)})
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    top = F.when(F.col("_level") == 0, F.col("title"))
    fixed = F.when((F.col("_level") == 0) & (F.col("entry") != "numbered"), F.col("title"))
    first = F.first(top, ignorenulls=True).over(w)
    other = F.coalesce(first != F.col("title"), F.lit(False)) | F.coalesce((F.min(fixed).over(w) != F.col("title")) | (F.max(fixed).over(w) != F.col("title")), F.lit(False))
    level = F.when((F.col("entry") == "numbered") & (F.col("_level") == 0) & other, 1).otherwise(F.col("_level"))
    return rows.select("doc_id", "pos", "entry", "title", "page", level.cast("int").alias("level"))


def work_titles(docs: DataFrame) -> DataFrame:
    """(doc_id, number, title): works that a contents list names in three lines, "Книга N", title and page."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = lines.withColumns({"_title": F.lead("line", 1).over(w), "_page": F.lead("line", 2).over(w)}).filter(F.col("line").rlike(r"(?iu)^книга\s+[0-9]{1,2}$"))
    rows = rows.filter(F.col("_title").rlike(r"^[А-Яа-яЁё][А-Яа-яЁё\s-]{2,80}$") & F.col("_page").rlike("^[0-9]{1,4}$"))
    return rows.select("doc_id", F.regexp_extract("line", r"([0-9]+)$", 1).cast("int").alias("number"), F.regexp_replace("_title", r"\s+", " ").alias("title"))


def entries_in_body(docs: DataFrame, found: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, pos, title): the first line after the contents list that holds each of its titles of more than five characters."""
    titles = found.filter("length(title) > 5").groupBy("doc_id", "title").agg(F.min("pos").alias("_at"))
    body = docs.join(ranges, "doc_id").select("doc_id", "end_pos", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter((F.col("pos") >= F.col("end_pos")) & ~F.col("line").rlike(r"\.{3,}"))
    # the titles of a document only meet that document's own short lines
    short = body.filter(F.length("line") <= BODY).withColumn("line", F.lower("line"))
    hits = short.join(titles, "doc_id").filter(F.col("line").contains(F.lower("title")))
    return hits.groupBy("doc_id", "pos").agg(F.min_by("title", "_at").alias("title"))


def overlapping(paragraphs: DataFrame, order: list[str], ranges: DataFrame) -> DataFrame:
    """Paragraphs (book_id, *order, text) that overlap a range of code points (book_id, start, end) of the whole text, whose paragraphs
    are two characters apart."""
    placed = running_sums(paragraphs, "book_id", order, {"_stop": F.length("text") + 2}).withColumns({"stop_char": F.col("_stop") - 2, "start_char": F.col("_stop") - 2 - F.length("text")}).drop("_stop")
    return placed.join(ranges, "book_id").filter("start_char < end AND stop_char > start")


# special paragraphs

ANNOTATION = r"(?iu)^\s*(?:аннотация|annotation)\s*[.:]?\s*$"
_CHAPTER_LIKE = r"(?iu)^\s*(?:глава\s+(?:[0-9]+|[ivxlcdm|]+|[а-яё-]+)|chapter\s+\S+|пролог|эпилог)(?:$|[^\p{L}\p{N}_])"
FOLLOWERS = 3


def special_paragraphs(paragraphs: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``paragraphs`` with ``section``: epigraph, annotation or null.

    An epigraph is one of a chapter's first three paragraphs, short, before a heading, and names its source or breaks its
    lines. A mark of an annotation takes up to three following paragraphs of five to 120 words with it.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t]+", " "))
    rows = paragraphs.withColumn("_t", text)
    words = F.size(F.regexp_extract_all("_t", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    chapter = F.col("_t").rlike(_CHAPTER_LIKE)
    mark = F.col("_t").rlike(ANNOTATION)
    source = F.col("_t").rlike(r"(?iu)(?:^|\s)(?:из|from)\s+[^.!?]{3,80}$") | F.col("text").contains("\n")
    epigraph = (F.row_number().over(w) <= 3) & words.between(4, 28) & (F.length("_t") <= 220) & ~chapter & ~mark & F.coalesce(F.lead(chapter).over(w), F.lit(False)) & source
    fits = words.between(5, 120) & ~chapter & ~mark
    rows = rows.withColumns({"_mark": mark, "_fits": fits, "_epi": epigraph})
    follows = F.lit(False)
    held = F.lit(True)
    for back in range(1, FOLLOWERS + 1):
        follows = follows | (held & F.coalesce(F.lag("_mark", back).over(w), F.lit(False)))
        held = held & F.coalesce(F.lag("_fits", back).over(w), F.lit(False))
    return rows.withColumn("section", F.when(F.col("_epi"), "epigraph").when(F.col("_mark") | (F.col("_fits") & follows), "annotation")).drop("_t", "_mark", "_fits", "_epi")


def mark_segments(segments: DataFrame, special: DataFrame, group: list[str]) -> DataFrame:
    """Segments (*group, segment, text) that lie in a special paragraph (*group, section, text) of their chapter, or the other way round, get its section."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    s = segments.withColumn("_s", plain("text")).filter("_s <> ''")
    p = special.filter("section IS NOT NULL").select(*group, "section", plain("text").alias("_p")).filter("_p <> ''").distinct()
    long = (F.length("_s") >= 24) & (F.length("_p") >= 24)
    overlap = F.col("_p").contains(F.col("_s")) | F.col("_s").contains(F.col("_p")) | long & (F.col("_p").contains(F.substring("_s", 1, 80)) | F.col("_s").contains(F.substring("_p", 1, 80)))
    return s.join(p, group).filter(overlap).groupBy(*group, "segment").agg(F.min("section").alias("section"))


#: A work without chapters is looked through for sections from this size on; a book is one of late works after so many chapters.
LARGE_CHARS, LARGE_PARAGRAPHS, SECTIONS, LATE_AFTER, LATE_CHARS = 30_000, 4, 2, 8, 90
SECTION_TITLE = r"^[А-ЯЁ][А-Яа-яЁё0-9\s'%-]{2,70}$"


def internal_sections(divided: DataFrame, order: list[str]) -> DataFrame:
    """(book_id, work, *order, title): short title-like paragraphs of large works that have no chapters, if a work has two or more.

    ``divided``: the paragraphs of ``chapters``. Sizes are aggregated first, so only paragraphs of works that qualify are looked at.
    """
    size = divided.groupBy("book_id", "work").agg(F.sum(F.length("text")).alias("_chars"), F.count(F.lit(1)).alias("_n"), (F.max("chapter") - F.min("chapter")).alias("_chapters"))
    large = size.filter((F.col("_chars") >= LARGE_CHARS) & (F.col("_n") >= LARGE_PARAGRAPHS) & (F.col("_chapters") == 0)).select("book_id", "work")
    line = F.trim(F.regexp_replace("text", r"\s+", " "))
    titles = divided.withColumn("title", line).filter(F.col("title").rlike(SECTION_TITLE) & ~F.lower("title").isin("содержание", "оглавление")).join(large, ["book_id", "work"], "left_semi")
    several = titles.groupBy("book_id", "work").agg(F.countDistinct(F.lower("title")).alias("_t")).filter(F.col("_t") >= SECTIONS).select("book_id", "work")
    return titles.join(several, ["book_id", "work"], "left_semi").select("book_id", "work", *order, "title")


def late_works(hits: DataFrame, order: list[str]) -> DataFrame:
    """(book_id, *order, line): numbered headings that begin works, in books that have two works and then eight chapters or more.

    Once one is found every later numbered heading is one, too. A fold over a book's headings, which are few beside its paragraphs.
    ``hits``: the rows of ``heading_hits``.
    """
    item = F.struct(*order, F.col("line"), F.col("is_work"), (F.col("kind") == "numeric_heading").alias("num"))
    books = hits.groupBy("book_id").agg(F.array_sort(F.collect_list(item)).alias("_h"), F.count_if("is_work").alias("_works")).filter("_works >= 2")
    last = F.expr("array_max(transform(filter(_h, x -> x.is_work), x -> struct(" + ", ".join(f"x.{o}" for o in order) + ")))")
    books = books.withColumn("_last", last).withColumn("_after", F.filter("_h", lambda x: F.struct(*[x[o].alias(o) for o in order]) > F.col("_last")))
    kind = "array<struct<" + ",".join(f"{o}:{hits.schema[o].dataType.simpleString()}" for o in order) + ",line:string>>"
    # chapters since the last work are counted twice before the first late work, as they are known to lie after it when the fold begins
    start = F.struct(F.array().cast(kind).alias("done"), F.size(F.filter("_after", lambda x: ~x["num"])).alias("since"), F.lit(False).alias("late"))

    def step(a: Column, x: Column) -> Column:
        begins = x["num"] & (F.length(x["line"]) <= LATE_CHARS) & ((a["since"] >= LATE_AFTER) | a["late"])
        found = F.struct(F.concat(a["done"], F.array(F.struct(*[x[o].alias(o) for o in order], x["line"].alias("line")))).alias("done"), F.lit(0).alias("since"), F.lit(True).alias("late"))
        return F.when(begins, found).otherwise(F.struct(a["done"].alias("done"), F.when(~x["num"] & ~a["late"], a["since"] + 1).otherwise(a["since"]).alias("since"), a["late"].alias("late")))

    return books.select("book_id", F.inline(F.aggregate("_after", start, step, lambda a: a["done"])))


def _title_words(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(c), "ё", "е"), r"[^а-яе0-9\s-]+", " "), r"\s+", " "))


def title_pages(docs: DataFrame, titles: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, number, title, pos): the line where each work named in a contents list (doc_id, number, title) begins, in documents with two
    works or more. Each takes the first fitting short line after the one before it and after the list (doc_id, end_pos).

    A line fits if it is the title, holds it or is held by it, or has no word that the title lacks.
    """
    several = titles.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("number", "title"))).alias("_titles")).filter(F.size("_titles") >= 2)
    lines = docs.join(several.select("doc_id"), "doc_id", "left_semi").join(after, "doc_id", "left").select("doc_id", F.coalesce("end_pos", F.lit(0)).alias("end_pos"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    short = lines.filter((F.col("pos") >= F.col("end_pos")) & (F.length("line") <= 80) & F.col("line").rlike(r"^\s*(?:[0-9]{1,2}\.\s+)?[А-ЯЁ][А-Яа-яЁё0-9\s'.-]*$")).withColumn("_n", _title_words("line"))
    pages = short.filter("_n <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("_n").alias("n")))).alias("_lines"))
    start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<number:int,title:string,pos:int>>").alias("done"))

    def step(a: Column, t: Column) -> Column:
        want = _title_words(t["title"])
        words = F.filter(F.split(want, " "), lambda w: F.length(w) >= 2)

        def fits(x: Column) -> Column:
            own = F.filter(F.split(x["n"], " "), lambda w: F.length(w) >= 2)
            near = (F.length(want) >= 6) & (F.length(x["n"]) >= 8) & (want.contains(x["n"]) | x["n"].contains(want) | (F.size(own) > 0) & (F.size(F.array_except(own, words)) == 0))
            return (x["pos"] > a["at"]) & ((x["n"] == want) | near)

        hit = F.array_min(F.transform(F.filter("_lines", fits), lambda x: x["pos"]))
        found = F.struct(hit.alias("at"), F.concat(a["done"], F.array(F.struct(t["number"].alias("number"), t["title"].alias("title"), hit.alias("pos")))).alias("done"))
        return F.when(hit.isNull(), a).otherwise(found)

    return several.join(pages, "doc_id").select("doc_id", F.inline(F.aggregate("_titles", start, step, lambda a: a["done"])))
