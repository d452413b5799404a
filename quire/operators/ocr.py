"""What recognised text of scanned pages is worth: noise lines and paragraphs, usability, which variant to take; and its repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import language
from quire.operators import structure

CYRILLIC = r"[\x{0400}-\x{04FF}]"
#: Least characters of the script, share of readable words, and most symbols of usable text.
MIN_CHARS, MIN_SCRIPT, MIN_READABLE, MAX_SYMBOLS = 80, 0.3, 0.35, 0.06
#: A recognised text is taken over a native one if it has so many times as many readable characters.
MORE_COMPLETE = 1.5


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def symbol_ratio(c: Column) -> Column:
    """Share of characters that are neither letters, digits, white space nor usual marks."""
    return F.coalesce(_count(c, r"[^\p{L}\p{N}\p{M}\s.,;:!?…\"'«»„“”()—–-]") / F.nullif(F.length(c), F.lit(0)), F.lit(0.0))


def is_noise_line(line: Column) -> Column:
    """A line of marks or scan dirt: hardly a Cyrillic letter in a short line, or none among many marks."""
    x = F.regexp_replace(line, r"^\s+|\s+$", "")
    cyrillic, alnum, length = _count(x, CYRILLIC), _count(x, r"[\p{L}\p{N}]"), F.length(x)
    marks = length - alnum - _count(x, r"\s")
    return (length > 0) & ((cyrillic == 0) & (alnum <= 2) | (cyrillic < 2) & (length <= 12) | (cyrillic == 0) & (marks / F.greatest(length, F.lit(1)) > 0.35))


def is_noise_paragraph(text: Column) -> Column:
    """A paragraph with hardly a letter, or a short one that doesn't read as words; headings never are."""
    letters, readable = _count(text, CYRILLIC), language.readable_cyrillic(text)
    short = (F.length(text) < 90) & (readable < 0.25) | (F.length(text) < 140) & (symbol_ratio(text) > 0.08) & (readable < 0.45)
    return ~structure.is_heading(F.regexp_extract(text, r"^\s*([^\n]*)", 1)) & ((letters < 8) | short)


def is_short_title(text: Column) -> Column:
    """A sparse title page: few lines of a few words, most of them in capitals or with a capital."""
    x = F.regexp_replace(text, r"^\s+|\s+$", "")
    words = F.regexp_extract_all(x, F.lit("([А-Яа-яЁё]+)"), F.lit(1))
    upper = F.size(F.filter(words, lambda w: (F.length(w) >= 2) & (w == F.upper(w))))
    capital = F.size(F.filter(words, lambda w: F.substring(w, 1, 1) == F.upper(F.substring(w, 1, 1))))
    ok = (_count(x, CYRILLIC) >= 8) & (F.length(x) <= 220) & (language.cyrillic_ratio(x) >= 0.65) & (symbol_ratio(x) <= 0.18) & (F.size(words).between(1, 10)) & (F.size(F.filter(F.split(x, "\n"), lambda l: F.trim(l) != "")) <= 6)
    return ok & F.exists(words, lambda w: F.length(w) >= 4) & ~F.exists(words, lambda w: (F.length(w) <= 1) & (w != F.upper(w))) & ((upper >= 0.5 * F.size(words)) | (capital == F.size(words)))


def is_usable(text: Column, code: Column) -> Column:
    """Enough readable text of the language, with few symbols; or a short title."""
    body = (language.script_chars(text, code) >= MIN_CHARS) & (language.script_ratio(text, code) >= MIN_SCRIPT) & (language.readable_ratio(text, code) >= MIN_READABLE) & (symbol_ratio(text) <= MAX_SYMBOLS)
    return F.coalesce(body | is_short_title(text), F.lit(False))


def split_at_headings(text: Column) -> Column:
    """Array of paragraphs of a block: a line that is a heading opens one of its own, a heading in capitals inside a line is cut out."""
    spread = F.regexp_replace(text, r"(?<=[^\n])\s*((?:ГЛАВА|ЧАСТЬ)\s+(?:[IVXLCDM]+|[0-9]+))(?=\s|$)", "\n$1\n")
    lines = F.filter(F.transform(F.split(spread, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    end = lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"])))

    def step(a: Column, x: Column) -> Column:
        alone = F.struct(F.concat(end(a), F.array(x)).alias("done"), F.lit("").alias("cur"))
        return F.when(structure.is_heading(x), alone).otherwise(F.struct(a["done"].alias("done"), F.when(a["cur"] == "", x).otherwise(F.concat(a["cur"], F.lit("\n"), x)).alias("cur")))

    return F.aggregate(lines, start, step, end)


def clean_page(text: Column) -> Column:
    """A recognised page as paragraphs of readable text: cut words joined, dirt at the edges of lines and lines of noise out."""
    c = F.regexp_replace(F.regexp_replace(text, r"\r\n?|\f", "\n"), r"([а-яёА-ЯЁ])[-¬\x{00AD}]\n\s*([а-яё])", "$1$2")
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"^[\s|_~*=«»'`.,;:]{0,4}(?=[\p{L}\p{N}—–-])|^\s+|\s+$", ""))
    lines = F.transform(lines, lambda x: F.when(_count(x, CYRILLIC) >= 8, F.regexp_replace(x, r"\s+[—–-]?\s?[0-9]{1,4}\s?[—–-]?$", "")).otherwise(x))
    kept = F.filter(lines, lambda x: (x == "") | structure.is_heading(x) | ~is_noise_line(x))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


#: Words that lost the initial which was set as a picture.
DROP_CAPS = (("тром", "Утром"), ("рием", "Прием"), ("днажды", "Однажды"))


def drop_caps(text: Column, after_heading: Column) -> Column:
    """The lost initial of the first word of a paragraph that follows a heading."""
    out = text
    for short, full in DROP_CAPS:
        out = F.regexp_replace(out, rf"^\s*{short}(?=\s+[а-яё])", full)
    return F.when(after_heading, out).otherwise(text)


def choose_variant(variants: DataFrame, code: Column) -> DataFrame:
    """(book_id, first_page, page_count, native_usable, ocr_usable, chosen, reason): which text of a run of pages to take.

    ``variants``: (book_id, first_page, page_count, kind, text, extracted_at, row_id). Of each kind the last extraction counts. The native text
    is taken if it is usable and the other has not clearly more readable characters.
    """
    rows = variants.withColumns({"_u": is_usable(F.col("text"), code), "_n": F.coalesce(language.script_chars(F.col("text"), code), F.lit(0))})
    last = lambda kind: F.max_by(F.struct("_u", "_n"), F.when((F.col("kind") == kind) & F.col("text").isNotNull(), F.struct("extracted_at", "row_id")))
    v = rows.groupBy("book_id", "first_page", "page_count").agg(last("native").alias("a"), last("ocr").alias("b"))
    native, ocr = F.coalesce("a._u", F.lit(False)), F.coalesce("b._u", F.lit(False))
    more = F.coalesce(F.col("b._n") > MORE_COMPLETE * F.col("a._n"), F.lit(False))
    reason = F.when(native & ocr & more, "ocr_more_complete").when(native, "native_usable").when(ocr, "ocr_usable").otherwise("none_usable")
    chosen = F.when(native & ~(ocr & more), "native").when(ocr, "ocr").when(F.col("a").isNotNull(), "native").when(F.col("b").isNotNull(), "ocr")
    return v.select("book_id", "first_page", "page_count", native.alias("native_usable"), ocr.alias("ocr_usable"), chosen.alias("chosen"), reason.alias("reason"))


def rectangle_area(r: Column) -> Column:
    """Area of a struct (x0, y0, x1, y1); 0 if it is turned."""
    return F.greatest(r["x1"] - r["x0"], F.lit(0.0)) * F.greatest(r["y1"] - r["y0"], F.lit(0.0))


def intersection_area(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def inside(a: Column, b: Column, share: float = 0.5) -> Column:
    """Whether at least a share of ``a`` lies in ``b``."""
    return intersection_area(a, b) >= share * F.greatest(rectangle_area(a), F.lit(1e-9))


def reading_order(elements: DataFrame, page: list[str], tables: DataFrame | None = None) -> DataFrame:
    """Elements (*page, box, text) without those inside a table's box (*page, box), numbered top down and left to right."""
    from pyspark.sql import Window

    if tables is not None:
        t = tables.select(*page, F.col("box").alias("_tb"))
        hit = elements.join(t, page).filter(inside(F.col("box"), F.col("_tb"))).select(*page, "box", "text").distinct()
        elements = elements.join(hit, [*page, "box", "text"], "left_anti")
    w = Window.partitionBy(*page).orderBy(F.desc("box.y1"), F.col("box.x0"), "text")
    return elements.withColumn("place", F.row_number().over(w) - 1)
