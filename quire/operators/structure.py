"""Chapters and works: headings, noise among them, splitting, contents lists, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ordinal words of Russian headings.
_STEMS = "перв(?:ая|ый|ое)|втор(?:ая|ой|ое)|треть(?:я|ий|е)|четверт(?:ая|ый|ое)|пят(?:ая|ый|ое)|шест(?:ая|ой|ое)|седьм(?:ая|ой|ое)|восьм(?:ая|ой|ое)|девят(?:ая|ый|ое)"
_TEENS = "десят|одиннадцат|двенадцат|тринадцат|четырнадцат|пятнадцат|шестнадцат|семнадцат|восемнадцат|девятнадцат|двадцат"
_ORDINAL_20 = f"(?:{_STEMS}|(?:{_TEENS})(?:ая|ый|ое))"
_ORDINAL = f"(?:{_STEMS}|(?:{_TEENS}|тридцат|сороков)(?:ая|ый|ое)|(?:двадцать|тридцать|сорок)\\s+(?:{_STEMS}))"
_ENGLISH = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty"
#: What follows a number word: its end (no letter or digit goes on) or a mark.
_END = r"(?:$|[^\p{L}\p{N}_])"

#: Chapter headings, tried in order; the first that fits names the kind.
CHAPTER_PATTERNS = (
    ("chapter_numeric", r"^\s*[Гг][Лл][Аа][Вв][Аа]\s+[0-9]+"),
    ("chapter_word", rf"(?i)^\s*[Гг][Лл][Аа][Вв][Аа]\s+{_ORDINAL}{_END}"),
    ("chapter_roman", r"^\s*[Гг][Лл][Аа][Вв][Аа]\s+[IVXLCDMl|]+\s*$"),
    ("part", r"^\s*[Чч][Аа][Сс][Тт][Ьь]\s+[IVXLCDM0-9]+"),
    ("numeric_heading", r"^\s*[0-9]+(?:\.[0-9]+)*\.?\s+[А-ЯЁA-Z][А-Яа-яЁёA-Za-z\s]{10,}$"),
    ("intro_conclusion", r"^\s*(?:[Вв]ведение|[Зз]аключение|[Пп]ослесловие|[Пп]редисловие)\s*$"),
    ("prologue_epilogue", r"^\s*(?:[Пп][Рр][Оо][Лл][Оо][Гг]|[Ээ][Пп][Ии][Лл][Оо][Гг])\s*$"),
    ("roman_numeral", r"^\s*(?:I{2,3}|IV|VI{0,3}|IX|XI{0,3}|XI?V|XX?)\s*$"),
    ("chapter_en", rf"(?i)^\s*chapter\s+(?:[0-9]+|[ivxlcdm]+|{_ENGLISH}){_END}"),
    ("intro_conclusion_en", r"(?i)^\s*(?:prologue|epilogue|introduction|foreword|afterword)\s*$"),
    ("chapter_kk", rf"^\s*(?:Тарау|тарау|Бөлім|бөлім)\s+(?:[0-9]+|[IVXLCDMivxlcdm]+|[\x{{0400}}-\x{{04FF}}]+){_END}"),
    ("chapter_uz", rf"(?i)^\s*(?:bob|bo['`ʼ]?lim)\s+(?:[0-9]+|[ivxlcdm]+|[a-zʼ'`-]+){_END}"),
    ("chapter_zh", r"^\s*第[0-9一-鿿]{1,8}[章回节]\s*.*$"),
    ("intro_conclusion_zh", r"^\s*(?:序章|前言|后记|结语)\s*$"),
)
#: Headings of whole works, of at most ``WORK_CHARS`` characters.
WORK_PATTERNS = (
    ("work_cyrillic", rf"^\s*(?:Книга|книга|Кітап|кітап|Том|том)\s+(?:[0-9]+|[IVXLCDMivxlcdm]+|{_ORDINAL_20})(?:$|[^\p{{L}}\p{{N}}_].{{0,90}}$)"),
    ("work_en", rf"(?i)^\s*(?:book|volume|vol\.)\s+(?:[0-9]+|[ivxlcdm]+|{_ENGLISH})(?:$|[^\p{{L}}\p{{N}}_].{{0,90}}$)"),
    ("work_uz", r"(?i)^\s*(?:kitob|tom)\s+(?:[0-9]+|[ivxlcdm]+|[a-zʼ'`-]+)(?:$|[^\p{L}\p{N}_].{0,90}$)"),
    ("work_zh", r"^\s*第[0-9一-鿿]{1,8}[部卷册]\s*.*$"),
)
WORK_CHARS = 140
#: A line without any of these opens no heading: one search in front of the patterns.
HEADING_HINT = r"(?iu)^\s*(?:глава|част|[0-9]|введение|заключение|послесловие|предисловие|пролог|эпилог|[ivx]+\s*$|chapter|prologue|epilogue|introduction|foreword|afterword|тарау|бөлім|bob|bo['`ʼ]?lim|第|序章|前言|后记|结语|книга|кітап|том|book|vol|kitob|tom)"


def _first_kind(line: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    java = lambda p: p.replace("(?i)", "(?iu)")
    return F.when(line.rlike(HEADING_HINT), F.coalesce(*[F.when(line.rlike(java(p)), F.lit(kind)) for kind, p in patterns]))


def kind_sql(line: str, patterns: tuple[tuple[str, str], ...]) -> str:
    """The same as an SQL expression."""
    return "CASE " + " ".join(f"WHEN regexp_matches({line}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{kind}'" for kind, p in patterns) + " END"


def work_kind(line: Column) -> Column:
    """The kind of heading of a whole work that a line is; null if none."""
    return F.when(F.length(F.trim(line)) <= WORK_CHARS, _first_kind(line, WORK_PATTERNS))


def is_heading(line: Column) -> Column:
    """Whether a line is a heading of a chapter or a work."""
    return F.when(line.rlike(HEADING_HINT), _first_kind(line, (*CHAPTER_PATTERNS, *WORK_PATTERNS)).isNotNull()).otherwise(False)


def chapter_kind(line: Column) -> Column:
    """The kind of chapter heading a line is; null if none."""
    return _first_kind(line, CHAPTER_PATTERNS)


def numbered(hits: DataFrame) -> DataFrame:
    """Headings with ``number``, the first one in digits that they have (0 without)."""
    return hits.withColumn("number", F.coalesce(F.nullif(F.regexp_extract("line", r"([0-9]{1,6})", 1), F.lit("")).cast("int"), F.lit(0)))


def without_numeric_noise(hits: DataFrame, order: list[str]) -> DataFrame:
    """Drop a book's numeric headings if there are three or more and over a quarter of them fall behind the highest number so far."""
    w = Window.partitionBy("book_id").orderBy(*order)  # over the numeric headings alone
    numeric = hits.filter("kind = 'numeric_heading'").withColumn("_back", (F.col("number") < F.max("number").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"))
    noisy = numeric.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("_back", F.lit(0))).alias("share")).filter("n >= 3 AND share > 0.25").select("book_id", F.lit(True).alias("_noisy"))
    return hits.join(noisy, "book_id", "left").filter("_noisy IS NULL OR kind <> 'numeric_heading'").drop("_noisy")


def page_class(text_chars: Column, tables: Column, image_ratio: Column, image_texts: Column) -> Column:
    """The kind of a page from its text layer, tables and images."""
    layer = (text_chars >= 40) | (tables > 0)
    full = image_ratio >= 0.65
    return F.when(layer & full, "scanned_with_ocr").when(~layer & ((image_texts > 0) | full), "scanned").when(layer & (image_texts > 0), "hybrid").when(layer, "programmatic").otherwise("unknown")
