"""Paragraphs of books: words put right by what the rest of the book says, and words that go on in the next paragraph.

What a book knows is small beside its texts: names and dictionary entries are aggregated first, and a text
only meets the entries of its own words (a join on the word, not a scan of a list per text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.normalize import Stage, normalized

_WORD = "[А-Яа-яЁё-]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({_WORD})"), F.lit(1))


def words_to_replace(df: DataFrame, group: list[str], keys: list[str], text: str, mapping: DataFrame) -> DataFrame:
    """``(*keys, word, new)``: the distinct words of each text, in small letters, that ``mapping`` (*group, key, new) has an entry for."""
    words = df.select(*keys, *group, F.explode(F.array_distinct(F.transform(_words(F.col(text)), F.lower))).alias("word"))
    return words.join(mapping.withColumnRenamed("key", "word"), [*group, "word"]).select(*keys, "word", "new")


def _like(word: Column, new: Column) -> Column:
    """``new`` with the capitals of ``word``."""
    first = F.substring(word, 1, 1)
    return F.when((F.length(word) > 1) & (word == F.upper(word)), F.upper(new)).when(first == F.upper(first), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, 2, 1 << 20))).otherwise(new)


def replace_words(df: DataFrame, group: list[str], keys: list[str], text: str, mapping: DataFrame, keep_case: bool = False) -> DataFrame:
    """``df`` with the whole words of ``text`` replaced that ``mapping`` (*group, key, new) has. ``keys`` name a row.

    Null texts and texts without such a word stay as they are. ``keep_case`` gives the new word the capitals of the old one.
    """
    found = words_to_replace(df, group, keys, text, mapping).groupBy(*keys).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("word", "new")))).alias("_map"))
    words, gaps = _words(F.col(text)), F.split(text, _WORD)
    new = F.transform(words, lambda w: F.coalesce(_like(w, F.col("_map")[F.lower(w)]) if keep_case else F.col("_map")[F.lower(w)], w))
    whole = F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), new.alias("w")), lambda x: F.concat(F.coalesce(x["g"], F.lit("")), F.coalesce(x["w"], F.lit("")))), "")
    return df.join(found, keys, "left").withColumn(text, F.when(F.col("_map").isNull(), F.col(text)).otherwise(whole)).drop("_map")


def names_of(df: DataFrame, group: list[str], text: str) -> DataFrame:
    """``(*group, name)``: words of five letters and more that stand with a capital inside a phrase."""
    words = F.regexp_extract_all(text, F.lit(r"[а-яё,;»—-]\s([А-ЯЁ][а-яё]{4,})"), F.lit(1))
    return df.select(*group, F.explode(words).alias("name")).distinct()


def dropped_initials(names: DataFrame, group: list[str]) -> DataFrame:
    """``(*group, key, new)``: names by what is left of them without their first letter; of several names the smallest."""
    return names.select(*group, F.lower(F.substring("name", 2, 1 << 20)).alias("key"), "name").filter("length(key) >= 4").groupBy(*group, "key").agg(F.min("name").alias("new"))


def undoubled(names: DataFrame, group: list[str]) -> DataFrame:
    """``(*group, key, new)``: names with a doubled consonant by their spelling with a single one."""
    single = F.regexp_replace("name", r"(?iu)([бвгджзклмнпрстфхцчшщ])\1", "$1")
    return names.filter(single != F.col("name")).select(*group, F.lower(single).alias("key"), "name").filter("length(key) >= 4").groupBy(*group, "key").agg(F.min("name").alias("new"))


def yo_dictionary(texts: DataFrame, least: int = 3, ratio: int = 20) -> DataFrame:
    """``(key, new)``: words written with ё that are hardly ever written with е, from a DataFrame of one text column.

    A word counts if it is met ``least`` times with ё and ``ratio`` times as often as without; "все" never does.
    """
    (text,) = texts.columns
    words = texts.select(F.explode(F.regexp_extract_all(text, F.lit("([А-Яа-яЁё]+)"), F.lit(1))).alias("word")).groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    with_yo = words.filter(F.col("word").contains("ё")).withColumn("key", F.translate("word", "ё", "е")).filter("key <> 'все'")
    best = with_yo.groupBy("key").agg(F.max_by("word", F.struct("n", "word")).alias("new"), F.sum("n").alias("_yo"))
    plain = words.select(F.col("word").alias("key"), F.col("n").alias("_e"))
    return best.join(plain, "key", "left").filter((F.col("_yo") >= least) & (F.coalesce("_e", F.lit(0)) * ratio <= F.col("_yo"))).select("key", "new")


def yoficate(df: DataFrame, keys: list[str], text: str, dictionary: DataFrame) -> DataFrame:
    """``df`` with ё restored in the words that the dictionary (key, new) knows."""
    return replace_words(df, [], keys, text, dictionary, keep_case=True)


def hyphen_joins(df: DataFrame, group: list[str], order: list[str], text: str = "text") -> DataFrame:
    """The paragraphs of ``df`` that are not blank, with ``next_text`` and ``joins``: whether the last word goes on in the next one.

    A paragraph whose beginning was taken cannot itself be joined with the one after it, so of neighbours that all fit every
    other one joins. One window per chapter.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    rows = df.filter(~F.coalesce(F.col(text), F.lit("")).rlike(r"^\s*$"))
    rows = rows.withColumns({"next_text": F.lead(text).over(w), "_pos": F.row_number().over(w)})
    rows = rows.withColumn("_fits", F.col(text).rlike(r"[а-яёА-ЯЁ][-(]\s*$") & F.coalesce(F.col("next_text").rlike(r"^\s*[а-яёА-ЯЁ]"), F.lit(False)))
    rows = rows.withColumn("_run", F.col("_pos") - F.row_number().over(Window.partitionBy(*group, "_fits").orderBy(*order)))
    place = F.row_number().over(Window.partitionBy(*group, "_fits", "_run").orderBy(*order))
    return rows.withColumn("joins", F.col("_fits") & (place % 2 == 1)).drop("_pos", "_fits", "_run")


def join_hyphens(df: DataFrame, group: list[str], order: list[str], keys: list[str], text: str = "text") -> DataFrame:
    """``df`` with cut words joined: a paragraph that ends in a hyphen takes the whole next one, which becomes empty."""
    j = hyphen_joins(df, group, order, text)
    w = Window.partitionBy(*group).orderBy(*order)
    rest = F.regexp_replace(F.regexp_replace("next_text", r"^\s+", ""), r"^([а-яёА-ЯЁ]+)\s+", "$1 ")
    new = F.when(F.col("joins"), F.concat(F.regexp_replace(text, r"[-(]\s*$", ""), rest)).when(F.coalesce(F.lag("joins").over(w), F.lit(False)), F.lit(""))
    changed = j.withColumn("_new", new).filter("_new IS NOT NULL").select(*keys, "_new")
    return df.join(changed, keys, "left").withColumn(text, F.coalesce("_new", text)).drop("_new")


def normalize_books(df: DataFrame, order: list[str], stages: list[tuple[str, Stage]], keys: list[str] | None = None) -> DataFrame:
    """(book_id, chapter_index, ..., text) normalised: all stages, names put right from the book, words joined across paragraphs."""
    keys = keys or ["row_id"]
    names = names_of(df, ["book_id"], "text")
    mapping = dropped_initials(names, ["book_id"]).unionByName(undoubled(names, ["book_id"])).groupBy("book_id", "key").agg(F.min("new").alias("new"))
    clean = replace_words(normalized(df, "text", stages), ["book_id"], keys, "text", mapping)
    return join_hyphens(clean, ["book_id", "chapter_index"], order, keys)


def quality_warnings(df: DataFrame) -> DataFrame:
    """``(book_id, cyrillic_ratio, doubtful)``: the share of Cyrillic letters of each book, and whether it is hardly Russian text."""
    letters = df.groupBy("book_id").agg(F.sum(F.regexp_count("text", F.lit(r"[\x{0400}-\x{04FF}]"))).alias("c"), F.sum(F.regexp_count("text", F.lit(r"\p{L}"))).alias("l"))
    return letters.select("book_id", F.coalesce(F.col("c") / F.nullif(F.col("l"), F.lit(0)), F.lit(0.0)).alias("cyrillic_ratio")).withColumn("doubtful", F.col("cyrillic_ratio") < 0.3)
