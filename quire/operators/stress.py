"""Stress marks of Russian words: tokens, resolution against dictionaries, and how a stressed text is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACUTE = "́"
VOWELS = "аеёиоуыэюяАЕЁИОУЫЭЮЯ"
_TOKEN = "([А-Яа-яЁё́]+|[^А-Яа-яЁё́]+)"


def tokens(c: Column) -> Column:
    """Runs of Cyrillic letters and runs of anything else, in turn; joined they are the text."""
    return F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(1))


def vowels(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[{VOWELS}]"))


def without_stress(c: Column) -> Column:
    return F.replace(c, F.lit(ACUTE), F.lit(""))


def stressed(word: Column, n: Column) -> Column:
    """The word with a mark after its n-th vowel (from 1); as it is if it has fewer."""
    letters = F.split(word, "")
    seen = lambda i: F.size(F.filter(F.slice(letters, 1, i + 1), lambda x: x.rlike(f"[{VOWELS}]")))
    marked = F.array_join(F.transform(letters, lambda x, i: F.when(x.rlike(f"[{VOWELS}]") & (seen(i) == n), F.concat(x, F.lit(ACUTE))).otherwise(x)), "")
    return F.when((n >= 1) & (n <= vowels(word)), marked).otherwise(word)


def rendered(c: Column, mode: str = "plain") -> Column:
    """Stress marks left out (plain), kept (keep_acute), or told by a doubled vowel (double_vowel)."""
    if mode == "keep_acute":
        return c
    if mode == "double_vowel":
        c = F.regexp_replace(c, f"([{VOWELS}]){ACUTE}", "$1$1")
    elif mode != "plain":
        raise ValueError(f"unknown mode {mode}")
    return without_stress(c)


def words_of(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``(*keys, pos, token, word)`` of the Cyrillic tokens; ``word`` is in small letters without marks."""
    rows = df.select(*keys, F.posexplode(tokens(F.col(text))).alias("pos", "token")).filter(F.col("token").rlike("[А-Яа-яЁё]"))
    return rows.withColumn("word", F.lower(without_stress(F.col("token"))))


def resolve(words: DataFrame, user: DataFrame, builtin: DataFrame) -> DataFrame:
    """``words`` with ``form`` and ``origin``: words of one vowel are themselves, then the user's dictionary (word, form), then the other one,
    else unknown. Several forms of a word: the smallest."""
    one = lambda d, name: d.groupBy(F.lower("word").alias("word")).agg(F.min("form").alias(name))
    rows = words.join(one(user, "_u"), "word", "left").join(one(builtin, "_b"), "word", "left")
    single = vowels(F.col("word")) <= 1
    form = F.when(single, F.col("token")).otherwise(F.coalesce("_u", "_b"))
    return rows.withColumns({"form": form, "origin": F.when(single, "single").when(F.col("_u").isNotNull(), "user").when(F.col("_b").isNotNull(), "builtin").otherwise("unknown")}).drop("_u", "_b")


def statistics(resolved: DataFrame, by: list[str]) -> DataFrame:
    """Known, unknown and single-vowel words, and distinct unknown ones."""
    return resolved.groupBy(*by).agg(F.count_if(F.col("origin").isin("user", "builtin")).alias("known"), F.count_if(F.col("origin") == "unknown").alias("unknown"), F.count_if(F.col("origin") == "single").alias("single"), F.countDistinct(F.when(F.col("origin") == "unknown", F.col("word"))).alias("different_unknown"))


def transferred(token: Column, form: Column) -> Column:
    """The stress of ``form`` put on a token that is the same word but for capitals, ё and marks; else the token."""
    same = lambda c: F.translate(F.lower(without_stress(c)), "ё", "е")
    place = F.instr(form, ACUTE) - 1
    plain = without_stress(token)
    marked = F.concat(F.substring(plain, F.lit(1), place), F.lit(ACUTE), F.substring(plain, place + 1, F.length(plain)))
    return F.when((same(token) == same(form)) & (place > 0), marked).otherwise(token)
