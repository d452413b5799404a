"""Language codes and scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Supported languages and what their names are for other tools.
LANGUAGES = {"ru": ("Russian", "rus"), "en": ("English", "eng"), "zh": ("Chinese", "chi_sim"), "kk": ("Kazakh", "kaz"), "uz": ("Uzbek", "uzb")}
ALIASES = {"rus": "ru", "russian": "ru", "eng": "en", "english": "en", "chi": "zh", "chi-sim": "zh", "chinese": "zh", "kaz": "kk", "kazakh": "kk", "kz": "kk", "uzb": "uz", "uzbek": "uz"}
SCRIPTS = {"ru": r"[\x{0400}-\x{04FF}]", "kk": r"[\x{0400}-\x{04FF}]", "en": r"[A-Za-z\x{00C0}-\x{024F}]", "uz": r"[A-Za-z\x{00C0}-\x{024F}]", "zh": r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"}


def book_language(c: Column) -> Column:
    """The supported code that a label stands for; Russian if none."""
    raw = F.lower(F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("_"), F.lit("-")))
    base = F.element_at(F.split(raw, "-"), 1)
    pairs = [F.lit(x) for k, v in ({k: k for k in LANGUAGES} | ALIASES).items() for x in (k, v)]
    known = F.create_map(*pairs)
    return F.coalesce(F.element_at(known, raw), F.element_at(known, base), F.lit("ru"))


def script_chars(c: Column, language: Column) -> Column:
    """Characters of the language's script."""
    out = F.lit(None).cast("int")
    for code, pattern in SCRIPTS.items():
        out = F.when(language == code, F.regexp_count(c, F.lit(pattern))).otherwise(out)
    return out


def script_ratio(c: Column, language: Column) -> Column:
    """Share of the script among the letters of the first 10 000 characters; 0 without letters."""
    head = F.substring(c, 1, 10_000)
    letters = F.regexp_count(head, F.lit(r"\p{L}"))
    return F.coalesce(script_chars(head, language) / F.nullif(letters, F.lit(0)), F.lit(0.0))


def readable_ratio(c: Column, language: Column) -> Column:
    """Share of runs of the language's script that have three characters or more; 0 without a run."""
    out = F.lit(0.0)
    for code, pattern in SCRIPTS.items():
        runs = F.regexp_count(c, F.lit(pattern + "+"))
        out = F.when(language == code, F.coalesce(F.regexp_count(c, F.lit(pattern + "{3,}")) / F.nullif(runs, F.lit(0)), F.lit(0.0))).otherwise(out)
    return out


def unreadable(c: Column, language: Column) -> Column:
    """Whether a text hardly has letters of its language."""
    return script_ratio(c, language) < 0.3


def cyrillic_ratio(c: Column) -> Column:
    """Share of Cyrillic among all letters; 0 without letters."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[\x{0400}-\x{04FF}]")) / F.nullif(F.regexp_count(c, F.lit(r"\p{L}")), F.lit(0)), F.lit(0.0))


def readable_cyrillic(c: Column) -> Column:
    """Share of Cyrillic words of four letters or more among all Cyrillic words; 0 without one."""
    return F.coalesce(F.regexp_count(c, F.lit("[а-яёА-ЯЁ]{4,}")) / F.nullif(F.regexp_count(c, F.lit("[а-яёА-ЯЁ]+")), F.lit(0)), F.lit(0.0))
