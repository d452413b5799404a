"""Text normalisation stages as Column -> Column functions, folded into one projection.

Each stage is a built-in expression, so a pipeline stays inside whole-stage code generation. The order
of a pipeline matters; ``pipeline`` folds a list of named stages, ``tracked`` also tells which of them changed a text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import russian

Stage = Callable[[Column], Column]

#: Frequent sequences of doubly decoded text and what they stand for, in order of application.
MOJIBAKE = (("АЂ", "А"), ("Ãƒ", "А"), ("вЂ“", "—"), ("вЂ”", "—"), ("вЂœ", "«"), ("вЂў", "»"))
#: Phrases of library boilerplate.
BOILERPLATE = ("скачали книгу", "бесплатной электронной библиотеке", "все книги автора", "эта же книга в других форматах", "приятного чтения", "книга подготовлена", "литературного агентства", "royallib", "sesame")
_URL = r"(?i)\b(?:https?://|www\.)\S+"
#: A line without any of these is no boilerplate.
_HINT = "(?iu)https?://|www\\.|" + "|".join(BOILERPLATE) + "|спасибо,\\s+что\\s+скачали"


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` worked out once, however often ``use`` names it."""
    return F.transform(F.array(c), use)[0]


def encoding_artifacts(c: Column) -> Column:
    """Drop replacement characters, C0 controls (but tab and line ends) and byte-order marks."""
    return F.regexp_replace(c, r"[\x{FFFD}\x{FEFF}\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def common_mojibake(c: Column) -> Column:
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), MOJIBAKE, c)


def whitespace(c: Column) -> Column:
    """No-break spaces to spaces, characters without width away, runs collapsed, lines trimmed."""
    c = F.regexp_replace(F.translate(c, "\u00a0", " "), r"[\x{200B}-\x{200D}\x{FEFF}\f\x0B]", "")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(c, r"(?md) +$", ""), r"(?md)^ +", "")


def broken_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"([а-яё,])\n([а-яё])", "$1 $2")


def hyphenated_words(c: Column) -> Column:
    c = F.regexp_replace(c, "([\\p{L}\\p{N}_])­\n([\\p{L}\\p{N}_])", "$1$2")
    c = F.regexp_replace(c, r"([а-яёА-ЯЁ])\([ \t]*\r?\n(?:[ \t]*\r?\n)*[ \t]*([а-яёА-ЯЁ])", "$1$2")
    return F.regexp_replace(c, r"([а-яёА-ЯЁ])-\n([а-яё])", "$1$2")


def page_numbers(c: Column) -> Column:
    """Remove lines of one to four digits, with the white space around them."""
    return F.regexp_replace(c, r"(?md)^\s*\d{1,4}\s*$", "")


def quotes(c: Column) -> Column:
    c = F.regexp_replace(c, r'(?U)(?<!\w)"([^"]+)"(?!\w)', "«$1»")
    return F.translate(c, "“”„", "«»«")


def dashes(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"\s--\s", " — "), r"\s–\s", " — ")
    return F.replace(c, F.lit("--"), F.lit("—"))


def ellipsis(c: Column) -> Column:
    return F.regexp_replace(c, r"\.{3,}", "…")


def repeated_commas(c: Column) -> Column:
    return F.regexp_replace(c, ",{2,}", ",")


def punctuation_spacing(c: Column) -> Column:
    """No space before a mark, one after it if a letter follows, single spaces."""
    c = F.regexp_replace(c, r"\s+([,.:;!?])", "$1")
    c = F.regexp_replace(c, r"([,.:;!?])([а-яёА-ЯЁa-zA-Z])", "$1 $2")
    return F.regexp_replace(c, r" {2,}", " ")


def empty_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def indents(c: Column) -> Column:
    return F.regexp_replace(c, r"(?md)^[ \t]+", "")


def square_brackets(c: Column) -> Column:
    """Numeric note references out."""
    return F.regexp_replace(c, r"\[\d{1,2}\]", "")


def parenthesis_hyphens(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?<=[A-Za-z\x{0400}-\x{04FF}])\([ \t\r\n]+(?=[A-Za-z\x{0400}-\x{04FF}])", "")
    return F.regexp_replace(c, r"(?<=[0-9A-Za-z\x{0400}-\x{04FF}])\((?=[0-9A-Za-z\x{0400}-\x{04FF}])", "-")


def is_boilerplate(line: Column) -> Column:
    """An address with a phrase, two phrases, or mostly an address. Other lines cost one search."""
    low = F.lower(line)
    hits = reduce(lambda a, b: a + b, [low.contains(p).cast("int") for p in BOILERPLATE])
    plain = F.regexp_replace(F.trim(low), r"\s+", " ")
    url = F.length(plain) - F.length(F.regexp_replace(plain, _URL, ""))
    return F.when(low.rlike(_HINT), (url > 0) & (hits > 0) | (hits >= 2) | (url > 0.35 * F.length(plain))).otherwise(False)


def boilerplate(c: Column) -> Column:
    """Drop lines of library boilerplate, and a greeting that opens a line. Texts without a sign of it are only trimmed."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    greeting = r"(?iu)^(?:приятного\s+чтения|спасибо,\s+что\s+скачали\s+книгу)[.!…:;,\s]*"
    lines = F.filter(F.split(c, r"\r\n|[\n\r]"), lambda x: ~is_boilerplate(x))
    kept = F.filter(F.transform(lines, lambda x: F.struct((strip(x) == "").alias("blank"), strip(F.regexp_replace(strip(x), greeting, "")).alias("line"))), lambda x: x["blank"] | (x["line"] != "") & ~is_boilerplate(x["line"]))
    clean = strip(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    return F.when(c.rlike(_HINT), clean).otherwise(strip(F.array_join(F.transform(F.split(c, r"\r\n|[\n\r]"), strip), "\n")))


#: Named entities of markup.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&mdash;", "—"), ("&ndash;", "–"), ("&laquo;", "«"), ("&raquo;", "»"), ("&hellip;", "…"), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    """Named entities, and numeric ones below 65536, as characters."""
    parts = F.split(c, "(?=&#)|(?<=;)")
    number = lambda x: F.coalesce(F.conv(F.nullif(F.regexp_extract(x, "^&#[xX]([0-9a-fA-F]{1,4});$", 1), F.lit("")), 16, 10), F.nullif(F.regexp_extract(x, "^&#([0-9]{1,5});$", 1), F.lit(""))).cast("int")
    letter = lambda x: F.decode(F.unhex(F.lpad(F.hex(number(x)), 4, "0")), "UTF-16BE")
    numeric = F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^&#") & number(x).between(1, 0xD7FF), letter(x)).otherwise(x)), "")
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), ENTITIES, F.when(c.contains("&#"), numeric).otherwise(c))


def markup(c: Column) -> Column:
    """Strip speech markup, where there is some."""
    out = F.regexp_replace(unescape(c), r"(?i)<break\b[^>]*/?>|</?s\b[^>]*>|</?(?:speak|p)\b[^>]*>", "\n")
    return F.when(c.rlike(r"(?i)</?(?:speak|s)\b"), F.regexp_replace(out, r"<[^>\n]{1,200}>", " ")).otherwise(c)


def inline_footnotes(c: Column) -> Column:
    """Short lines of a note number and a small letter, and bracketed note numbers, out."""
    lines = F.filter(F.split(c, "\n"), lambda x: ~((F.length(F.regexp_replace(x, r"^\s+|\s+$", "")) < 100) & x.rlike(r"^\s*\d{1,2}\s+[а-яё]")))
    return square_brackets(F.when(c.rlike(r"(?m)^\s*\d{1,2}\s+[а-яё]"), F.array_join(lines, "\n")).otherwise(c))


def repeated_headers(c: Column, times: int = 3) -> Column:
    """Lines that stand ``times`` times or more in a text, as they are or but for their numbers, out; headings stay.

    Repetitions are found as neighbours in the sorted lines, so the cost is that of sorting.
    """
    from quire.operators.structure import is_heading

    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    mask = lambda x: F.regexp_replace(x, r"\d+", "#")

    def often(values: Column) -> Column:
        far = lambda v: F.filter(F.transform(v, lambda x, i: F.when(F.get(v, i + times - 1) == x, x)), lambda x: x.isNotNull())
        return bound(F.array_sort(values), lambda v: F.array_distinct(far(v)))

    lines = F.split(c, "\n")
    counted = F.filter(F.transform(lines, strip), lambda x: (x != "") & (F.length(x) < 100) & ~is_heading(x))
    repeated = bound(counted, lambda v: F.struct(often(v).alias("same"), often(F.transform(F.filter(v, lambda x: x.rlike(r"\d")), mask)).alias("masked")))
    kept = bound(repeated, lambda r: F.filter(lines, lambda x: is_heading(strip(x)) | ~(F.array_contains(r["same"], strip(x)) | F.array_contains(r["masked"], mask(strip(x))))))
    return F.when(F.size(lines) >= times, F.array_join(kept, "\n")).otherwise(c)


def spoken_punctuation(c: Column) -> Column:
    """Marks as speech wants them: dashes between clauses to commas, an ellipsis before a capital to a stop."""
    c = F.regexp_replace(c, r",\s*—\s*(?=[а-яё\d])", ", ")
    c = F.regexp_replace(c, r"(?<=[а-яёА-ЯЁ\d,.])\s*—\s*(?=[а-яё\d])", ", ")
    c = F.regexp_replace(c, r"…\s*(?=[А-ЯЁA-Z])", ". ")
    return F.regexp_replace(F.regexp_replace(c, r"\*{1,3}|_{1,3}", ""), r"(?m)^#{1,6}\s+", "")


def html_to_text(c: Column) -> Column:
    """Breaks and block ends to line ends, tags and numeric entities away, five entities decoded in order."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), r"(?i)</(?:p|div|h[1-6])>", "\n\n")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    c = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')), c)
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"&#\d+;", ""), r"\n{3,}", "\n\n"))


def asr_text(c: Column, replacements: dict[str, str] | None = None, yo: bool = True, digits: bool = False) -> Column:
    """Text for comparison with a transcript: small letters, digits and marks only; ё as е, digits of all scripts as ASCII ones."""
    c = F.lower(c)
    for old, new in (replacements or {}).items():
        c = F.replace(c, F.lit(old.lower()), F.lit(new.lower()))
    if yo:
        c = F.translate(c, "ё", "е")
    if digits:
        c = F.translate(c, "٠١٢٣٤٥٦٧٨٩０１２３４５６７８９", "01234567890123456789")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}\p{M}\s]", " "), r"\s+", " "), "^ | $", "")


def without_space(c: Column) -> Column:
    """A text's characters without white space: two texts that only differ in layout have the same."""
    return F.regexp_replace(c, r"\s+", "")


def without_marks(c: Column) -> Column:
    """Without white space and punctuation."""
    return F.regexp_replace(c, r"[\s\p{P}]+", "")


def letters_only(c: Column) -> Column:
    """Small letters and digits only."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def truncate(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("…"))).otherwise(c)


def count_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def text_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


#: The order of stages matters; the Russian ones come from ``russian``.
NEUTRAL: list[tuple[str, Stage]] = [
    ("encoding_artifacts", encoding_artifacts), ("common_mojibake", common_mojibake), ("markup", markup), ("whitespace", whitespace), ("hyphenated_words", hyphenated_words), ("split_words", russian.split_words),
    ("broken_lines", broken_lines), ("page_numbers", page_numbers), ("boilerplate", boilerplate), ("inline_footnotes", inline_footnotes), ("repeated_headers", repeated_headers), ("empty_lines", empty_lines),
    ("indents", indents), ("dashes", dashes), ("ellipsis", ellipsis), ("repeated_commas", repeated_commas), ("parenthesis_hyphens", parenthesis_hyphens), ("punctuation_spacing", punctuation_spacing),
]
_FIRST, _LAST = 3, 13
RUSSIAN: list[tuple[str, Stage]] = [
    *NEUTRAL[:_FIRST], ("mixed_script", russian.mixed_script), ("ocr_artifacts", russian.ocr_artifacts), *NEUTRAL[_FIRST:6], ("particle_hyphens", russian.particle_hyphens), *NEUTRAL[6:_LAST], ("quotes", quotes), *NEUTRAL[_LAST:],
    ("abbreviations", russian.abbreviations), ("numbers", russian.numbers), ("contextual_vse", russian.contextual_vse),
]


#: Stages that leave the JVM, which no lambda may hold.
PYTHON = ("numbers",)


def pipeline(c: Column, stages: list[tuple[str, Stage]]) -> Column:
    """All stages as one expression, each bound once where that can be. A null text stays null. Over a table ``normalized`` costs less,
    and stages of ``PYTHON`` need it: Spark does not always find a Python function whose argument holds lambdas inside lambdas."""
    return reduce(lambda x, stage: stage[1](x) if stage[0] in PYTHON else bound(x, stage[1]), stages, c)


def normalized(df: DataFrame, text: str, stages: list[tuple[str, Stage]], tracked: bool = False) -> DataFrame:
    """``df`` with ``text`` normalised; ``tracked`` adds ``changed``, the names of the stages that changed it.

    Each stage is a projection over the one before: the optimiser merges those that name their input once and keeps the
    others apart, so no stage is worked out twice.
    """
    changed = []
    for i, (name, stage) in enumerate(stages):
        df = df.withColumn(f"_s{i}", stage(F.col(f"_s{i - 1}" if i else text)))
        changed.append(F.when(F.col(f"_s{i}") != F.col(f"_s{i - 1}" if i else text), F.lit(name)))
    last = F.col(f"_s{len(stages) - 1}" if stages else text)
    if tracked:
        df = df.withColumn("changed", F.filter(F.array(*changed), lambda x: x.isNotNull()))
    return df.withColumn(text, last).drop(*[f"_s{i}" for i in range(len(stages))])


def for_language(language: str) -> list[tuple[str, Stage]]:
    return RUSSIAN if language == "ru" else NEUTRAL


def with_stage_before(stages: list[tuple[str, Stage]], anchor: str, stage: tuple[str, Stage]) -> list[tuple[str, Stage]]:
    """Insert before ``anchor``; an unknown anchor appends."""
    names = [n for n, _ in stages]
    at = names.index(anchor) if anchor in names else len(stages)
    return [*stages[:at], stage, *stages[at:]]


def without_stage(stages: list[tuple[str, Stage]], name: str) -> list[tuple[str, Stage]]:
    return [s for s in stages if s[0] != name]
