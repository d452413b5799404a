"""Stages for Russian text: misread letters, glued and broken words, abbreviations, numbers.

All but the spelling of numbers are built-in expressions. ``*_SQL`` builders say the same for an SQL engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions.rules import WORD, Rule, apply_rules, rules_sql

_RU = "А-Яа-яЁё"
_RUX = _RU + "-"
_CYR = r"\x{0400}-\x{04FF}"

#: Latin letters that look like Cyrillic ones.
LATIN_LIKE, CYRILLIC_LIKE = "aAeEoOpPcCxXHKMTBy", "аАеЕоОрРсСхХНКМТВу"
#: A word of Latin letters alone is only rewritten up to this length, with Cyrillic within this many words.
SHORT_LATIN, NEAR = 5, 2


def mixed_script(c: Column) -> Column:
    """Latin look-alikes to Cyrillic in words of both scripts, and in short Latin words beside Cyrillic ones."""
    cyrillic = lambda w: w.rlike("[а-яёА-ЯЁ]")

    def fixed(words: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            first = F.greatest(i - NEAR + 1, F.lit(1))
            near = F.exists(F.slice(words, first, i + NEAR + 2 - first), cyrillic)
            mixed = cyrillic(w) & w.rlike("[a-zA-Z]")
            return F.when(mixed | w.rlike(rf"^[{LATIN_LIKE}]{{1,{SHORT_LATIN}}}$") & near, F.translate(w, LATIN_LIKE, CYRILLIC_LIKE)).otherwise(w)

        return F.transform(words, one)

    return F.when(c.rlike("[a-zA-Z]") & c.rlike("[а-яёА-ЯЁ]"), _with_words(c, r"\S+", fixed)).otherwise(c)


def _with_words(c: Column, pattern: str, fixed: Callable[[Column], Column]) -> Column:
    """A text whose words (matches of ``pattern``, bound once) were replaced as an array, what lies between kept."""
    words = F.transform(F.array(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))), fixed)[0]
    parts = F.arrays_zip(F.split(c, pattern).alias("g"), words.alias("w"))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.coalesce(x["g"], F.lit("")), F.coalesce(x["w"], F.lit("")))), "")


def mixed_script_sql(text: str) -> str:
    words, gaps = f"regexp_extract_all({text}, '\\S+')", f"string_split_regex({text}, '\\S+')"
    near = f"len(list_filter(list_slice({words}, greatest(i - {NEAR}, 1), i + {NEAR}), lambda x: regexp_matches(x, '[а-яёА-ЯЁ]'))) > 0"
    fixed = f"CASE WHEN regexp_matches(w, '[а-яёА-ЯЁ]') AND regexp_matches(w, '[a-zA-Z]') OR regexp_matches(w, '^[{LATIN_LIKE}]{{1,{SHORT_LATIN}}}$') AND {near} THEN translate(w, '{LATIN_LIKE}', '{CYRILLIC_LIKE}') ELSE w END"
    new = f"list_transform({words}, lambda w, i: {fixed})"
    whole = f"array_to_string(list_transform({gaps}, lambda g, j: g || coalesce(({new})[j], '')), '')"
    return f"CASE WHEN regexp_matches({text}, '[a-zA-Z]') AND regexp_matches({text}, '[а-яёА-ЯЁ]') THEN {whole} ELSE {text} END"


#: What a square bracket was read for.
BRACKETS = (
    Rule(r"\](?:(ы)|(о))", "Т{1}{2}", not_before=WORD, ignore_case=True),
    Rule(r"\[(д)", "Г{1}", not_before=WORD, ignore_case=True),
    Rule(r"\[(о)", "Г{1}", not_before=WORD, ignore_case=True),
    Rule(r"\[(р)", "П{1}", not_before=WORD, ignore_case=True),
    Rule(r"\[(ере[а-яё])", "П{1}", not_before=WORD, ignore_case=True),
    Rule(r"\[([А-ЯЁ])", "{1}", not_before=WORD),
    Rule(r"\]", "", before=_CYR, not_after=WORD),
)
#: Short words written as one.
GLUED = (
    Rule("сэтим", "с этим", not_before=WORD, not_after=WORD, ignore_case=True),
    Rule("Тоесть", "То есть", not_before=WORD, not_after=WORD),
    Rule("тоесть", "то есть", not_before=WORD, not_after=WORD),
    Rule("Авы", "А вы", not_before=WORD, after=r",\s"),
    Rule(r"Ноты(\s+же)", "Но ты{1}", not_before=WORD, not_after=WORD),
    Rule(
        "(вокруг|внутри|возле|около|после|перед|между)(не(?:кому|чему|кого|чего|кем|чем)|ни(?:кому|чему|кого|чего|кем|чем)|(?:меня|тебя|себя|него|нее|неё|нас|вас|них|нам|вам|ним|ней))",
        "{1} {2}", not_before=_RUX, not_after=_RUX, ignore_case=True,
    ),
    Rule(r"([а-яё]{3,}ли)у(\s+(?:их|его|нее|неё|них|нас|вас|меня|тебя|себя))", "{1} у{2}", not_before=_RUX, not_after=WORD, ignore_case=True),
)
#: Words that take a particle with a hyphen.
_BASES = "откуда|почему|зачем|сколько|когда|какого|какому|какими|каких|каким|каком|какую|какая|какое|какие|какой|куда|кого|кому|кем|ком|кто|чего|чему|чем|чём|что|где|как|чей|чья|чье|чьё|чьи"
_PRONOUNS = "меня|тебя|себя|него|нее|неё|нам|вам|мне|тебе|ему|ней|ним|них|нас|вас|им|ей|их|он|она|оно|они|мы|ты|вы|я"
PARTICLES = (
    Rule(f"({_BASES})(нибудь|либо|то)", "{1}-{2}", not_before=_RUX, not_after=_RUX, ignore_case=True),
    Rule(f"({_PRONOUNS})то", "{1}-то", not_before=_RUX, not_after=_RUX, ignore_case=True),
)
#: Tails that line ends cut off their words.
SPLIT_WORDS = (
    Rule(r"([А-ЯЁа-яё]{2,16})\s+(быва(?:ть|л[аио]?|ет|ют)|дажн[а-яё]{2,8}|неч[а-яё]{1,8})", "{1}{2}", not_before=WORD, not_after=WORD),
    Rule(r"([А-ЯЁа-яё]+)\((то|либо|нибудь)", "{1}-{2}", not_before=WORD, not_after=WORD),
    Rule(r"из\(за", "из-за", not_before=WORD, not_after=WORD, ignore_case=True),
)
_STRAY = (
    Rule("['‘’`‚‛‹›]", "", before="а-яёА-ЯЁ", not_after=r"\p{Lu}\p{N}a-z.,;:!?«»—-"),
    Rule(r"([а-яёА-ЯЁ]{1,3})\.\s([а-яёА-ЯЁ])", "{1} {2}", not_before=WORD),
    Rule(r"тром(\s+[а-яё])", "Утром{1}", not_before=r"0-9A-Za-z\x{0400}-\x{04FF}"),
    Rule(r"рием(\s+шел)", "Прием{1}", not_before=r"0-9A-Za-z\x{0400}-\x{04FF}", not_after=WORD),
    Rule(r"[=<>|#№‡†§¶]+", "", before=r"\s", after=r"\s"),
)


def brackets(c: Column) -> Column:
    return F.when(c.rlike(r"[\[\]]"), apply_rules(c, BRACKETS)).otherwise(c)


def glued_words(c: Column) -> Column:
    return apply_rules(c, GLUED)


def particle_hyphens(c: Column) -> Column:
    return apply_rules(c, PARTICLES)


def split_words(c: Column) -> Column:
    return apply_rules(c, SPLIT_WORDS)


def is_noise_line(line: Column) -> Column:
    """Three or more short words of mixed case without a closing mark, as scanning leaves them near headings."""
    plain = F.trim(F.regexp_replace(line, "[^А-Яа-яЁёA-Za-z]+", " "))
    words = F.split(plain, " ")
    letters = F.length(F.replace(plain, F.lit(" "), F.lit("")))
    capitals = F.length(F.regexp_replace(plain, "[^А-ЯЁA-Z]", ""))
    short = ~line.rlike("[А-Яа-яЁёA-Za-z]{6}") & (F.size(words) >= 3) & (letters <= 3.5 * F.size(words))
    return short & (letters >= 6) & (capitals >= 0.35 * letters) & ~line.rlike(r"[.!?…»]\s*$")


def is_noise_line_sql(line: str) -> str:
    plain = f"trim(regexp_replace({line}, '[^А-Яа-яЁёA-Za-z]+', ' ', 'g'))"
    words, letters = f"string_split({plain}, ' ')", f"length(replace({plain}, ' ', ''))"
    capitals = f"length(regexp_replace({plain}, '[^А-ЯЁA-Z]', '', 'g'))"
    return f"(len({words}) >= 3 AND list_max(list_transform({words}, lambda w: length(w))) <= 5 AND {letters} <= 3.5 * len({words}) AND {letters} >= 6 AND {capitals} >= 0.35 * {letters} AND NOT regexp_matches({line}, '[.!?…»]\\s*$'))"


def ocr_artifacts(c: Column) -> Column:
    """Marks of misreading out of Russian text: stray marks, brackets, glued words, then noise lines and the edges of lines."""
    c = particle_hyphens(glued_words(F.transform(F.array(apply_rules(c, _STRAY)), brackets)[0]))
    c = apply_rules(c, (Rule(r"([а-яёА-ЯЁ])-\s*\n\s*([а-яё])", "{1}{2}"), Rule(" {3,}", " ")))
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    stray = lambda x: x.rlike(r"^[\s\p{P}\p{S}]{0,4}[а-яёА-ЯЁa-zA-Z]{1,2}[\s\p{P}\p{S}]{0,4}$") | is_noise_line(x)
    kept = F.filter(lines, lambda x: (x == "") | ~stray(x))
    edged = F.transform(kept, lambda x: F.struct((x == "").alias("blank"), F.regexp_replace(F.regexp_replace(x, r"^[‚,.:;]\s*", ""), r"\s+[a-zA-Z.,;:!?-]{1,3}\s*$", "").alias("line")))
    whole = F.array_join(F.transform(F.filter(edged, lambda x: x["blank"] | (x["line"] != "")), lambda x: x["line"]), "\n")
    return F.regexp_replace(F.regexp_replace(whole, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "\n")


#: Abbreviations and what they stand for, in order of application.
_SHORT_FORMS = {
    "напр": "например", "др": "другие", "пр": "прочее", "см": "смотри", "ср": "сравни", "ок": "около", "обл": "область", "ул": "улица", "пер": "переулок", "пл": "площадь", "бул": "бульвар", "д": "дом",
    "корп": "корпус", "стр": "строение", "проф": "профессор", "акад": "академик", "доц": "доцент", "канд": "кандидат", "асс": "ассистент", "им": "имени", "гр": "гражданин", "зав": "заведующий", "зам": "заместитель",
    "изд": "издание", "ред": "редакция", "рис": "рисунок", "табл": "таблица", "гл": "глава", "ст": "статья", "с": "страница", "сб": "сборник", "вып": "выпуск", "мин": "минут", "сек": "секунд", "ч": "часов",
    "р": "река", "оз": "озеро", "о": "остров", "п": "посёлок", "г": "город", "б": "бывший", "тел": "телефон",
}
_BEFORE_NUMBER, _BEFORE_NAME = ("с", "ч"), ("р", "о", "п", "г")
_PHRASES = (
    (r"и\s+т\.\s*д\.\s+и\s+т\.\s*п\.", "и так далее и тому подобное"), (r"в\s+т\.\s*ч\.", "в том числе"), (r"т\.\s*о\.", "таким образом"), (r"т\.\s*е\.", "то есть"), (r"т\.\s*д\.", "так далее"),
    (r"т\.\s*п\.", "тому подобное"), (r"т\.\s*н\.", "так называемый"), (r"т\.\s*к\.", "так как"), (r"н\.\s*э\.", "нашей эры"), (r"до\s+н\.\s*э\.", "до нашей эры"),
)
_AMOUNTS = ((r"млрд\.?", "миллиардов"), (r"млн\.?", "миллионов"), (r"тыс\.", "тысяч"), (r"руб\.", "рублей"), (r"коп\.", "копеек"), (r"долл\.", "долларов"), (r"экз\.", "экземпляров"))
_UNITS = (("км", "километров"), ("кг", "килограммов"), ("мм", "миллиметров"), ("см", "сантиметров"), ("га", "гектаров"))


def _short_form(short: str, full: str) -> Rule:
    if short in _BEFORE_NUMBER:
        return Rule(rf"{short}\.(\s*\d)", full + "{1}", not_before=WORD)
    if short in _BEFORE_NAME:
        return Rule(rf"{short}\.(\s*[А-ЯЁ])", full + "{1}", not_before=WORD)
    return Rule(rf"{short}\.", full, not_before=WORD)


ABBREVIATIONS = (
    *(Rule(p, full, not_before=WORD, ignore_case=True) for p, full in _PHRASES),
    Rule(r"(\d{1,4})\s*[-–—]\s*(\d{1,4})\s*гг\.", "{1}–{2} годов"),
    Rule(r"(\d{1,4})\s*г\.", "{1} года"),
    Rule(r"([IVXLCDM]+)\s*[-–—]\s*([IVXLCDM]+)\s*вв\.", "{1}–{2} веков", not_before=WORD),
    Rule(r"([IVXLCDM]+)\s*в\.", "{1} века", not_before=WORD),
    Rule(r"(\d+)\s*в\.", "{1} века"),
    *(Rule(rf"(\d)\s*{p}", "{1} " + full) for p, full in _AMOUNTS),
    *(Rule(rf"(\d)\s*{p}", "{1} " + full, not_after=WORD) for p, full in _UNITS),
    *(_short_form(s, full) for s, full in _SHORT_FORMS.items()),
)


#: A text without any of these has no abbreviation: one search in front of the rules.
ABBREVIATED = rf"(?:^|[^{WORD}])(?i:т\.\s*[чоедпнк]|н\.\s*э)\.|(?:^|[^{WORD}])(?:{'|'.join(_SHORT_FORMS)})\.|[0-9IVXLCDM]\s*(?:гг?\.|вв?\.|мл|тыс\.|руб\.|коп\.|долл\.|экз\.|км|кг|мм|см|га)"


def abbreviations(c: Column) -> Column:
    """Abbreviations written out; texts without one pass untouched."""
    return F.when(c.rlike(ABBREVIATED.replace("(?i:", "(?iu:")), apply_rules(c, ABBREVIATIONS)).otherwise(c)


def abbreviations_sql(text: str) -> str:
    return f"CASE WHEN regexp_matches({text}, '{ABBREVIATED}') THEN {rules_sql(text, ABBREVIATIONS)} ELSE {text} END"


_ONES = " один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать".split(" ")
_TENS = "  двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split(" ")
_HUNDREDS = " сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split(" ")
_ORDINAL = {
    "один": "первый", "два": "второй", "три": "третий", "четыре": "четвёртый", "шесть": "шестой", "семь": "седьмой", "восемь": "восьмой", "сорок": "сороковой", "сто": "сотый", "двести": "двухсотый", "триста": "трёхсотый", "четыреста": "четырёхсотый",
}
_GENITIVE = {"один": "одно", "два": "двух", "три": "трёх", "четыре": "четырёх", "восемь": "восьми", "сорок": "сорока", "сто": "сто", "двести": "двухсот", "триста": "трёхсот", "четыреста": "четырёхсот"}


def _triple(n: int, feminine: bool = False) -> list[str]:
    words = [_HUNDREDS[n // 100]]
    words += [_ONES[n % 100]] if n % 100 < 20 else [_TENS[n % 100 // 10], _ONES[n % 10]]
    if feminine and words[-1] in ("один", "два"):
        words[-1] = {"один": "одна", "два": "две"}[words[-1]]
    return [w for w in words if w]


def cardinal(n: int) -> str:
    """A number below a million in words."""
    if n == 0:
        return "ноль"
    thousands, rest = divmod(n, 1000)
    words = _triple(thousands, True) if thousands else []
    if thousands:
        last, teen = thousands % 10, thousands % 100 // 10 == 1
        words.append("тысяча" if last == 1 and not teen else "тысячи" if 2 <= last <= 4 and not teen else "тысяч")
    return " ".join(words + _triple(rest))


def ordinal(n: int) -> str:
    """An ordinal below a million, masculine nominative."""
    if n == 0:
        return "нулевой"
    thousands, rest = divmod(n, 1000)
    if not rest:
        stem = "".join(_genitive(w) for w in _triple(thousands)) if thousands > 1 else ""
        return stem + "тысячный"
    head = [cardinal(thousands * 1000)] if thousands else []
    *words, last = _triple(rest)
    if last in _ORDINAL:
        last = _ORDINAL[last]
    elif last.endswith("десят"):
        last = _genitive(last.removesuffix("десят")) + "десятый"
    elif last.endswith("сот"):
        last = _genitive(last.removesuffix("сот")) + "сотый"
    elif last == "девяносто":
        last = "девяностый"
    else:
        last = last.removesuffix("ь") + "ый"
    return " ".join([*head, *words, last])


def _genitive(word: str) -> str:
    if word in _GENITIVE:
        return _GENITIVE[word]
    if word.endswith("десят"):
        return _genitive(word.removesuffix("десят")) + "десяти"
    if word.endswith("сот"):
        return _genitive(word.removesuffix("сот")) + "сот"
    return word.removesuffix("ь") + "и" if word.endswith("ь") else word


_NTH = re.compile(r"\b(\d{1,6})-(?:й|го|му|м|я|ю|ой|ей|ых|ое|ая|ые|ом|ем|ым|им)\b")
_ALONE = re.compile(r"(?<!\S)(\d{1,6})(?!\S)")


def numbers_of(text: str) -> str:
    """Ordinals with an ending and numbers that stand alone, in words; 0 stays."""
    text = _NTH.sub(lambda m: ordinal(int(m.group(1))), text)
    return _ALONE.sub(lambda m: cardinal(int(m.group(1))) if int(m.group(1)) else m.group(), text)


@F.pandas_udf(StringType())
def _numbers(texts: pd.Series) -> pd.Series:
    return texts.map(numbers_of, na_action="ignore")


def numbers(c: Column) -> Column:
    """Numbers in words. Only texts with a digit leave the JVM."""
    has = c.rlike(r"(?:^|\s)\d{1,6}(?:\s|$)|\d-\p{IsCyrillic}")
    return F.when(has, _numbers(F.when(has, c))).otherwise(c)


#: Words after and before which все is всё.
_SURE_AFTER = "равно еще ещё же таки было будет стало становилось кончено закончилось хорошо тихо ясно понятно".split()
_SURE_BEFORE = "это этим этого этом и".split()


def contextual_vse(c: Column) -> Column:
    """все to всё where the words beside it leave no doubt."""
    def fixed(words: Column) -> Column:
        low = lambda i: F.lower(F.coalesce(F.get(words, i), F.lit("")))

        def one(w: Column, i: Column) -> Column:
            after, before = low(i + 1), F.when(i > 0, low(i - 1)).otherwise("")
            sure = after.isin(*_SURE_AFTER) | before.isin(*_SURE_BEFORE)
            return F.when((F.lower(w) == "все") & sure, F.translate(w, "еЕ", "ёЁ")).otherwise(w)

        return F.transform(words, one)

    return F.when(c.rlike("(?iu)(?<![А-Яа-яЁё])все(?![А-Яа-яЁё])"), _with_words(c, "[А-Яа-яЁё]+", fixed)).otherwise(c)


#: Byte pairs and triples that double decoding leaves.
_MARKERS = "[ÐÑÂ]|â€"
#: The characters of windows-1252 that stand for the bytes 80 to 9f (five are open).
_CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_CP1252_BYTES = "".join(map(chr, (0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F)))


def text_quality(c: Column) -> Column:
    """Four for a Cyrillic letter, one for a Latin one, less for marks of double decoding and lost characters."""
    return 4 * F.regexp_count(c, F.lit(r"[\x{0400}-\x{04FF}]")) + F.regexp_count(c, F.lit("[A-Za-z]")) - 18 * (F.regexp_count(c, F.lit(_MARKERS)) + F.regexp_count(c, F.lit("â€[™œ\x9d”“]"))) - 30 * F.regexp_count(c, F.lit("�"))


def utf8_mojibake(c: Column) -> Column:
    """Text that was UTF-8 read as Latin-1 or windows-1252, put right if its quality clearly rises."""

    def again(t: Column) -> Column:
        data = F.when(t.rlike(r"^[\x00-\xff]*$") & t.rlike(r"[\x80-\xff]"), F.encode(F.when(t.rlike(r"^[\x00-\xff]*$"), t), "ISO-8859-1"))
        return F.try_validate_utf8(data.cast("string"))

    latin = again(c)
    windows = again(F.when(~c.rlike(r"[\x80-\x9f]"), F.translate(c, _CP1252, _CP1252_BYTES)))
    score = lambda t: F.coalesce(text_quality(t), F.lit(-(1 << 30)))
    best = F.when(score(windows) > score(latin), windows).otherwise(latin)
    enough = F.greatest(F.lit(12), F.least(F.lit(500), F.floor(F.length(c) / 200)))
    return F.when(c.rlike(_MARKERS + "|[Ã]") & (score(best) >= text_quality(c) + enough), best).otherwise(c)
