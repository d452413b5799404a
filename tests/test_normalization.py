import pytest
from pyspark.sql import functions as F

from quire.functions import language, normalize, russian
from quire.operators import paragraphs


def apply(spark, stage, *rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r.x for r in df.select("i", stage(F.col("t")).alias("x")).orderBy("i").collect()]


def test_mixed_script(spark):
    assert apply(spark, russian.mixed_script, "пpивет мир", "Ha горе", "the OH box", None, "", "вот OH идёт  там") == ["привет мир", "На горе", "the OH box", None, "", "вот ОН идёт  там"]


def test_rules(spark):
    assert apply(spark, russian.brackets, "]ы и [оворил", "слово] тут", "(нет)") == ["Ты и Говорил", "слово тут", "(нет)"]
    assert apply(spark, russian.glued_words, "Тоесть сэтим вокругнего", "видалиу нее") == ["То есть с этим вокруг него", "видали у нее"]
    assert apply(spark, russian.particle_hyphens, "ктонибудь гдето, чтото", "онто", "ктонибудьь") == ["кто-нибудь где-то, что-то", "он-то", "ктонибудьь"]
    assert apply(spark, russian.split_words, "расхлё бывать", "как(то") == ["расхлёбывать", "как-то"]


def test_abbreviations(spark):
    texts = ["в 1941 г. и XIX в. и т. д.", "5 млн руб. и 10 км", "проф. Иванов, г. Омск", "слово. Дело", None]
    assert apply(spark, russian.abbreviations, *texts) == ["в 1941 года и XIX века и так далее", "5 миллионов руб. и 10 километров", "профессор Иванов, город Омск", "слово. Дело", None]


@pytest.mark.parametrize("n, words", [(21, "двадцать один"), (2000, "две тысячи"), (12345, "двенадцать тысяч триста сорок пять"), (100000, "сто тысяч"), (1, "один")])
def test_cardinals(n, words):
    assert russian.cardinal(n) == words


def test_numbers(spark):
    assert [russian.ordinal(n) for n in (17, 21, 50, 300, 2000, 1812)] == ["семнадцатый", "двадцать первый", "пятидесятый", "трёхсотый", "двухтысячный", "одна тысяча восемьсот двенадцатый"]
    assert apply(spark, russian.numbers, "17-й день и 12 лет", "0 и 3.5", None, "без чисел") == ["семнадцатый день и двенадцать лет", "0 и 3.5", None, "без чисел"]


def test_ocr_artifacts(spark):
    got = apply(spark, russian.ocr_artifacts, "Он шёл.\n\n\nаб\nОна шла xyz", "за. столом", "АБв Гд еЖ ЗИ\nСтрока целая", "", None)
    assert got == ["Он шёл.\n\nОна шла", "за столом", "Строка целая", "", None]


def test_mojibake(spark):
    good = "Говорили, что старый плотник починил шкатулку."
    assert apply(spark, russian.utf8_mojibake, good.encode().decode("latin-1"), good, "café", None, "") == [good, good, "café", None, ""]


def test_repeated_headers(spark):
    text = "Шапка 1\nтекст\nШапка 2\nещё\nШапка 3\nконец\nодно\nодно\nодно"
    assert apply(spark, normalize.repeated_headers, text, "а\nб", "Глава 1\nx\nГлава 1\ny\nГлава 1") == ["текст\nещё\nконец", "а\nб", "Глава 1\nx\nГлава 1\ny\nГлава 1"]


def test_boilerplate_and_markup(spark):
    assert apply(spark, normalize.boilerplate, "Спасибо, что скачали книгу! Текст\nhttp://royallib.com все книги автора\nРассказ", " a \n b ") == ["Текст\nРассказ", "a\nb"]
    assert apply(spark, normalize.markup, "<speak>Да &amp; нет<break/>&#1040;</speak>", "a < b") == ["\nДа & нет\nА\n", "a < b"]


def test_canonical_forms(spark):
    assert apply(spark, normalize.without_space, " а б\nв ") == ["абв"] and apply(spark, normalize.without_marks, "а, б!") == ["аб"] and apply(spark, normalize.letters_only, "А-б 1!") == ["аб1"]
    assert apply(spark, lambda c: normalize.asr_text(c, {"ул": "улица"}, digits=True), "Ёлка, ул ５!") == ["елка улица 5"]


def test_pipeline_and_tracking(spark):
    df = spark.createDataFrame([(1, "Слово  --  дело..."), (2, None), (3, "чисто")], "id int, text string")
    got = {r.id: r for r in normalize.normalized(df, "text", normalize.NEUTRAL, tracked=True).collect()}
    assert got[1].text == "Слово — дело…" and {"whitespace", "dashes", "ellipsis"} <= set(got[1].changed) and got[2].text is None and got[3].changed == []
    one = {r.id: r.x for r in df.select("id", normalize.pipeline(F.col("text"), normalize.NEUTRAL).alias("x")).collect()}
    assert one[1] == got[1].text and one[2] is None


def test_words_of_the_book(spark):
    df = spark.createDataFrame([(1, 1, "сказал Мельников тихо"), (2, 1, "и ельников ушёл"), (3, 2, "ельников ушёл"), (4, 1, None)], "row_id bigint, book_id bigint, text string")
    names = paragraphs.names_of(df, ["book_id"], "text")
    got = {r.row_id: r.text for r in paragraphs.replace_words(df, ["book_id"], ["row_id"], "text", paragraphs.dropped_initials(names, ["book_id"])).collect()}
    assert got == {1: "сказал Мельников тихо", 2: "и Мельников ушёл", 3: "ельников ушёл", 4: None}
    yo = spark.createDataFrame([("её ёлка",)] * 3 + [("Елка ЕЛКА ее все",)], "text string").withColumn("row_id", F.monotonically_increasing_id())
    assert paragraphs.yo_dictionary(yo.select("text"), ratio=1).count() == 2
    fixed = paragraphs.yoficate(yo, ["row_id"], "text", spark.createDataFrame([("елка", "ёлка"), ("ее", "её")], "key string, new string"))
    assert "Ёлка ЁЛКА её все" in {r.text for r in fixed.collect()}


def test_words_cut_between_paragraphs(spark):
    rows = [(1, 1, 1, 1, "при-"), (2, 1, 1, 2, " "), (3, 1, 1, 3, "мер пош-"), (4, 1, 1, 4, "ёл домой"), (5, 1, 2, 1, "конец-")]
    df = spark.createDataFrame(rows, "row_id bigint, book_id bigint, chapter_index int, chunk_index int, text string")
    got = {r.row_id: r.text for r in paragraphs.join_hyphens(df, ["book_id", "chapter_index"], ["chunk_index", "row_id"], ["row_id"]).collect()}
    assert got == {1: "пример пош-", 2: " ", 3: "", 4: "ёл домой", 5: "конец-"}


def test_scripts(spark):
    c = F.col("t")
    df = spark.createDataFrame([("Привет abc",), ("",), (None,)], "t string")
    r = df.select(F.round(language.cyrillic_ratio(c), 3).alias("a"), language.readable_cyrillic(c).alias("b"), language.unreadable(c, F.lit("ru")).alias("u")).collect()
    assert tuple(r[0]) == (0.667, 1.0, False) and tuple(r[1])[:2] == (0.0, 0.0)
