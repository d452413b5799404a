from pyspark.sql import functions as F

from quire.functions import language, metrics, normalize


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("o")).first().o


def test_stages(spark):
    assert one(spark, "a b ​ c\n  d  ", normalize.whitespace) == "a b c\nd"
    assert one(spark, "при-\nмер и под(\nвал", normalize.hyphenated_words) == "пример и подвал"
    assert one(spark, 'он сказал "да" и ушёл', normalize.quotes) == "он сказал «да» и ушёл"
    assert one(spark, "раз -- два... три,, четыре", lambda c: normalize.pipeline(c, normalize.RUSSIAN)) == "раз — два… три, четыре"
    assert one(spark, "x\n 12 \ny", normalize.page_numbers).split() == ["x", "y"]
    assert one(spark, "<speak>Да<break/>нет &lt;</speak>", normalize.markup).split() == ["Да", "нет", "<"]
    assert one(spark, "приятного чтения, скачали книгу\nтекст", normalize.boilerplate) == "текст"
    assert one(spark, None, lambda c: normalize.pipeline(c, normalize.RUSSIAN)) is None
    assert one(spark, "", lambda c: normalize.pipeline(c, normalize.NEUTRAL)) == ""
    assert [n for n, _ in normalize.with_stage_before(normalize.NEUTRAL, "nothing", ("x", normalize.dashes))][-1] == "x"


def test_languages(spark):
    rows = spark.createDataFrame([("ru_RU",), ("chi_sim",), ("KZ",), (None,), ("xx",)], "l string").select(language.book_language(F.col("l")).alias("o")).collect()
    assert [r.o for r in rows] == ["ru", "zh", "kk", "ru", "ru"]


def test_error_rates(spark):
    row = spark.createDataFrame([("a b c d", "a x c"), ("", ""), ("", "a")], "e string, a string").select(metrics.word_error_rate(F.col("e"), F.col("a")).alias("w"), metrics.char_error_rate(F.col("e"), F.col("a")).alias("c")).collect()
    assert [r.w for r in row] == [0.5, 0.0, 1.0] and row[2].c == 1.0
