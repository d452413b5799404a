import pytest
from pyspark.sql import functions as F

from quire.llm import bpe, encoding, language, lookalike, mixing, scans, sentences, truncation
from quire.llm.pairs import fit_pairs

RU = ["Говорили, что старый плотник починил серебряную шкатулку на чердаке.", "Мельник стоял у ворот и медленно разглядывал чужую газету.", "Никто не поверил рассказу, а собака всё не умолкала."]
EN = ["The old carpenter mended a silver box in the attic.", "The miller stood near the gate and slowly read a paper.", "Nobody believed the story, and the dog would not stop."]
UZ = ["Keksa duradgor kumush qutichani boloxonada tuzatib berdi.", "Tegirmonchi darvoza yonida turib, gazetani shoshilmay oʻqidi.", "Hikoyaga hech kim ishonmadi, it esa vovillashdan toʻxtamadi."]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, t) for i, t in enumerate((RU + EN + UZ) * 60)]
    return spark.createDataFrame(rows, "row_id bigint, text string").withColumn("src", F.lit("t"))


@pytest.fixture(scope="module")
def pairs(corpus):
    return fit_pairs(corpus.select("text"))


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.encode_special_tokens = True
    texts = ["", " ", "\n\n  x", "Hello world's <|endoftext|> 12345", "Привет, мир — ещё раз!", "他说：“好。”", "oʻzbekcha 😀 é", "a" * 300, None]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: list(r.ids) for r in bpe.encode_column(df, ["doc_id"], F.col("text")).collect()}
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert got == want
    assert bpe.encode_column(df.limit(0), ["doc_id"], F.col("text")).count() == 0


def test_encoding_round_trip(spark, pairs):
    text = RU[0]
    bad = [text.encode("utf-8").decode("cp1251", "replace"), text.encode("koi8-r").decode("cp1251"), text.encode("cp1251").decode("latin-1"), RU[1] + "\n" + text.encode("koi8-r").decode("cp1251")]
    rows = [("t", i, x) for i, x in enumerate([*bad, *RU, *EN, *UZ, None, "", "????? ??????? ????", "— ??? — сказал он."])]
    df = spark.createDataFrame(rows, "src string, row_id bigint, text string")
    fixed = {r.row_id: r for r in encoding.fix_encoding(df, ["src", "row_id"], "text", pairs).collect()}
    assert set(fixed) == {0, 1, 2, 3, 15}
    assert fixed[1].restored == text and fixed[2].restored == text and fixed[3].restored == RU[1] + "\n" + text
    assert {r.row_id for r in encoding.find_wrong(df, ["row_id"], "text", pairs).collect()} == set(fixed)


def test_lookalikes(spark, pairs):
    rows = ["Мельник стоял у вoрoт.", "The ｏｌｄ box", "ﬁne", "кафе́ й".replace("й", "й"), "a​b c", "a b", "qo'ydi toʻxtamadi oʻqidi", "плотник и USB", None, "", "　段落", "⼈"]
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(rows)], "src string, row_id bigint, text string")
    got = {r.row_id: (set(r.forms), r.unified) for r in lookalike.unify_forms(df, ["row_id"], "text", pairs).collect()}
    assert got[0] == ({"lookalike"}, "Мельник стоял у ворот.") and got[1] == ({"compat"}, "The old box") and got[2] == ({"compat"}, "fine")
    assert "combining" in got[3][0] and got[4] == ({"invisible"}, "ab c") and got[5] == ({"space"}, "a b")
    assert got[6] == ({"lookalike"}, "qoʻydi toʻxtamadi oʻqidi") and got[11] == ({"lookalike"}, "人") and not {7, 8, 9, 10} & set(got)


def test_sentences(corpus):
    model = sentences.fit_sentences(corpus.select("text"))
    cut = lambda t: [t[a:b] for a, b in sentences.sentence_ends(t, model)]
    assert cut("Dr. Brown left at 5 p.m. and slept. He was tired!") == ["Dr. Brown left at 5 p.m. and slept.", "He was tired!"]
    assert cut("— Никогда! Надо спрятать газету, — сказал Николай. — Пока не поздно. Все ушли.") == ["— Никогда! Надо спрятать газету, — сказал Николай. — Пока не поздно.", "Все ушли."]
    assert cut("«Да! Нет...» — прошептал он. Тишина.") == ["«Да! Нет...» — прошептал он.", "Тишина."]
    assert cut("“够了！快走。”他说。天亮了。") == ["“够了！快走。”他说。", "天亮了。"]
    assert cut("Числа 3.14 и 28.07.1922 тут.\nстрока без точки") == ["Числа 3.14 и 28.07.1922 тут.", "строка без точки"]
    assert cut("") == [] and cut("?!") == [] and cut("…") == []


def test_languages_held_out(spark, corpus, pairs):
    rows = [("t", i, x, lab) for i, (x, lab) in enumerate([(t, l) for l, ts in (("ru", RU), ("en", EN), ("uz", UZ)) for t in ts] * 40)]
    df = spark.createDataFrame(rows, "src string, row_id bigint, text string, language string")
    table = spark.createDataFrame([("ru", "ru"), ("en", "en"), ("uz", "uz"), ("English", "en")], "label string, lang string")
    named = language.with_label(df, "language", table).select(F.col("row_id").alias("id"), "text", "labelled")
    profiles, model = language.fit_profiles(named), sentences.fit_sentences(df.select("text"))
    test = [("t", 1, "Весёлый гончар потерял старую монету возле реки.", None), ("t", 2, "A cheerful potter lost the coin beside the river.", "ru"), ("t", 3, RU[0] + " " + EN[0], "ru"), ("t", 4, None, "ru"), ("t", 5, "123 !", "ru")]
    out = {r.row_id: r for r in language.label_languages(spark.createDataFrame(test, df.schema), ["src", "row_id"], "text", "language", table, profiles, model, pairs).collect()}
    assert out[1].lang == "ru" and out[1].labelled is None and out[2].lang == "en" and set(out) == {1, 2, 3}
    assert [s.lang for s in out[3].segments] == ["ru", "en"] and 0 < out[1].confidence <= 1


def test_mixing(spark):
    sizes = [(i, "a" if i % 3 else "b", 50 + i % 7, "x") for i in range(3000)] + [(9001, None, 5, "x"), (9002, "a", 0, "x"), (9003, "c", 9, "x")]
    df = spark.createDataFrame(sizes, "doc_id bigint, source string, n_tokens int, copies string").drop("copies")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.5, 2), ("gone", 0.2, 3)], "source string, target_share double, max_repeats int")
    copies, shares = mixing.mix(df, targets)
    got = copies.collect()
    assert len(got) == len(sizes) and max(r.copies for r in got if r.source == "b") <= 2 and max(r.copies for r in got if r.source == "a") <= 1
    s = {r.source: r for r in shares.collect()}
    assert abs(s["a"].actual_share - 0.375) < 0.005 and abs(s["b"].actual_share - 0.625) < 0.005 and s["gone"].actual_share == 0 and s["c"].n_copies == 0
    assert mixing.mix(df.limit(0), targets)[0].count() == 0


def test_truncation(spark):
    whole = [f"{t} {t}" for t in RU + EN for _ in range(3)]
    rows = [(i, t, "good") for i, t in enumerate(whole)] + [(100, RU[0][:40], "good"), (101, RU[0] + " Ста� ".strip(), "good"), (102, EN[0] + " “Is it [...]", "good"), (103, None, "good"), (104, "  ", None), (105, "Стихи одни\nСтихи другие\nСтихи одни", "good"), (106, EN[0] + "\n\nRobert Copperfold,\nTorinham", "good")]
    rows += [(200 + i, (EN[i % 3] * 4)[:120], "cutter") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id for r in truncation.find_truncated(df).collect()}
    assert {100, 101, 102} <= got and not got & {103, 104, 105, 106, *range(len(whole))} and {r for r in range(200, 212)} <= got
    rates = {r.source: r for r in truncation.truncation_rates(df).collect()}
    assert rates["cutter"].char_limit == 120 and rates["cutter"].n_cut == 12


def test_scans(spark):
    body = "Разговорчивый гончар потерял старую монету возле реки и пошёл домой."
    pages = [(i, 1, i + 1, [f"О. Безуглин. Дом", body + "\nСтарый плотник сидел на чер-\nдаке и читал га\xad\nзету.", f"— {i + 1} —"], None) for i in range(60)]
    pages += [(100, 1, 101, [body.replace("монету", "м0нету")], None), (101, 1, 102, [body.replace("монету", "м0нету").replace("домой", "д0мой").replace("потерял", "п0терял")], []), (102, 1, 103, None, None), (103, None, None, [None, ""], None)]
    p = spark.createDataFrame(pages, "row_id bigint, book_id bigint, page_number int, page_text array<string>, text_from_images array<string>")
    v = spark.createDataFrame([(1, 1, 1, 1, "kind", None)], "row_id bigint, book_id bigint, first_page int, page_count int, kind string, text string")
    b = spark.createDataFrame([(1, "Дом", "О. Безуглин")], "book_id bigint, book_title string, author string")
    got = {(r.row_id, r.noise) for r in scans.noise(scans.fields(p, v), b).collect()}
    assert {(0, "header"), (0, "page_number"), (0, "hyphen"), (100, "misread"), (101, "misread")} <= got and not any(r in (102, 103) for r, _ in got) and (100, "header") not in got
    text = {r.row_id: r.text for r in scans.paragraphs(scans.fields(p, v), b).collect()}
    assert text[0].endswith("Старый плотник сидел на чердаке и читал газету.") and "Безуглин" not in text[0] and "монету" in text[100]


def _scan_tables(spark, variants, pages=()):
    """(pdf_pages, pdf_text_variants, books) of one book, with 60 usual pages of it; ``variants``: (row_id, first_page, page_count, text)."""
    body = "Разговорчивый гончар потерял старую монету возле реки и пошёл домой."
    usual = [(i, 1, i + 1, ["О. Безуглин. Дом", body + "\nСтарый плотник сидел на чер-\nдаке и читал газету.", f"— {i + 1} —"], None) for i in range(60)]
    p = spark.createDataFrame([*usual, *pages], "row_id bigint, book_id bigint, page_number int, page_text array<string>, text_from_images array<string>")
    v = spark.createDataFrame([(i, 1, first, n, "kind", t) for i, first, n, t in variants], "row_id bigint, book_id bigint, first_page int, page_count int, kind string, text string")
    return p, v, spark.createDataFrame([(1, "Дом", "О. Безуглин")], "book_id bigint, book_title string, author string")


def test_scans_number_inside_a_block(spark):
    p, v, b = _scan_tables(spark, [(1, 24, 2, "Соседи тогда\nначали шептаться.\n[24]\nСтарый плотник сидел\nи читал газету."), (2, 24, 2, "Соседи тогда\nначали шептаться.\n[31]\nСтарый плотник сидел\nи читал газету.")])
    numbers = scans.analyse(scans.fields(p, v)).filter("src = 'pdf_text_variants.text' AND kind = 'number'")
    assert [(r.row_id, r.at) for r in numbers.collect()] == [(1, 2)]


def test_scans_cut_across_furniture(spark):
    text = "Седой фонарщик вычи-\n[24]\nО. БЕЗУГЛИН. ДОМ\nстил старую монету.\nСтарый плотник сидел на чер-\f\n\nО. БЕЗУГЛИН. ДОМ   25\nдаке и чистил га-\nНи один плотник не сидел у реки тогда\nзету."
    p, v, b = _scan_tables(spark, [(1, 24, 3, text), *[(i, 24 + i, 1, "О. БЕЗУГЛИН. ДОМ\nСтарый плотник вычистил старую монету.") for i in range(2, 9)]])
    _, _, cuts, _, _ = scans.find_noise(scans.fields(p, v), b)
    assert {(r.at, r.joined) for r in cuts.filter("src = 'pdf_text_variants.text'").collect()} == {(0, "вычистил"), (4, "чердаке")}
    got = {r.row_id: r.text for r in scans.paragraphs(scans.fields(p, v), b).filter("src = 'pdf_text_variants.text'").collect()}
    assert got[1].startswith("Седой фонарщик вычистил старую монету. Старый плотник сидел на чердаке и чистил га-")


def test_scans_misread_at_the_ends_of_a_run(spark):
    whole = {"老木匠": 400, "木匠在": 300, "^木匠": 120, "匠在家": 90, "制的木": 90, "的木$": 90, "用木制": 90, "铁匠在": 90, "^铁匠": 60, "木制的": 200, "匠人$": 80, "^木$": 60, "在家$": 80, "老铁匠": 60}
    rows = [*whole.items(), ("^朩匠", 2), ("朩匠在", 3), ("老朩匠", 2), ("制的朩", 1), ("的朩$", 1), ("朩制的", 3), ("用朩制", 1), ("^朩$", 1), ("木匠几", 1), ("^金匠", 1)]
    got = {r.word: r.right for r in scans.corrections(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == {w: w.replace("朩", "木") for w, _ in rows if "朩" in w}
    assert set(scans._words("朩匠，木")) == {"^朩匠", "朩匠$", "^木$"}
    assert scans._run_pattern("匠在$").sub("匠站", "木匠在家，木匠在。") == "木匠在家，木匠站。"


def test_scans_two_misread_letters(spark):
    assert scans.single_operations("qishloʻida", "q1shl0ʻida") == ["i>1", "o>0"] and scans.single_operations("modern", "modem") == ["rn>m"] and scans.single_operations("дом", "дома") == []
    names = ["kolosim", "tropino", "miloson", "vikolor", "solidor", "gimnota", "pilotin", "dorivom", "sinodol", "rotivok", "fitolog", "lopinor"]
    rows = [(w, 400) for w in [*names, "boy", "sun", "hut"]] + [(w.replace("o", "0", 1), 2) for w in names] + [(w.replace("i", "1", 1), 2) for w in names]
    rows += [("t0rilov", 1), ("torilov", 300), ("k0l0sim", 1), ("m1l0son", 1), ("b0y", 1), ("katsune", 1), ("kafsuni", 300)]
    got = {r.word: r.right for r in scans.corrections(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert {w: got.get(w) for w in ("k0l0sim", "m1l0son", "b0y", "katsune")} == {"k0l0sim": "kolosim", "m1l0son": "miloson", "b0y": "boy", "katsune": None}


def test_truncation_open_quotation_before_a_signature(spark):
    rows = [(i, t, "good") for i, t in enumerate(f"{t} {t}" for t in RU + EN for _ in range(3))]
    rows += [(100, f"“{EN[0]} {EN[1]}\n\nYour Friend,\nJosephine Tambl", "good"), (101, f"“{EN[0]}” {EN[1]}\n\nYour Friend,\nJosephine Tamblewick", "good")]
    got = {r.doc_id: r.reason for r in truncation.find_truncated(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert got == {100: "open quotation or bracket"}


def test_truncation_limit_below_the_longest_text(spark):
    long = " ".join(EN * 20)
    rows = [(i, long[i : i + 300].rsplit(" ", 1)[0] + (" [...]" if i % 2 else ""), "words") for i in range(40)] + [(100, long[:900] + " The end.", "words")]
    rows += [(200 + i, long[i : i + 120], "cutter") for i in range(12)] + [(300, long[:900] + " The end.", "cutter")] + [(400 + i, long[: 100 + 37 * i] + " The end.", "even") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    base = {r.source: r for r in truncation.source_baselines(truncation.read_ends(docs)).collect()}
    assert base["words"].at_words and 296 <= base["words"].char_limit <= 300 and base["cutter"].char_limit == 120 and not base["cutter"].at_words and base["even"].char_limit is None
    assert all(r.at_limit for r in truncation.find_truncated(docs).filter("source <> 'even' AND doc_id < 100").collect())


def test_stack_automaton():
    open_of = lambda t: (truncation.read(t).stack, truncation.read(t).sentence)
    assert open_of("Он сказал: «Да (нет). И (") == (["«", "("], True) and open_of("Он сказал: «Да (нет)».") == ([], False)
    assert open_of('She said "no') == (['"'], True) and open_of('She said "no."') == ([], False)
    assert open_of("<div><p>text") == (["div", "p"], True) and open_of("<div><p>text</p><br></div>") == ([], False)
    assert open_of("„Ja“ sagte er.") == ([], False) and open_of("") == ([], False)
    assert truncation.read("a &am").broken and truncation.read("x \\u04").broken and not truncation.read("a &amp; b.").broken
    assert truncation.read("Open line\n\nClosed line.\n\nLast").chars_open == 9


def test_truncation_decides_by_the_stack(spark, monkeypatch):
    rows = [(i, t, "good") for i, t in enumerate(f"{t} {t}" for t in RU + EN for _ in range(3))] + [(100, RU[0][:40], "good"), (101, f"{EN[0]} ({EN[1][:20]}", "good")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r.doc_id for r in truncation.find_truncated(df).collect()} == {100, 101}
    ends = truncation.read_ends(df)
    none = ends.withColumn("sentence", F.lit(False)).withColumn("open", F.lit(0))
    assert truncation.find_truncated(df, none).count() == 0


def test_truncation_is_no_sign_where_it_is_usual(spark):
    open_prose = "the potter came home\n\nthe miller slept all day\n\nnobody saw the silver box at the river"
    rows = [(i, open_prose, "telegraph") for i in range(30)] + [(100 + i, f"{t} {t}\n\n{t}", "prose") for i, t in enumerate(EN * 4)] + [(200, f"{EN[0]}\n\nThe miller sle", "prose"), (300, "the potter came home\n\nthe miller ran and ra", "telegraph")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    rates = {r.source: r for r in truncation.truncation_rates(df).collect()}
    assert rates["telegraph"].open_prose == 1.0 and rates["prose"].open_prose == 0.0
    assert {200, 300} <= {r.doc_id for r in truncation.find_truncated(df).collect()}


def test_bpe_of_very_long_pieces():
    import random

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.encode_special_tokens = True
    rng = random.Random(3)
    n = 1_000_000
    texts = ["a" * n, "=" * n, "中" * n, "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n // 4)), "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60_000)), "abcab" * 40_000, "the quick" * 3_000, "ab" * 5_000 + "=" * 3_001]
    encoder = bpe.Encoder(bpe.vocabulary_path())
    for text in texts:
        assert encoder.encode([text])[0] == t.encode(text, add_special_tokens=False).ids


def test_bpe_blocks_of_any_size(monkeypatch):
    import random

    from tokenizers import Tokenizer

    monkeypatch.setattr("quire.llm.bpe.BLOCK", 24)
    t = Tokenizer.from_file(bpe.vocabulary_path())
    rng = random.Random(4)
    encoder = bpe.Encoder(bpe.vocabulary_path())
    texts = ["".join(rng.choices(rng.choice(["ab", "etaoinshr", "абвгдеж", "=-", "aaab"]), k=rng.randint(1, 400))) for _ in range(150)]
    assert encoder.encode(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_lookalike_classes_are_transitive(pairs):
    k = lookalike.Classes(pairs)
    assert len({k.sets.find(c) for c in "ａaаα"}) == 1 and k.sets.find("a") != k.sets.find("o")
    assert k.scripts["ａ"]["CYRILLIC"] == "а" and k.plain["ａ"] == "a" and lookalike.unify("стａрый плотник", pairs)[0] == "старый плотник"
    assert k.turned["o'"] == "oʻ"


def test_lookalikes_come_from_the_union_find(pairs, monkeypatch):
    monkeypatch.setattr(lookalike.UnionFind, "union", lambda self, a, b: None)
    k = lookalike.Classes(pairs)
    assert not k.plain and not k.scripts and not k.turned and not k.kinds.any()


def test_the_corpus_chooses_the_representative(spark):
    wide = fit_pairs(spark.createDataFrame([("ｂｏｘ ｂｏｘ ｂｏｏｋ " * 400,), ("b",)], "text string"))
    assert lookalike.Classes(wide).plain["b"] == "ｂ"


def test_a_very_long_line_of_sentences(corpus):
    import time

    model = sentences.fit_sentences(corpus.select("text"))
    began = time.time()
    line = "The miller slept, he said. “No! Never.” he said. — Да, — сказал он. Все ушли! " * 4000
    spans = sentences.sentence_ends(line, model)
    assert spans[-1][1] == len(line.rstrip()) and len(spans) > 8000 and time.time() - began < 60


def test_han_has_a_profile_like_any_other(spark, pairs):
    zh = ["老木匠在阁楼里修好了银色的箱子，谁也不相信这个故事。", "年轻的磨坊主站在门口，慢慢地读着报纸，狗却一直叫个不停。"]
    rows = [("t", i, x, lab) for i, (x, lab) in enumerate([(t, l) for l, ts in (("ru", RU), ("en", EN), ("zh", zh)) for t in ts] * 40)]
    df = spark.createDataFrame(rows, "src string, row_id bigint, text string, language string")
    table = spark.createDataFrame([("ru", "ru"), ("en", "en"), ("zh", "zh")], "label string, lang string")
    profiles = language.fit_profiles(language.with_label(df, "language", table).select(F.col("row_id").alias("id"), "text", "labelled"))
    han = profiles.rank[profiles.languages.index("zh"), language.HAN_BASE :]
    assert (han < language.PROFILE).sum() > 20 and (profiles.rank[profiles.languages.index("ru"), language.HAN_BASE :] == language.PROFILE).all()
    test = [("t", 1, "木匠读着银色的报纸，狗叫个不停。", "ru"), ("t", 2, zh[0] + RU[0], "zh")]
    out = {r.row_id: r for r in language.label_languages(spark.createDataFrame(test, df.schema), ["row_id"], "text", "language", table, profiles, sentences.fit_sentences(df.select("text")), pairs).collect()}
    assert out[1].lang == "zh" and [s.lang for s in out[2].segments] == ["zh", "ru"]
