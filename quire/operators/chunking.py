"""Segments and chunks: boundaries, islands of one voice, packing, and the passes that tidy chunks up.

Islands are windows within a chapter; greedy steps fold over a chapter's own array, which a chapter bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.dialogue import chunk_text

#: Boundaries from weak to strong, and the pauses they ask for.
BOUNDARIES = ("", "speaker", "paragraph", "scene", "chapter")
PARAGRAPH_MS, SCENE_MS, CHAPTER_MS, SPEAKER_MS = 450, 900, 1500, 600
SCENE_BREAK = r"^\s*[*#~]{1,5}(?:\s*[*#~]{1,5})*\s*$"
#: A dangling start has at most so many words and characters, a tiny chunk as well.
FEW_WORDS, DANGLING, TINY = 2, 16, 24


def strength(boundary: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[x for i, b in enumerate(BOUNDARIES) for x in (F.lit(b), F.lit(i))]), F.lower(F.trim(F.coalesce(boundary, F.lit(""))))), F.lit(0))


def stronger(left: Column, right: Column) -> Column:
    """The stronger of two boundaries; unknown ones count as none."""
    return F.element_at(F.array(*map(F.lit, BOUNDARIES)), F.greatest(strength(left), strength(right)) + 1)


def islands(rows: DataFrame, group: list[str], order: list[str], same: list[str], pause: str | None = None) -> DataFrame:
    """``rows`` with ``island``: neighbours that are equal in all of ``same`` (nulls are equal), unless the one before asks for a pause."""
    w = Window.partitionBy(*group).orderBy(*order)
    key = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in same])
    new = F.lag(key).over(w) != key
    if pause:
        new = new | (F.coalesce(F.lag(pause).over(w), F.lit(0)) > 0)
    return rows.withColumn("_new", F.coalesce(new, F.lit(False)).cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def chunks_of_segments(rows: DataFrame, group: list[str], order: list[str], same: list[str], limit: int = 900, sentence_limit: int = 200) -> DataFrame:
    """``(*group, island, part, *same, text, boundary_after, pause_after_ms)``: islands joined, those beyond the limit cut at sentences.

    The strongest boundary and the longest pause of an island go to its last part.
    """
    i = islands(rows.filter("trim(text) <> ''"), group, order, same, "pause_after_ms")
    one = i.groupBy(*group, "island").agg(
        *[F.first(c).alias(c) for c in same],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.trim("text").alias("text")))), lambda x: x["text"]), " ").alias("_t"),
        F.max(strength(F.col("boundary_after"))).alias("_b"), F.max(F.coalesce("pause_after_ms", F.lit(0))).alias("_p"),
    )
    parts = F.when(F.length("_t") <= limit, F.array("_t")).otherwise(chunk_text(F.col("_t"), limit, sentence_limit))
    cut = one.withColumn("_parts", parts).select("*", F.posexplode("_parts").alias("part", "text"))
    last = F.col("part") == F.size("_parts") - 1
    return cut.select(*group, "island", "part", *same, "text", F.when(last, F.element_at(F.array(*map(F.lit, BOUNDARIES)), F.col("_b") + 1)).otherwise("").alias("boundary_after"), F.when(last, F.col("_p")).otherwise(0).alias("pause_after_ms"))


def coalesce_chunks(rows: DataFrame, group: list[str], order: list[str], same: list[str], limit: int) -> DataFrame:
    """``(*group, chunk_index, *same, text, chunks)``: neighbours joined greedily while they are alike in ``same``, fit into the limit
    and no paragraph, scene or chapter ends between them."""
    item = F.struct(*order, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"k_{c}") for c in same], F.trim(F.coalesce("text", F.lit(""))).alias("text"), (strength(F.col("boundary_after")) >= 2).alias("ends"))
    packed = rows.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("_a"))
    shape = "struct<" + ",".join(f"k_{c}:string" for c in same) + ",text:string,ends:boolean,chunks:int>"
    as_one = lambda x: F.struct(*[x[f"k_{c}"].alias(f"k_{c}") for c in same], x["text"].alias("text"), x["ends"].alias("ends"), F.lit(1).alias("chunks"))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        alike = F.lit(True)
        for c in same:
            alike = alike & (last[f"k_{c}"] == x[f"k_{c}"])
        fits = (F.size(acc) > 0) & alike & ~last["ends"] & (last["text"] != "") & (x["text"] != "") & (F.length(last["text"]) + 1 + F.length(x["text"]) <= limit)
        joined = F.struct(*[last[f"k_{c}"].alias(f"k_{c}") for c in same], F.concat(last["text"], F.lit(" "), x["text"]).alias("text"), x["ends"].alias("ends"), (last["chunks"] + 1).alias("chunks"))
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(as_one(x))))

    out = packed.select(*group, F.posexplode(F.aggregate("_a", F.array().cast(f"array<{shape}>"), step)).alias("chunk_index", "_x"))
    return out.select(*group, "chunk_index", *[F.col(f"_x.k_{c}").alias(c) for c in same], "_x.text", "_x.chunks")


def _word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-zА-Яа-яЁё]+"))


def without_dangling(chunks: Column) -> Column:
    """An array of chunks with the start of a sentence that a chunk ends in moved to the next one, left to right."""
    tail = lambda t: F.regexp_extract(t, r"^.*[.!?…]\s+(\S.*)$", 1)

    def dangling(t: Column) -> Column:
        x = F.trim(tail(F.regexp_replace(t, r"\s+", " ")))
        return F.when((x != "") & ~x.rlike(r"[.!?…]$") & _word_count(x).between(1, FEW_WORDS) & (F.length(x) <= DANGLING), x)

    def step(acc: Column, x: Column) -> Column:
        text = F.trim(x)
        last = F.element_at(acc, -1)
        moved = F.when((F.size(acc) > 0) & (text != ""), dangling(last))
        kept = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.trim(F.substring(last, F.lit(1), F.length(last) - F.length(moved)))))
        return F.when(moved.isNotNull(), F.concat(kept, F.array(F.concat(moved, F.lit(" "), text)))).otherwise(F.concat(acc, F.array(text)))

    return F.filter(F.aggregate(chunks, F.array().cast("array<string>"), step), lambda t: t != "")


def without_tiny(chunks: Column, limit: int) -> Column:
    """Chunks of one or two words that close nothing joined with the one before, else with the next, where it fits."""
    tiny = lambda t: (F.length(t) <= TINY) & _word_count(t).between(1, FEW_WORDS) & ~t.rlike(r"[.!?]$")

    def step(acc: Column, x: Column) -> Column:
        text, last = F.trim(x), F.element_at(acc, -1)
        # a tiny chunk goes to the one before; one that opens the list, or did not fit, waits for the next
        fits = (F.size(acc) > 0) & (F.length(last) + 1 + F.length(text) <= limit) & (tiny(text) | tiny(last))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), text)))
        return F.when(text == "", acc).when(fits, joined).otherwise(F.concat(acc, F.array(text)))

    return F.aggregate(chunks, F.array().cast("array<string>"), step)


def chunk_chapter(text: Column, limit: int = 900, sentence_limit: int = 200) -> Column:
    """Array of (text, boundary_after, pause_after_ms): paragraphs packed up to the limit, longer ones cut at sentences.

    A line of asterisks is no text but ends a scene. The last chunk ends the chapter.
    """
    paragraphs = F.filter(F.transform(F.split(text, r"\n[ \t]*\n+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    kind = "array<struct<text:string,boundary_after:string,pause_after_ms:int>>"
    piece = lambda t, b, ms: F.struct(t.alias("text"), F.lit(b).alias("boundary_after"), F.lit(ms).cast("int").alias("pause_after_ms"))
    start = F.struct(F.array().cast(kind).alias("done"), F.lit("").alias("cur"))

    def flush(acc: Column, b: str, ms: int) -> Column:
        return F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(piece(acc["cur"], b, ms))))

    def mark_scene(done: Column) -> Column:
        last = F.element_at(done, -1)
        return F.when(F.size(done) > 0, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(piece(last["text"], "scene", SCENE_MS)))).otherwise(done)

    def step(acc: Column, p: Column) -> Column:
        fits = (acc["cur"] != "") & (F.length(acc["cur"]) + 2 + F.length(p) <= limit)
        long = F.concat(flush(acc, "paragraph", PARAGRAPH_MS), F.transform(chunk_text(p, limit, sentence_limit), lambda t, i: piece(t, "paragraph", PARAGRAPH_MS)))
        state = lambda done, cur: F.struct(done.alias("done"), cur.alias("cur"))
        return (
            F.when(p.rlike(SCENE_BREAK), state(mark_scene(flush(acc, "scene", SCENE_MS)), F.lit("")))
            .when(F.length(p) > limit, state(long, F.lit("")))
            .when(fits, state(acc["done"], F.concat(acc["cur"], F.lit("\n\n"), p)))
            .otherwise(state(flush(acc, "paragraph", PARAGRAPH_MS), p))
        )

    return F.aggregate(paragraphs, start, step, lambda a: flush(a, "chapter", CHAPTER_MS))


def annotated(units: DataFrame, rows: DataFrame, keys: list[str], fields: list[str], order: str) -> DataFrame:
    """``units`` with the ``fields`` of the annotation of their key; of several annotations the last by ``order`` counts. The text of a
    unit is never that of its annotation; a unit without one has nulls."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.col(order)).alias("_a"))
    return units.join(last, keys, "left").select(units["*"], *[F.col(f"_a.{f}").alias(f"annotated_{f}") for f in fields])


def line_key(chapter: Column, paragraph: Column, line: Column, text: Column) -> Column:
    """The key of a line by its place and content."""
    return F.concat(F.lit("ch"), F.lpad(chapter.cast("string"), 3, "0"), F.lit(":ord"), F.lpad(paragraph.cast("string"), 4, "0"), F.lit(":line"), F.lpad(line.cast("string"), 4, "0"), F.lit(":"), F.substring(F.sha1(F.trim(text)), 1, 12))


def preserved(units: DataFrame, source: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``(*keys, preserved)``: whether the units of a text (in order, without white space) are the text."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    joined = units.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.coalesce("text", F.lit("")).alias("text")))), lambda x: bare(x["text"])), "").alias("_u"))
    return source.join(joined, keys, "left").select(*keys, (bare(F.coalesce("text", F.lit(""))) == F.coalesce("_u", F.lit(""))).alias("preserved"))


#: What an answer's items may look like: the voice as a key of its own, or named beside the text.
ITEM = "array<struct<narrator:string,men:string,women:string,voice:string,text:string>>"


def parsed_items(answer: Column) -> Column:
    """Array of (voice, text) of an answer: the list between its first and last square bracket; blank items are dropped."""
    items = F.from_json(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), ITEM)
    named = F.transform(items, lambda x: F.struct(F.coalesce(F.when(x["narrator"].isNotNull(), F.lit("narrator")), F.when(x["men"].isNotNull(), F.lit("men")), F.when(x["women"].isNotNull(), F.lit("women")), x["voice"], F.lit("narrator")).alias("voice"), F.trim(F.coalesce(x["narrator"], x["men"], x["women"], x["text"], F.lit(""))).alias("text")))
    return F.filter(named, lambda x: x["text"] != "")


# who speaks

#: Verbs of speech, words of feeling, and words of thought.
VERBS = "сказал|сказала|ответил|ответила|спросил|спросила|крикнул|крикнула|прошептал|прошептала|произнёс|произнесла|воскликнул|воскликнула|заметил|заметила|добавил|добавила"
VERBS_EN = "said|asked|cried|replied|answered|whispered|shouted|added"
CUES = (("whisper", "прошептал|шёпотом|шепнул|whispered"), ("shout", "крикнул|закричал|воскликнул|shouted|cried"), ("sad", "вздохнул|заплакал|всхлипнул|sighed|sobbed"), ("joyful", "засмеялся|рассмеялся|улыбнулся|laughed|smiled"))
THOUGHTS = "подумал|подумала|решил про себя|решила про себя|мелькнуло в голове|thought"


def speaker_named(text: Column) -> Column:
    """The name beside a verb of speech, the last one of a text; null if none."""
    ru = F.regexp_extract_all(text, F.lit(rf"(?:{VERBS})\s+([А-ЯЁ][а-яё]+(?:\s[А-ЯЁ][а-яё]+)?)"), F.lit(1))
    en = F.regexp_extract_all(text, F.lit(rf"(?:{VERBS_EN})\s+([A-Z][a-z]+(?:\s[A-Z][a-z]+)?)|([A-Z][a-z]+)\s(?:{VERBS_EN})"), F.lit(1))
    zh = F.regexp_extract_all(text, F.lit(r"([一-鿿]{2,4}?)(?:说|问|答|喊|道)[：:，]"), F.lit(1))
    last = lambda a: F.nullif(F.try_element_at(F.filter(a, lambda x: x != ""), F.lit(-1)), F.lit(""))
    return F.coalesce(last(ru), last(en), last(zh))


def cue(text: Column) -> Column:
    """The feeling that a remark tells; null if none."""
    return F.coalesce(*[F.when(text.rlike(f"(?iu){p}"), F.lit(e)) for e, p in CUES])


def repaired_speakers(chunks: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``chunks`` with ``tag_speaker``, ``cue_emotion`` and ``is_thought`` of every spoken row.

    A narrator's row right after speech names its speaker, tells its feeling (else the row before it does), and a word of thought
    there makes quoted speech a thought.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    text = F.coalesce("text", F.lit(""))
    rows = chunks.withColumns({"_say": F.col("voice_label").isin("men", "women"), "_name": speaker_named(text), "_cue": cue(text), "_think": text.rlike(f"(?iu)(?:{THOUGHTS})")})
    after = lambda c: F.when(~F.coalesce(F.lead("_say").over(w), F.lit(True)), F.lead(c).over(w))
    before = F.when(~F.coalesce(F.lag("_say").over(w), F.lit(True)), F.lag("_cue").over(w))
    say = F.coalesce("_say", F.lit(False))
    return rows.withColumns({"tag_speaker": F.when(say, after("_name")), "cue_emotion": F.when(say, F.coalesce("_cue", after("_cue"), before)), "is_thought": say & text.rlike(r"^\s*[«“\"]") & F.coalesce(after("_think"), F.lit(False))}).drop("_say", "_name", "_cue", "_think")


def assignment_issues(chunks: DataFrame) -> DataFrame:
    """``(row_id, issue)``: speech in the narrator's voice, a voice of the other gender, or a speaker that is no person; the first that fits."""
    name, text = F.trim(F.coalesce("speaker", F.lit(""))), F.coalesce("text", F.lit(""))
    female = name.rlike(r"(?:а|я|ова|ева|ина)$")
    issue = (
        F.when((F.col("voice_label") == "narrator") & text.rlike(r"^\s*[—–-]\s"), "dialogue_in_narrator_voice")
        .when((F.col("voice_label") == "men") & F.col("voice_id").startswith("female"), "voice_of_other_gender")
        .when((F.col("voice_label") == "women") & F.col("voice_id").startswith("male"), "voice_of_other_gender")
        .when(F.col("voice_label").isin("men", "women") & ((name == "") | name.rlike("^[0-9]+$")), "speaker_is_no_person")
        .when((F.col("voice_label") == "men") & female & name.rlike("^[А-ЯЁ][а-яё]+$"), "gender_uncertain")
    )
    return chunks.withColumn("issue", issue).filter("issue IS NOT NULL").select("row_id", "issue")


def quoted_speech(line: Column) -> Column:
    """Array of (text, is_dialogue) of a line: «…» is speech after a colon, beside a verb of speech, or if it ends in ! ? or …"""
    quotes, gaps = F.regexp_extract_all(line, F.lit("«([^»]+)»"), F.lit(1)), F.split(line, "«[^»]+»")
    item = lambda t, d: F.struct(F.trim(t).alias("text"), d.alias("is_dialogue"))
    pairs = F.arrays_zip(gaps.alias("g"), quotes.alias("q"))

    def parts(all_pairs: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            after = F.coalesce(F.get(all_pairs, i + 1)["g"], F.lit(""))
            near = F.concat(F.right(x["g"], F.lit(100)), F.lit(" "), F.left(after, F.lit(100)))
            spoken = x["g"].rlike(r":\s*$") | near.rlike(f"(?iu)(?<![\\p{{L}}])(?:{VERBS})(?![\\p{{L}}])") | x["q"].rlike(r"[!?…]\s*$")
            quote = F.when(spoken, x["q"]).otherwise(F.concat(F.lit("«"), x["q"], F.lit("»")))
            return F.array(item(x["g"], F.lit(False)), item(F.coalesce(quote, F.lit("")), F.coalesce(spoken, F.lit(False))))

        return F.filter(F.flatten(F.transform(all_pairs, one)), lambda p: p["text"] != "")

    return F.when(line.contains("«"), F.transform(F.array(pairs), parts)[0]).otherwise(F.array(item(line, F.lit(False))))
