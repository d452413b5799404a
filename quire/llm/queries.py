"""Queries of the training-data operators over the driver's tables, and SQL for those that have some."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, encoding, language, lookalike, mixing, scans, sentences, truncation
from quire.llm.names import link_names, spelling_pairs
from quire.llm.pairs import PairModel, fit_pairs
from quire.llm.splitting import split_oversized, with_profile
from quire.sources.tables import table


def _texts(spark: SparkSession, d: str, *tables: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """(src, row_id, text, *columns) of several tables."""
    parts = [table(spark, d, t).select(F.lit(t).alias("src"), "row_id", "text", *columns) for t in tables]
    return reduce(DataFrame.unionByName, parts)


def _marked(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, "manifest_chunks", "pdf_text_variants")


def _pair_model(spark: SparkSession, d: str) -> PairModel:
    return fit_pairs(_marked(spark, d).select("text"))


# 1: noise of print and scan


def _fields(spark: SparkSession, d: str) -> DataFrame:
    return scans.fields(table(spark, d, "pdf_pages"), table(spark, d, "pdf_text_variants"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """A row per field and kind of noise in it."""
    return scans.noise(_fields(spark, d), table(spark, d, "books").select("book_id", "book_title", "author"))


def p1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Each field as continuous paragraphs."""
    return scans.paragraphs(_fields(spark, d), table(spark, d, "books").select("book_id", "book_title", "author"))


# 2: look-alike forms


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """A row per text and form in it, without texts that were decoded wrongly."""
    model = _pair_model(spark, d)
    return lookalike.find_forms(_marked(spark, d), model).select("src", "row_id", F.explode("forms").alias("form"))


def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every text that is written with variants."""
    return lookalike.find_forms(_marked(spark, d), _pair_model(spark, d)).select("src", "row_id", "unified")


# 3: oversized texts


def oversized_pieces(spark: SparkSession, d: str) -> DataFrame:
    """One row per oversized text of manifest_chunks and chunk_specs, with its pieces."""
    rows = _texts(spark, d, "manifest_chunks", "chunk_specs", columns=("chunker", "boundary_after"))
    rows = with_profile(rows, table(spark, d, "chunk_profiles"))
    return split_oversized(rows, ["src", "row_id"], F.col("text"), F.col("max_chunk_chars"), F.col("overlap_chars"), F.col("boundary_after"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows longer than the limit of their chunker: those the splitter cuts into several pieces."""
    return oversized_pieces(spark, d).filter(F.size("pieces") > 1).select("src", "row_id")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces themselves."""
    return oversized_pieces(spark, d).select("src", "row_id", F.inline("pieces"))


# 4: sentences


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """A row per sentence, with its end; texts that were decoded wrongly are left out."""
    pairs = _pair_model(spark, d)
    rows = _texts(spark, d, "manifest_chunks", "chunk_specs")
    return sentences.split_sentences(rows, ["src", "row_id"], "text", sentences.fit_sentences(rows.select("text")), pairs).select("src", "row_id", "end_char")


def p4_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence with its text, of all texts."""
    rows = _texts(spark, d, "manifest_chunks", "chunk_specs")
    spans = sentences.split_sentences(rows, ["src", "row_id", "text"], "text", sentences.fit_sentences(rows.select("text")))
    return spans.select("src", "row_id", "start_char", "end_char", F.substring("text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")).alias("sentence"))


# 5: spellings of names


def _linked(spark: SparkSession, d: str) -> DataFrame:
    return link_names(
        table(spark, d, "manifest_chunks").select("book_id", "speaker"),
        table(spark, d, "character_profiles").select("book_id", "profile_id", "display_name", "aliases"),
        table(spark, d, "nickname_list"),
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different spellings of one entity of a book."""
    return spelling_pairs(_linked(spark, d))


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    """The entity of every spelling."""
    return _linked(spark, d)


# 6: wrong encodings


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose text was decoded with a wrong encoding."""
    return encoding.find_wrong(_marked(spark, d), ["src", "row_id"], "text", _pair_model(spark, d))


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    """Those rows with their text restored as far as it goes."""
    return encoding.fix_encoding(_marked(spark, d), ["src", "row_id"], "text", _pair_model(spark, d))


# 7: languages


def _languages(spark: SparkSession, d: str, cases: bool = False) -> DataFrame:
    codes = table(spark, d, "language_codes")
    rows = _texts(spark, d, "manifest_chunks", "chunk_specs", columns=("language",))
    named = language.with_label(rows, "language", codes).select(F.struct("src", "row_id").alias("id"), "text", "labelled")
    model = sentences.fit_sentences(rows.select("text"))
    return language.label_languages(rows, ["src", "row_id"], "text", "language", codes, language.fit_profiles(named), model, _pair_model(spark, d), cases)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The main language where the label lacks or errs (segment 0), and the segments of mixed texts."""
    rows = _languages(spark, d, cases=True)
    judged = F.col("label_counts") & (F.col("labelled").isNull() | (F.col("labelled") != F.col("lang")))
    main = F.when(judged, F.array(F.struct(F.lit(0).alias("seg_no"), F.col("lang").alias("lang")))).otherwise(F.array().cast("array<struct<seg_no:int,lang:string>>"))
    segments = F.transform("segments", lambda s, i: F.struct((i + 1).alias("seg_no"), s["lang"].alias("lang")))
    return rows.filter(~F.col("mangled")).select("src", "row_id", F.inline(F.concat(main, segments)))


def p7_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every text and segment."""
    return _languages(spark, d).select("src", "row_id", "lang", "confidence", "labelled", "segments")


# 8: tokens


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return bpe.encode_column(table(spark, d, "documents"), ["doc_id"], F.col("text"))


# 9: mixing


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = bpe.encode_column(table(spark, d, "documents"), ["doc_id", "source"], F.col("text"), counts_only=True)
    return mixing.mix(sizes, table(spark, d, "mix_targets"))


def p9_copies(spark: SparkSession, d: str) -> DataFrame:
    """How often each document enters the mix."""
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share each source was to have and has."""
    return _mix(spark, d)[1]


# 10: cut texts


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text was cut."""
    return truncation.find_truncated(_documents(spark, d)).select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Each source's rate of cuts."""
    return truncation.truncation_rates(_documents(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_paragraphs, p2_found, p2_unified, p3_found, p3_pieces, p4_found, p4_sentences, p5_found, p5_entities, p6_found, p6_restored, p7_found, p7_languages, p8_ids, p9_copies, p9_shares, p10_found, p10_rates)}

_OVER = """SELECT 'manifest_chunks' AS src, row_id, text, chunker FROM manifest_chunks
UNION ALL SELECT 'chunk_specs', row_id, text, chunker FROM chunk_specs"""

#: The others can't be said in SQL over whole tables; tests compare them with brute force, round trips and held-out accuracy.
ORACLES = {
    "p3_found": f"""
SELECT t.src, t.row_id FROM ({_OVER}) t
JOIN chunk_profiles p ON p.chunker = CASE WHEN trim(coalesce(t.chunker, '')) = '' THEN 'default' ELSE trim(t.chunker) END
WHERE length(t.text) > p.max_chunk_chars""",
}
