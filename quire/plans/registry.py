"""Named queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if it has one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


TEXT_TABLES = ("manifest_chunks", "chunk_specs", "pdf_text_variants")
#: All texts of the three tables that have one, as SQL.
TEXTS = "(" + " UNION ALL ".join(f"SELECT '{t}' AS src, row_id, book_id, text FROM {t}" for t in TEXT_TABLES) + ")"


def texts(spark: SparkSession, d: str) -> DataFrame:
    """(src, row_id, book_id, text) of all texts."""
    out = None
    for t in TEXT_TABLES:
        part = table(spark, d, t).select(F.lit(t).alias("src"), "row_id", "book_id", "text")
        out = part if out is None else out.unionByName(part)
    return out


#: Blocks of pages, page text and text from images, as SQL.
BLOCKS = """(SELECT src, row_id, book_id, page_number, CAST(i AS INTEGER) AS block, blocks[i + 1] AS text FROM (SELECT src, row_id, book_id, page_number, blocks, unnest(range(len(blocks))) AS i FROM (
 SELECT 'page_text' AS src, row_id, book_id, page_number, page_text AS blocks FROM pdf_pages UNION ALL SELECT 'text_from_images', row_id, book_id, page_number, text_from_images FROM pdf_pages)) WHERE blocks[i + 1] IS NOT NULL)"""


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """(src, row_id, book_id, page_number, block, text) of all blocks of all pages; null blocks left out."""
    pages = table(spark, d, "pdf_pages")
    parts = [pages.select(F.lit(c).alias("src"), "row_id", "book_id", "page_number", F.posexplode(c).alias("block", "text")) for c in ("page_text", "text_from_images")]
    return parts[0].unionByName(parts[1]).filter("text IS NOT NULL")
