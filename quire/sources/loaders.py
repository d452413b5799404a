"""Book files to paragraphs, and the sinks that write books and manifests.

Readers take paths or globs, read them as binary files, one task per file at most, and emit
``(path, chapter_index, chapter_title, para_index, raw_text)``. A file that cannot be read gives one row
with ``error`` set instead of failing the job.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, format string, chapter_index int, chapter_title string, para_index int, raw_text string, error string"
#: Encodings tried in order, and the formats by suffix.
ENCODINGS = ("utf-8", "cp1251", "cp866", "koi8-r", "latin-1")
FORMATS = {"txt": "txt", "fb2": "fb2", "epub": "epub", "docx": "docx"}


def decode(data: bytes) -> str:
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(node: ElementTree.Element) -> str:
    return " ".join("".join(node.itertext()).split())


def read_txt(data: bytes) -> Iterator[tuple[int, str, int, str]]:
    """One chapter; paragraphs are the blocks between empty lines, and keep their place in the file."""
    for i, block in enumerate(re.split(r"\n\n", decode(data).replace("\r\n", "\n"))):
        if block.strip():
            yield 0, "", i, block.strip()


def read_fb2(data: bytes) -> Iterator[tuple[int, str, int, str]]:
    """A chapter per top-level section of the first body; nested titles stand before their paragraphs."""
    root = ElementTree.fromstring(data)
    body = next((e for e in root if _local(e.tag) == "body"), None)
    if body is None:
        return
    sections = [e for e in body if _local(e.tag) == "section"] or [body]
    for c, section in enumerate(sections):
        title = next((_text(e) for e in section if _local(e.tag) == "title"), "")
        n = 0
        stack = [e for e in reversed(list(section)) if not (_local(e.tag) == "title")]
        while stack:
            e = stack.pop()
            if _local(e.tag) in ("p", "subtitle", "v", "text-author"):
                if text := _text(e):
                    yield c, title, n, text
                    n += 1
            else:
                stack += list(reversed(list(e)))


def html_blocks(html: str) -> list[str]:
    html = re.sub(r"(?i)<br\s*/?>", "\n", html)
    html = re.sub(r"(?i)</(?:p|div|h[1-6])>", "\n\n", html)
    text = re.sub(r"<[^>]+>", "", html)
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        text = text.replace(a, b)
    text = re.sub(r"&#\d+;", "", text)
    return [b.strip() for b in re.split(r"\n\s*\n", text) if b.strip()]


def html_title(html: str) -> str:
    for level in "123":
        m = re.search(rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", html)
        if m and (t := re.sub(r"<[^>]+>", "", m.group(1)).strip()):
            return t
    return ""


def read_epub(data: bytes) -> Iterator[tuple[int, str, int, str]]:
    """Documents in spine order, then the others; a first paragraph equal to the title is dropped."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    opf = next((n for n in names if n.endswith(".opf")), None)
    order: list[str] = []
    if opf:
        root = ElementTree.fromstring(z.read(opf))
        base = opf.rsplit("/", 1)[0] + "/" if "/" in opf else ""
        items = {e.get("id"): base + (e.get("href") or "") for e in root.iter() if _local(e.tag) == "item"}
        order = [items[e.get("idref")] for e in root.iter() if _local(e.tag) == "itemref" and e.get("idref") in items]
    order += [n for n in names if re.search(r"\.x?html?$", n) and n not in order]
    c = 0
    for name in order:
        if name not in names:
            continue
        html = z.read(name).decode("utf-8", "replace")
        title, blocks = html_title(html), html_blocks(re.sub(r"(?is)<head.*?</head>", "", html))
        if blocks and blocks[0] == title:
            blocks = blocks[1:]
        for i, b in enumerate(blocks):
            yield c, title, i, b
        c += bool(blocks)


def read_docx(data: bytes) -> Iterator[tuple[int, str, int, str]]:
    """A chapter per heading; headings without text after them vanish."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    c, n, title, used = 0, 0, "", False
    for p in root.iter():
        if _local(p.tag) != "p":
            continue
        style = next((v for e in p.iter() if _local(e.tag) == "pStyle" for k, v in e.attrib.items() if _local(k) == "val"), "")
        text = " ".join("".join(e.text or "" for e in p.iter() if _local(e.tag) == "t").split())
        if not text:
            continue
        if style.lower().startswith("heading"):
            c, n, title, used = c + used, 0, text, False
        else:
            yield c, title, n, text
            n, used = n + 1, True


_READERS = {"txt": read_txt, "fb2": read_fb2, "epub": read_epub, "docx": read_docx}


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf.path, pdf.content):
            kind = FORMATS.get(path.rsplit(".", 1)[-1].lower())
            try:
                if kind is None:
                    raise ValueError(f"unknown format; known are {', '.join(sorted(FORMATS))}")
                rows = [(path, kind, *r, None) for r in _READERS[kind](bytes(content))]
            except Exception as e:  # noqa: BLE001  one bad file is a row, not a failed job
                rows = [(path, kind, None, None, None, None, f"{type(e).__name__}: {e}"[:300])]
            yield pd.DataFrame(rows, columns=["path", "format", "chapter_index", "chapter_title", "para_index", "raw_text", "error"])


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of all book files under a path or glob; the format follows from the suffix."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_parse, SCHEMA)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of manifest files (version 2: chapters with chunks), one row per chunk; other shapes give no row."""
    schema = "book_title string, version int, chapters array<struct<chapter_index:int,chapter_title:string,chunks:array<struct<chunk_index:int,voice_label:string,voice:string,text:string,speaker:string,emotion:string,boundary_after:string,pause_after_ms:int,synthesized:boolean,deleted:boolean>>>>"
    books = spark.read.schema(schema).json(path, multiLine=True).filter("version = 2")
    rows = books.select("book_title", F.explode("chapters").alias("c"))
    return rows.select("book_title", F.col("c.chapter_index").alias("chapter_index"), F.col("c.chapter_title").alias("chapter_title"), F.inline("c.chunks"))


#: Folders that the chapters of all books share, by a hash of the book; a folder per book would be millions of them.
FOLDERS = 256


def chapter_texts(paragraphs: DataFrame) -> DataFrame:
    """(book_id, chapter_index, text): the paragraphs (book_id, chapter_index, para_index, text) of each chapter, in order."""
    parts = paragraphs.filter("text IS NOT NULL").groupBy("book_id", "chapter_index").agg(F.sort_array(F.collect_list(F.struct("para_index", "text"))).alias("p"))
    return parts.select("book_id", "chapter_index", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def write_texts(paragraphs: DataFrame, path: str) -> None:
    """The text of each chapter as a JSON line of (book_id, chapter_index, text), in ``FOLDERS`` folders by book."""
    rows = chapter_texts(paragraphs).withColumn("folder", F.pmod(F.xxhash64("book_id"), F.lit(FOLDERS)).cast("int"))
    rows.repartition("folder").write.mode("overwrite").partitionBy("folder").json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_texts`` wrote: (book_id, chapter_index, text)."""
    return spark.read.schema("book_id bigint, chapter_index int, text string, folder int").json(path).drop("folder")


_CHAPTER_FILE = r"([0-9]{3})_chapter_([0-9]+)\.txt$"


def read_chapter_directory(spark: SparkSession, path: str) -> DataFrame:
    """(path, chapter_index, para_index, raw_text) of files ``NNN_chapter_NN.txt`` of a folder, in their order; other files are no chapters."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*_chapter_*.txt").load(path).filter(F.col("path").rlike(_CHAPTER_FILE))
    text = rows.select("path", (F.regexp_extract("path", _CHAPTER_FILE, 1).cast("int")).alias("chapter_index"), F.decode("content", "UTF-8").alias("_t"))
    blocks = text.select("path", "chapter_index", F.posexplode(F.split("_t", r"\n[ \t]*\n+")).alias("para_index", "raw_text"))
    return blocks.withColumn("raw_text", F.regexp_replace("raw_text", r"^\s+|\s+$", "")).filter("raw_text <> ''")


def without_front_matter(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs (path, pos, raw_text) without what stands before the book begins.

    Where a heading is met again, everything before the earliest second occurrence goes, if that part has three headings or more, or a
    mark of a contents list or annotation among its first ten paragraphs. Books of fewer than six paragraphs stay whole.
    """
    from pyspark.sql import Window

    from quire.operators import structure

    key = F.lower(F.regexp_replace("raw_text", r"\s+", " "))
    heads = paragraphs.filter(structure.is_heading(F.col("raw_text"))).select("path", "pos", key.alias("_key"))
    again = heads.withColumn("_n", F.row_number().over(Window.partitionBy("path", "_key").orderBy("pos"))).filter("_n = 2").groupBy("path").agg(F.min("pos").alias("_cut"))
    before = heads.join(again, "path").filter("pos < _cut").groupBy("path").agg(F.count(F.lit(1)).alias("_heads"))
    first = Window.partitionBy("path").orderBy("pos")
    facts = paragraphs.withColumn("_n", F.row_number().over(first)).groupBy("path").agg(F.count(F.lit(1)).alias("_all"), F.max((F.col("_n") <= 10) & F.col("raw_text").rlike(r"(?iu)^\s*(?:оглавление|содержание|аннотация|contents|annotation)\s*$")).alias("_mark"))
    cut = again.join(before, "path", "left").join(facts, "path").filter("_all >= 6 AND (_heads >= 3 OR _mark)").select("path", "_cut")
    return paragraphs.join(cut, "path", "left").filter("_cut IS NULL OR pos >= _cut").drop("_cut")


def write_manifest(nested: DataFrame, path: str) -> None:
    """Nested chapters (see ``manifest.nest``) as JSON lines, committed as a whole."""
    nested.write.mode("overwrite").json(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of all files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def read_nested(spark: SparkSession, path: str, chunks: DataFrame) -> DataFrame:
    """What ``write_manifest`` wrote of the nested chapters of ``chunks``, with their types."""
    from quire.operators.manifest import nest

    return spark.read.schema(nest(chunks.limit(0)).schema).json(path)


def spoken_text(paragraphs: DataFrame, stress: str = "plain") -> DataFrame:
    """(book_id, chapter_index, text) for speech: normalised texts if the book has any, the stress written as asked (see ``stress.rendered``).

    ``paragraphs``: (book_id, chapter_index, para_index, text, normalized). Once a paragraph of a book is normalised, the others are left out.
    """
    from quire.operators.stress import rendered

    some = paragraphs.groupBy("book_id").agg(F.max(F.coalesce(F.col("normalized") != "", F.lit(False))).alias("_some"))
    rows = paragraphs.join(some, "book_id").withColumn("text", rendered(F.when(F.col("_some"), F.col("normalized")).otherwise(F.col("text")), stress)).filter("text <> ''")
    return chapter_texts(rows)


def book_structure(paragraphs: DataFrame, preview: int = 120) -> DataFrame:
    """(book_id, chapter_index, paragraphs, chars, previews): the structure of a book for a report, with the beginning of each paragraph."""
    from quire.functions.normalize import truncate

    rows = paragraphs.filter("text IS NOT NULL").withColumn("_p", truncate(F.col("text"), preview + 1))
    return rows.groupBy("book_id", "chapter_index").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("text")).alias("chars"), F.sort_array(F.collect_list(F.struct("para_index", F.col("_p").alias("preview")))).alias("previews"))


def verification(before: DataFrame, after: DataFrame) -> DataFrame:
    """(book_id, artifact, value): what a run did to each book (book_id, text): counts before and after, their difference, and suspicious changes."""
    from quire.operators.review import suspicious_changes

    s = suspicious_changes(before, after)
    names = [c for c in s.columns if c != "book_id"]
    return s.select("book_id", F.inline(F.array(*[F.struct(F.lit(n).alias("artifact"), F.col(n).cast("string").alias("value")) for n in names])))


def append_log(events: DataFrame, path: str) -> None:
    """Events (stage, status, details, at) of a run appended as JSON lines; what is there stays."""
    events.write.mode("append").json(path)


def log_counters(spark: SparkSession, path: str) -> DataFrame:
    """(stage, status, n, seconds) of a log: how often, and from the first to the last event."""
    rows = spark.read.schema("stage string, status string, details string, at timestamp").json(path)
    return rows.groupBy("stage", "status").agg(F.count(F.lit(1)).alias("n"), (F.unix_timestamp(F.max("at")) - F.unix_timestamp(F.min("at"))).alias("seconds"))


def run_id(output: Column, manifest: Column, parameters: Column) -> Column:
    """A stable id of a run: a UUID of the first 32 hex digits of the hash of what it reads, writes and is told."""
    h = F.sha2(F.to_json(F.struct(manifest.alias("manifest"), output.alias("output_dir"), parameters.alias("parameters"))), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
