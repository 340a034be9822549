"""Files as DataFrames: lists of urls and rejects, books, dumps, pages, caches.

All reading goes through Spark's readers, so any store that Spark reaches works.
"""

from __future__ import annotations

import html as entities
import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyflow.functions import dates, html, text, urls
from storyflow.functions.udf import lazy


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """Urls of text files, one a line; ``#`` begins a comment."""
    line = F.trim(F.split_part(F.col("value"), F.lit("#"), F.lit(1)))
    return spark.read.text(path).select(line.alias("url")).where("url <> ''")


def parsed_rejects(lines: DataFrame, column: str = "value") -> DataFrame:
    """url, title, author, note of lines ``url,title by author - note``.

    A text that is not of that form is the note.
    """
    value = F.col(column)
    form = r"^([^,]+),(.*?) by (.*?)(?: - (.*))?$"
    fits = value.rlike(form)
    rest = F.regexp_extract(value, r"^[^,]+,(.*)$", 1)
    part = lambda k: F.when(fits, F.regexp_extract(value, form, k)).otherwise("")
    return lines.select(F.regexp_extract(value, "^([^,]+)", 1).alias("url"), part(2).alias("title"), part(3).alias("author"), F.when(fits, part(4)).otherwise(rest).alias("note"))


def rejects(spark: SparkSession, path: str) -> DataFrame:
    return parsed_rejects(spark.read.text(path).where("trim(value) <> ''"))


def latest_cache(spark: SparkSession, path: str, hours: float, now: Column | None = None) -> DataFrame:
    """Files that changed within ``hours``, before their bytes are read."""
    files = spark.read.format("binaryFile").load(path)
    return files.where(F.col("modificationTime") > (now if now is not None else F.current_timestamp()) - F.make_dt_interval(hours=F.lit(0), mins=F.lit(0), secs=F.lit(hours * 3600.0)))


# --- books -------------------------------------------------------------------

_CHAPTER = re.compile(r"(?:file|chapter)\d+(?:_u\d+)?\.x?html$")
_META = re.compile(r'<meta\s+name="(chapter\w+)"\s+content="([^"]*)"')
BOOK = "path string, source string, number int, name string, url string, origtitle string, title string, html string"
_BOOK = pa.schema([("path", pa.string()), ("source", pa.string()), ("number", pa.int32()), ("name", pa.string()), ("url", pa.string()), ("origtitle", pa.string()), ("title", pa.string()), ("html", pa.string())])


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def book_chapters(data: bytes) -> tuple[str | None, list[dict]]:
    """Source url of an EPUB's bytes, and its chapters in spine order."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        root = ET.fromstring(book.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in root.iter() if _local(e.tag) == "rootfile")
        package = ET.fromstring(book.read(opf))
        base = opf.rpartition("/")[0]
        items = {e.attrib["id"]: e.attrib["href"] for e in package.iter() if _local(e.tag) == "item"}
        source = next((e.text for e in package.iter() if _local(e.tag) == "source"), None)
        out = []
        for ref in (e.attrib["idref"] for e in package.iter() if _local(e.tag) == "itemref"):
            href = items.get(ref, "")
            if not _CHAPTER.search(href):
                continue
            page = book.read(f"{base}/{href}" if base else href).decode("utf-8", "replace")
            meta = {k: entities.unescape(v) for k, v in _META.findall(page)}
            body = re.search(r"(?is)<body[^>]*>(.*)</body>", page)
            inner = re.sub(r"(?is)^\s*<h[23][^>]*>.*?</h[23]>\s*", "", body[1] if body else page, count=1)
            out.append({"number": len(out) + 1, "name": href, "url": meta.get("chapterurl"), "origtitle": meta.get("chapterorigtitle"), "title": meta.get("chaptertitle"), "html": inner})
        return source, out


def _books(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            source, found = book_chapters(data)
            yield pa.RecordBatch.from_pylist([{"path": path, "source": source, **c} for c in found], schema=_BOOK)


def books(spark: SparkSession, path: str) -> DataFrame:
    """Chapters of EPUB files: path, source, number, name, url, origtitle, title, html."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_books, BOOK)


def book_media(data: bytes) -> list[dict]:
    """Images of an EPUB's bytes by name, with the url that a chapter gives for each."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        root = ET.fromstring(book.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in root.iter() if _local(e.tag) == "rootfile")
        base = opf.rpartition("/")[0]
        items = [(e.attrib["href"], e.attrib["media-type"]) for e in ET.fromstring(book.read(opf)).iter() if _local(e.tag) == "item"]
        at = lambda href: re.sub(r"[^/]+/\.\./", "", f"{base}/{href}" if base else href)
        known = set(book.namelist())
        origins: dict[str, str] = {}
        for href, media in items:
            if media == "application/xhtml+xml" and _CHAPTER.search(href) and at(href) in known:
                page = book.read(at(href)).decode("utf-8", "replace")
                for tag in re.findall(r"<img\b[^>]*>", page):
                    found = {k: entities.unescape(v) for k, v in re.findall(r'\b(src|longdesc)="([^"]*)"', tag)}
                    if {"src", "longdesc"} <= found.keys() and not found["src"].startswith(("data:image", "failedtoload")):
                        origins.setdefault(re.sub(r"[^/]+/\.\./", "", f"{at(href).rpartition('/')[0]}/{found['src']}"), found["longdesc"])
        return [{"name": at(href), "media_type": media, "url": origins.get(at(href)), "data": book.read(at(href))} for href, media in items if media.startswith("image/") and at(href) in known]


MEDIA = "path string, name string, media_type string, url string, data binary"
_MEDIA = pa.schema([("path", pa.string()), ("name", pa.string()), ("media_type", pa.string()), ("url", pa.string()), ("data", pa.binary())])


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_pylist([{"path": path, **m} for m in book_media(data)], schema=_MEDIA)


def book_images(spark: SparkSession, path: str) -> DataFrame:
    """Images of EPUB files: path, name, media_type, url (null if no chapter says where it came from), data."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_images, MEDIA)


def book_counts(chapters: DataFrame, error_marker: str = "chapter-error") -> DataFrame:
    """Chapters of each book, those that failed left out."""
    return chapters.groupBy("path", "source").agg(F.count_if(F.col("url").isNull() | (F.col("url") != error_marker)).alias("chapters"))


def story_urls(chapters: DataFrame, good: str = "^http") -> DataFrame:
    """The first link of each book that looks like a story's."""
    links = chapters.select("path", "number", F.posexplode(urls.from_html(F.col("html"))).alias("place", "url")).where(F.col("url").rlike(good))
    return links.groupBy("path").agg(F.min_by("url", F.struct("number", "place")).alias("url"))


# --- dumps and replies -------------------------------------------------------


def metadata(pages: DataFrame, story: str, markup: str) -> DataFrame:
    """Entries of dumped metadata: story, entry, kind, value, and as date and number."""
    rows = pages.select(story, F.explode(html.metadata_entries(F.col(markup))).alias("m")).select(story, "m.*")
    number = F.replace("value", F.lit(","), F.lit("")).try_cast("bigint")
    return rows.withColumns({"as_date": F.when(F.col("kind") == "datetime", dates.iso_loaded(F.col("value"))), "as_int": F.when(F.col("kind") == "int", number)})


def replies(pages: DataFrame, body: str, schema: str) -> DataFrame:
    """JSON bodies as columns; what can't be read is null."""
    return pages.withColumn("_r", F.from_json(body, schema)).select("*", "_r.*").drop("_r")


def page_numbers(first: DataFrame, last: str) -> DataFrame:
    """A row for each page 1..last."""
    return first.withColumn("page", F.explode(F.sequence(F.lit(1), F.greatest(F.col(last).cast("int"), F.lit(1)))))


def plain_text(data: Column, encodings: tuple[str, ...] = ("utf-8", "windows-1252")) -> Column:
    """Bytes by the first encoding that fits."""
    return text.decode_bytes(data, encodings[-1])


# --- browser caches ----------------------------------------------------------

_ENTRY = pa.struct([("key", pa.string()), ("headers", pa.string()), ("body", pa.binary())])


def simple_entry(data: bytes) -> dict | None:
    """Key, headers and body of an entry file of the simple cache, stream 1 after the key."""
    if len(data) < 24 or struct.unpack_from("<Q", data)[0] != 0xFCFB6D1BA7725C30:
        return None
    size = struct.unpack_from("<I", data, 12)[0]
    key = data[24 : 24 + size].decode("utf-8", "replace")
    ends = [m.start() for m in re.finditer(re.escape(struct.pack("<Q", 0xF4FA6F45970D41D8)), data)]
    if not ends:
        return None
    body = data[24 + size : ends[0]]
    rest = data[ends[0] + 24 : ends[1]] if len(ends) > 1 else b""
    return {"key": key, "headers": rest.decode("latin-1"), "body": body}


def firefox_entry(data: bytes) -> dict | None:
    """Key, headers and body of an entry file of the second Firefox cache."""
    if len(data) < 4:
        return None
    at = struct.unpack_from(">I", data, len(data) - 4)[0]
    chunks = (at + (1 << 18) - 1) // (1 << 18)
    head = at + 4 + 2 * chunks
    if head + 32 > len(data):
        return None
    key_size = struct.unpack_from(">I", data, head + 24)[0]
    start = head + (32 if struct.unpack_from(">I", data, head)[0] >= 2 else 28)
    key = data[start : start + key_size].decode("utf-8", "replace")
    return {"key": "http" + key.rpartition(":http")[2] if ":http" in key else key, "headers": data[start + key_size + 1 : -4].decode("latin-1"), "body": data[:at]}


#: Cache formats in the order in which a file is tried.
CACHES = (simple_entry, firefox_entry)


def _cache(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        out = []
        for data in batch.to_pylist():
            found = None
            for read in CACHES:
                found = found or (read(data) if data else None)
            out.append(found)
        yield pa.array(out, _ENTRY)


_cache_entry = lazy(_cache, "struct<key:string,headers:string,body:binary>")


def cached_pages(spark: SparkSession, path: str) -> DataFrame:
    """Entries of browser cache files: path, ts, key, headers, body."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("ts"), _cache_entry(F.col("content")).alias("e"))
    return files.where("e is not null").select("path", "ts", "e.*")


# --- synthetic stories -------------------------------------------------------


def test_stories(spark: SparkSession, first: int, last: int) -> DataFrame:
    """Invented stories by id: status by parity, a series below 20, a language up to 29."""
    ids = spark.range(first, last + 1).withColumnRenamed("id", "story_id")
    key = F.col("story_id").cast("string")
    return ids.select(
        "story_id",
        F.concat(F.lit("Test Story "), key).alias("title"),
        F.when(F.col("story_id") % 2 == 0, "Completed").otherwise("In-Progress").alias("status"),
        F.when(F.col("story_id") < 20, F.concat(F.lit("Test Series ["), key, F.lit("]"))).alias("series"),
        F.when(F.col("story_id").between(20, 29), "Russian").otherwise("English").alias("language"),
        F.transform(F.sequence(F.lit(1), F.when(F.col("story_id") == 673, 20).otherwise(1)), lambda i: F.concat(F.lit("Author "), i.cast("string"))).alias("author"),
    )
