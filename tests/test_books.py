import datetime
import io
import os
import xml.etree.ElementTree as ET
import zipfile

import pytest
from pyspark.sql import functions as F

from storyflow.operators import listing
from storyflow.sinks import books, files
from storyflow.sources import readers

STORIES = "story bigint, title string, author array<string>, url string, site string, updated timestamp, series string, description string, subjects array<string>, published date"
CHAPTERS = "story bigint, number int, url string, origtitle string, title string, html string"


def tables(spark):
    when = datetime.datetime(2020, 1, 2, 3, 4, 5)
    stories = spark.createDataFrame(
        [(1, 'A "first" <one> & more', ["Ann", "Bob & Co"], "http://s/1?a=1&b=2", "s.com", when, "Saga [2]", "Of\x01 <things>", ["x", "", "y & z"], datetime.date(2019, 1, 1)), (2, "Short", None, "http://s/2", None, when, None, None, None, None)],
        STORIES,
    )
    chapters = spark.createDataFrame(
        [(1, n, f"http://s/1/{n}?x=1&y={n}", f"Part {n}", f"(new) {n}. Part {n}" if n == 3 else f"Part {n}", f'<p>text & {n} <img src="images/i{n}.png" longdesc="http://i/{n}?q=1&amp;r=2"/></p>') for n in range(1, 4)]
        + [(1, 4, "http://s/1/4", "Gone", "Gone", ""), (2, 1, "http://s/2/1", "Only", "Only", "<p>one</p>")],
        CHAPTERS,
    )
    images = spark.createDataFrame([(1, "images/i1.png", "image/png", "http://i/1", b"one"), (1, "images/cover.jpg", "image/jpeg", None, b"cover"), (1, "images/i2.png", "image/png", "http://i/2", b"two")], "story bigint, name string, media_type string, url string, data binary")
    return stories, chapters, images


def test_written_read_and_merged_nothing_is_new(spark, tmp_path):
    stories, chapters, images = tables(spark)
    name = F.concat(F.lit("by/"), F.col("story").cast("string"), F.lit(".epub"))
    logs = spark.createDataFrame([(1, "<div>log</div>")], "story bigint, log string")
    told = books.save(stories, chapters, f"file://{tmp_path}/out", name, images, logs)
    assert told["files"] == 2 and told["kept"] == 0
    assert not [d for d in os.listdir(tmp_path / "out") if d.startswith("_writing")]
    old = readers.books(spark, f"file://{tmp_path}/out/by/*.epub")
    got = [tuple(r) for r in old.orderBy("source", "number").select("source", "number", "url", "origtitle", "title", "html").collect()]
    want = [tuple(r) for r in chapters.join(stories.select("story", F.col("url").alias("source")), "story").where("html <> ''").orderBy("source", "number").select("source", "number", "url", "origtitle", "title", "html").collect()]
    assert got == want
    new = chapters.where("html <> ''").select("url", "number", "origtitle")
    merged = listing.merged(new, old.withColumn("pos", F.col("number")))
    # What was marked as new is still marked; nothing has to be fetched.
    assert sorted((r.url, r.fetch, r.is_new) for r in merged.collect()) == sorted((r.url, False, r.number == 3 and "/1/" in r.url) for r in new.collect())
    found = {r.name: (r.media_type, r.url, bytes(r.data)) for r in readers.book_images(spark, f"file://{tmp_path}/out/by/1.epub").collect()}
    assert found == {"OEBPS/images/i1.png": ("image/png", "http://i/1?q=1&r=2", b"one"), "OEBPS/images/cover.jpg": ("image/jpeg", None, b"cover"), "OEBPS/images/i2.png": ("image/png", "http://i/2?q=1&r=2", b"two")}


def test_package_is_well_formed(spark, tmp_path):
    stories, chapters, images = tables(spark)
    books.save(stories, chapters, f"file://{tmp_path}", F.concat(F.col("story").cast("string"), F.lit(".epub")), images)
    with zipfile.ZipFile(io.BytesIO((tmp_path / "1.epub").read_bytes())) as book:
        assert book.infolist()[0].filename == "mimetype" and book.infolist()[0].compress_type == zipfile.ZIP_STORED
        package = ET.fromstring(book.read("content.opf"))
        local = lambda e: e.tag.rpartition("}")[2]
        texts = {}
        for e in package[0]:
            texts.setdefault(local(e), []).append(e.text)
        assert texts["title"] == ['A "first" <one> & more'] and texts["creator"] == ["Ann", "Bob & Co"] and texts["source"] == ["http://s/1?a=1&b=2"]
        assert texts["date"] == ["2019-01-01", "2020-01-02"] and texts["subject"] == ["x", "y & z"] and texts["language"] == ["en"] and texts["description"] == ["Of <things>"]
        metas = {e.attrib["name"]: e.attrib["content"] for e in package[0] if local(e) == "meta"}
        items = {e.attrib["id"]: e.attrib["href"] for e in package.iter() if local(e) == "item"}
        assert metas["calibre:series"] == "Saga" and metas["calibre:series_index"] == "2.00" and items[metas["cover"]] == "OEBPS/images/cover.jpg"
        assert set(items.values()) | {"mimetype", "META-INF/container.xml", "content.opf"} == set(book.namelist())
        assert [e.attrib["idref"] for e in package.iter() if local(e) == "itemref"] == ["cover", "title_page", "toc_page", "file0001", "file0002", "file0003"]
        points = [e for e in ET.fromstring(book.read("toc.ncx")).iter() if local(e) == "navPoint"]
        assert [p[0][0].text for p in points] == ["Title Page", "Table of Contents", "Part 1", "Part 2", "(new) 3. Part 3"]
    with zipfile.ZipFile(io.BytesIO((tmp_path / "2.epub").read_bytes())) as book:
        assert "OEBPS/toc_page.xhtml" not in book.namelist()


def test_only_older_files_are_replaced(spark, tmp_path):
    path, day = f"file://{tmp_path}/f", datetime.datetime(2020, 5, 6, 7, 8, 9, tzinfo=datetime.timezone.utc)
    rows = lambda text, *when: spark.createDataFrame([(f"{i}.txt", text.encode(), w) for i, w in enumerate(when)], "name string, data binary, changed timestamp")
    assert files.save(rows("old", day, day, None), path)["files"] == 3
    for i in range(3):
        os.utime(tmp_path / "f" / f"{i}.txt", (day.timestamp(), day.timestamp()))
    second = datetime.timedelta(seconds=1)
    told = files.save(rows("new", day - second, day + second, None), path)
    assert (told["files"], told["kept"]) == (2, 1)
    assert [(tmp_path / "f" / f"{i}.txt").read_text() for i in range(3)] == ["old", "new", "new"]
    assert files.save(rows("forced", day - second), path, force=True)["files"] == 1
    assert files.outdated(datetime.datetime(2020, 5, 6, 23), datetime.datetime(2020, 5, 6)) and not files.outdated(datetime.datetime(2020, 5, 7), datetime.datetime(2020, 5, 6))


def test_a_failed_run_leaves_no_partial_file(spark, tmp_path):
    bad = spark.createDataFrame([("a/ok.txt", b"whole", None), ("../out.txt", b"x", None)], "name string, data binary, changed timestamp").coalesce(1)
    with pytest.raises(Exception, match="not a file name"):
        files.save(bad, f"file://{tmp_path}/f")
    left = [os.path.join(d, n) for d, _, names in os.walk(tmp_path) for n in names]
    assert left == [str(tmp_path / "f/a/ok.txt")] and not (tmp_path / "out.txt").exists()
    assert files.save(spark.createDataFrame([], "name string, data binary, changed timestamp"), f"file://{tmp_path}/g") == {"files": 0, "bytes": 0, "kept": 0}


def test_pages_as_files(spark, tmp_path):
    stories, chapters, _ = tables(spark)
    books.save_pages(stories, chapters, f"file://{tmp_path}", F.concat(F.col("story").cast("string"), F.lit(".html")))
    page = (tmp_path / "1.html").read_text()
    assert "<title>A &quot;first&quot; &lt;one&gt; &amp; more</title>" in page and page.count("<h3>") == 3 and "<p>one</p>" in (tmp_path / "2.html").read_text()
