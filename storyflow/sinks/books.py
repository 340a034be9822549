"""EPUB files from tables: a manifest, a spine and contents as rows, zipped a book at a time.

``stories``: story, title and, where they are there, author (array), langcode,
description, subjects (array), site, url, published, created, updated, series.
``chapters``: story, number, url, origtitle, title, html; one without text is left
out. ``images``: story, name, media_type, url, data; a name with ``cover`` is the
cover. ``logs``: story, log. A book written here reads back by
``readers.books`` and ``readers.book_images`` with its source, chapter urls and
original titles, so that merging it with the same listing finds nothing new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyflow.functions import text
from storyflow.sinks import files, render

#: Media types and names of the format.
XHTML, NCX, OPF = "application/xhtml+xml", "application/x-dtbncx+xml", "application/oebps-package+xml"
STYLE = "body { margin: 5%; }\n.center { text-align: center; }\n"
ENTRIES = (("title", "Title"), ("author", "Author"), ("series", "Series"), ("site", "Publisher"), ("url", "Story URL"), ("description", "Summary"))


def _xml(value: Column) -> Column:
    """Text for XML, quotes too; characters that XML doesn't allow go."""
    kept = F.regexp_replace(value.cast("string"), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")
    return F.replace(text.escape_xml(kept), F.lit('"'), F.lit("&quot;"))


def _with(stories: DataFrame) -> DataFrame:
    """``stories`` with every column that a book may have."""
    kinds = {"author": "array<string>", "subjects": "array<string>", "published": "date", "created": "date", "updated": "timestamp"}
    missing = {c: F.lit(None).cast(kinds.get(c, "string")) for c in ("author", "langcode", "description", "subjects", "site", "url", "published", "created", "updated", "series") if c not in stories.columns}
    return stories.withColumns(missing)


def manifest(stories: DataFrame, chapters: DataFrame, images: DataFrame | None = None, logs: DataFrame | None = None) -> DataFrame:
    """Files of each book: story, seq, id, href, media_type, label (of those in the contents), spine (whether it is read through)."""

    def rows(df: DataFrame, seq, id_, href, media: str | Column, label=None, spine: bool = False) -> DataFrame:
        whole = [F.lit(x) if not isinstance(x, Column) else x for x in (seq, id_, href, media, label, spine)]
        return df.select("story", *[c.cast(k).alias(n) for c, k, n in zip(whole, ("bigint", "string", "string", "string", "string", "boolean"), ("seq", "id", "href", "media_type", "label", "spine"))])

    own = stories.select("story")
    shown = chapters.where("html is not null and html <> ''")
    several = shown.groupBy("story").count().where("count > 1")
    index = F.lpad(F.col("number").cast("string"), 4, "0")
    parts = [
        rows(own, 0, "ncx", "toc.ncx", NCX),
        rows(own, 1, "style", "OEBPS/stylesheet.css", "text/css"),
        rows(own, 3, "title_page", "OEBPS/title_page.xhtml", XHTML, "Title Page", True),
        rows(own.join(several, "story", "semi"), 4, "toc_page", "OEBPS/toc_page.xhtml", XHTML, "Table of Contents", True),
        rows(shown, F.col("number").cast("bigint") + 1_000, F.concat(F.lit("file"), index), F.concat(F.lit("OEBPS/file"), index, F.lit(".xhtml")), XHTML, F.col("title"), True),
    ]
    if logs is not None:
        parts.append(rows(logs.where("log <> ''"), 5, "log_page", "OEBPS/log_page.xhtml", XHTML, "Update Log", True))
    if images is not None:
        place = F.row_number().over(Window.partitionBy("story").orderBy("name"))
        parts.append(rows(images.withColumn("_n", place), F.col("_n") + 10_000_000, F.concat(F.lit("image"), F.lpad((F.col("_n") - 1).cast("string"), 4, "0")), F.concat(F.lit("OEBPS/"), "name"), F.col("media_type")))
        parts.append(rows(images.where("name like '%cover%'").select("story").distinct(), 2, "cover", "OEBPS/cover.xhtml", XHTML, None, True))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _listed(line: Column, seq: str = "seq") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("o"), line.alias("t")))), lambda r: r["t"]), "\n")


def _tag(name: str, value: Column, attributes: str = "") -> Column:
    """An element, or null where there is no value."""
    return F.when(value.cast("string") != "", F.concat(F.lit(f"<dc:{name}{attributes}>"), _xml(value), F.lit(f"</dc:{name}>")))


def _each(name: str, values: str, attributes: str = "") -> Column:
    return F.array_join(F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(f"<dc:{name}{attributes}>"), _xml(x), F.lit(f"</dc:{name}>"))), "\n")


def identifier() -> Column:
    return F.concat_ws("-", F.lit("book"), F.coalesce("site", F.lit("")), F.col("story").cast("string"))


def packages(stories: DataFrame, listed: DataFrame) -> DataFrame:
    """story, opf, ncx: the package and the contents of each book, from its manifest."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    series = F.regexp_extract("series", r"^(.*) \[[^\]]*\]$", 1)
    place = F.regexp_extract("series", r" \[([0-9.]+)\]$", 1)
    lines = [
        F.concat(F.lit('<dc:identifier id="book-id">'), _xml(identifier()), F.lit("</dc:identifier>")),
        _tag("title", F.col("title"), ' id="id"'),
        _each("creator", "author", ' opf:role="aut"'),
        _tag("language", F.coalesce(F.nullif("langcode", F.lit("")), F.lit("en"))),
        _tag("date", day("published"), ' opf:event="publication"'),
        _tag("date", day("created"), ' opf:event="creation"'),
        _tag("date", day("updated"), ' opf:event="modification"'),
        F.when(F.col("series") != "", F.concat(F.lit('<meta name="calibre:series" content="'), _xml(F.when(series != "", series).otherwise(F.col("series"))), F.lit('"/>\n<meta name="calibre:series_index" content="'), F.format_string("%.2f", F.coalesce(place.try_cast("double"), F.lit(0.0))), F.lit('"/>'))),
        _tag("description", F.col("description")),
        _each("subject", "subjects"),
        _tag("publisher", F.col("site")),
        _tag("identifier", F.col("url"), ' opf:scheme="URL"'),
        _tag("source", F.col("url")),
    ]
    item = F.concat(F.lit('<item id="'), F.col("id"), F.lit('" href="'), _xml(F.col("href")), F.lit('" media-type="'), F.col("media_type"), F.lit('"/>'))
    point = F.concat(F.lit('<navPoint id="'), F.col("id"), F.lit('" playOrder="'), F.col("seq").cast("string"), F.lit('"><navLabel><text>'), _xml(F.col("label")), F.lit('</text></navLabel><content src="'), F.col("href"), F.lit('"/></navPoint>'))
    made = listed.groupBy("story").agg(
        _listed(item).alias("_items"),
        _listed(F.when(F.col("spine"), F.concat(F.lit('<itemref idref="'), F.col("id"), F.lit('"/>')))).alias("_spine"),
        _listed(F.when(F.col("label").isNotNull(), point)).alias("_points"),
        F.max(F.when(F.col("id") == "cover", F.lit(True))).alias("_covered"),
        F.min(F.when(F.col("href").like("%cover%") & F.startswith(F.col("id"), F.lit("image")), F.col("id"))).alias("_cover"),
    )
    metadata = F.concat(F.array_join(F.array_compact(F.array(*[F.nullif(x, F.lit("")) for x in lines])), "\n"), F.when(F.col("_covered"), F.concat(F.lit('\n<meta name="cover" content="'), F.col("_cover"), F.lit('"/>'))).otherwise(""))
    opf = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<package version="2.0" xmlns="http://www.idpf.org/2007/opf" unique-identifier="book-id">\n<metadata xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf">\n'),
        metadata, F.lit("\n</metadata>\n<manifest>\n"), F.col("_items"), F.lit('\n</manifest>\n<spine toc="ncx">\n'), F.col("_spine"), F.lit("\n</spine>"),
        F.when(F.col("_covered"), '\n<guide><reference type="cover" title="Cover" href="OEBPS/cover.xhtml"/></guide>').otherwise(""), F.lit("\n</package>\n"),
    )
    ncx = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<ncx version="2005-1" xmlns="http://www.daisy.org/z3986/2005/ncx/">\n<head><meta name="dtb:uid" content="'), _xml(identifier()), F.lit('"/><meta name="dtb:depth" content="1"/></head>\n<docTitle><text>'),
        _xml(F.coalesce("title", F.lit(""))), F.lit("</text></docTitle>\n<navMap>\n"), F.col("_points"), F.lit("\n</navMap>\n</ncx>\n"),
    )
    return _with(stories).join(made, "story").select("story", opf.alias("opf"), ncx.alias("ncx"), F.col("_cover").alias("cover"))


def _page(title: Column, head: Column, body: Column) -> Column:
    return F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml">\n<head>\n<title>'), _xml(title), F.lit('</title>\n<link href="stylesheet.css" type="text/css" rel="stylesheet"/>\n'), head, F.lit("</head>\n<body>\n"), body, F.lit("</body>\n</html>\n"))


def chapter_pages(chapters: DataFrame) -> DataFrame:
    """story, number, page: a chapter's file with its url and titles in the head."""
    meta = F.concat(*[F.concat(F.lit(f'<meta name="{name}" content="'), _xml(F.coalesce(value, F.lit(""))), F.lit('"/>\n')) for name, value in (("chapterurl", F.col("url")), ("chapterorigtitle", F.coalesce("origtitle", "title")), ("chaptertitle", F.col("title")))])
    title = F.coalesce("title", F.lit(""))
    return chapters.where("html is not null and html <> ''").select("story", "number", _page(title, meta, F.concat(F.lit("<h3>"), _xml(title), F.lit("</h3>\n"), F.col("html"))).alias("page"))


def entries(stories: DataFrame, chapters: DataFrame, images: DataFrame | None = None, logs: DataFrame | None = None) -> DataFrame:
    """Every file of every book: story, seq, path, content (binary); the first one names the format."""
    listed = manifest(stories, chapters, images, logs)
    whole = _with(stories)
    made = packages(stories, listed)
    container = F.lit(f'<?xml version="1.0" encoding="utf-8"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="content.opf" media-type="{OPF}"/></rootfiles></container>\n')

    def rows(df: DataFrame, seq, path, content) -> DataFrame:
        return df.select("story", (F.lit(seq) if not isinstance(seq, Column) else seq).cast("bigint").alias("seq"), (F.lit(path) if isinstance(path, str) else path).alias("path"), content.cast("binary").alias("content"))

    flat = whole.select("story", *[(F.array_join(c, ", ") if c == "author" else F.col(c)).alias(c) for c, _ in ENTRIES]).withColumns({c: _xml(F.col(c)) for c, _ in ENTRIES})
    title = render.title_page(flat, "story", list(ENTRIES)).join(whole.select("story", "title"), "story")
    contents = render.contents(chapters, "story", "number", "title", "html")
    index = F.lpad(F.col("number").cast("string"), 4, "0")
    parts = [
        rows(whole, 0, "mimetype", F.lit("application/epub+zip")),
        rows(whole, 1, "META-INF/container.xml", container),
        rows(made, 2, "content.opf", F.col("opf")),
        rows(made, 3, "toc.ncx", F.col("ncx")),
        rows(whole, 4, "OEBPS/stylesheet.css", F.lit(STYLE)),
        rows(title, 5, "OEBPS/title_page.xhtml", _page(F.coalesce("title", F.lit("")), F.lit(""), F.concat(F.col("page"), F.lit("\n")))),
        rows(contents, 6, "OEBPS/toc_page.xhtml", _page(F.lit("Table of Contents"), F.lit(""), F.concat(F.col("toc"), F.lit("\n")))),
        rows(chapter_pages(chapters), F.col("number") + 1_000, F.concat(F.lit("OEBPS/file"), index, F.lit(".xhtml")), F.col("page")),
    ]
    if logs is not None:
        parts.append(rows(logs.where("log <> ''"), 7, "OEBPS/log_page.xhtml", _page(F.lit("Update Log"), F.lit(""), F.col("log"))))
    if images is not None:
        parts.append(rows(images, 10_000_000, F.concat(F.lit("OEBPS/"), "name"), F.col("data")))
        cover = images.where("name like '%cover%'").groupBy("story").agg(F.min("name").alias("name"))
        parts.append(rows(cover, 8, "OEBPS/cover.xhtml", _page(F.lit("Cover"), F.lit(""), F.concat(F.lit('<div><img src="'), _xml(F.col("name")), F.lit('" alt="cover"/></div>\n')))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def files_of(stories: DataFrame, chapters: DataFrame, name: Column, images: DataFrame | None = None, logs: DataFrame | None = None) -> DataFrame:
    """(name, data, changed) of each book, for :func:`storyflow.sinks.files.save`. One book is zipped in one task."""
    zipped = render.zipped(entries(stories, chapters, images, logs), "story")
    named = _with(stories).select("story", name.alias("name"), F.col("updated").cast("timestamp").alias("changed"))
    return zipped.join(named, "story").select("name", "data", "changed")


def save(stories: DataFrame, chapters: DataFrame, path: str, name: Column, images: DataFrame | None = None, logs: DataFrame | None = None, force: bool = False) -> dict:
    """Write a book file for each story; a file newer than the story's ``updated`` stays unless ``force``."""
    return files.save(files_of(stories, chapters, name, images, logs), path, force)


def save_pages(stories: DataFrame, chapters: DataFrame, path: str, name: Column, force: bool = False) -> dict:
    """Write an HTML file for each story: title page, contents and chapters in one page."""
    whole = _with(stories)
    flat = whole.select("story", *[(F.array_join(c, ", ") if c == "author" else F.col(c)).alias(c) for c, _ in ENTRIES]).withColumns({c: _xml(F.col(c)) for c, _ in ENTRIES})
    shown = chapters.where("html is not null and html <> ''").withColumn("title", _xml(F.coalesce("title", F.lit(""))))
    bodies = render.html_bodies(shown, "story", "number", "title", "html")
    made = render.title_page(flat, "story", list(ENTRIES)).join(bodies, "story", "left").join(whole.select("story", "title", "updated"), "story")
    page = _page(F.coalesce("title", F.lit("")), F.lit('<meta charset="utf-8"/>\n'), F.concat(F.col("page"), F.lit("\n"), F.coalesce("body", F.lit("")), F.lit("\n")))
    rows = made.select(name.alias("name"), page.cast("binary").alias("data"), F.col("updated").cast("timestamp").alias("changed"))
    return files.save(rows, path, force)
