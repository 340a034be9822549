"""Title pages, contents, dumps and files of stories, as rows."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyflow.functions import text


def _ordered(rows: Column, by: str = "\n") -> Column:
    """Texts of collected struct(order, text), in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda r: r["t"]), by)


def title_page(stories: DataFrame, story: str, entries: list[tuple[str, str]], wide: tuple[str, ...] = (), show_empty: tuple[str, ...] = ()) -> DataFrame:
    """``page``: a line for each configured entry that is not empty, in order."""
    lines = []
    for name, label in entries:
        value = F.col(name).cast("string")
        line = F.concat(F.lit(f"<b>{label}:</b>" + ("<br />" if name in wide else " ")), F.coalesce(value, F.lit("")), F.lit("<br />"))
        lines.append(line if name in show_empty else F.when(value != "", line))
    return stories.select(story, F.array_join(F.array(*lines), "\n").alias("page"))


def contents(chapters: DataFrame, story: str, number: str, title: str, html: str, always: bool = False) -> DataFrame:
    """``toc`` of stories with several chapters; chapters without text are left out."""
    shown = chapters.where(F.col(html).isNotNull() & (F.col(html) != ""))
    line = F.concat(F.lit('<a href="file'), F.lpad(F.col(number).cast("string"), 4, "0"), F.lit('.xhtml">'), F.col(title), F.lit("</a><br />"))
    made = shown.groupBy(story).agg(_ordered(F.struct(F.col(number).alias("o"), line.alias("t"))).alias("toc"), F.count("*").alias("_n"))
    return (made if always else made.where("_n > 1")).select(story, "toc")


def _kind(kind: str) -> str:
    if kind.startswith("array"):
        return "list"
    return {"timestamp": "datetime", "timestamp_ntz": "datetime", "date": "datetime", "int": "int", "bigint": "int"}.get(kind, "string")


def metadata_dump(stories: DataFrame, story: str, skip: tuple[str, ...] = ("output_css",)) -> DataFrame:
    """``dump``: entries by name with their kind; lists without nulls and blanks."""
    parts = []
    for name, kind in sorted(stories.dtypes):
        if name == story or name in skip:
            continue
        shown = _kind(kind)
        value = F.array_join(F.filter(name, lambda x: x != ""), ", ") if shown == "list" else F.coalesce(F.col(name).cast("string"), F.lit(""))
        parts.append(F.concat(F.lit(f'<p><b>{name}:</b><span class="{shown}" id="{name}">'), value, F.lit("</span></p>")))
    return stories.select(story, F.array_join(F.array(*parts), "\n").alias("dump"))


def json_metadata(stories: DataFrame, chapters: DataFrame, story: str, number: str) -> DataFrame:
    """``json``: all metadata with ``zchapters``, numbered chapters in order; keys sorted."""
    fields = sorted(c for c in chapters.columns if c not in (story, number))
    listed = chapters.groupBy(story).agg(F.array_sort(F.collect_list(F.struct(number, *fields))).alias("zchapters"))
    joined = stories.join(listed, story, "left")
    return joined.select(story, F.to_json(F.struct(*sorted(c for c in joined.columns if c != story))).alias("json"))


def html_bodies(chapters: DataFrame, story: str, position: str, title: str, html: str) -> DataFrame:
    """``body``: chapters of a story in order, under their titles; ``n`` of them."""
    part = F.concat(F.lit("<h3>"), F.col(title), F.lit("</h3>\n"), F.col(html))
    return chapters.groupBy(story).agg(_ordered(F.struct(F.col(position).alias("o"), part.alias("t"))).alias("body"), F.count("*").alias("n"))


def text_bodies(chapters: DataFrame, story: str, position: str, title: str, html: str, width: int = 78, dos: bool = False) -> DataFrame:
    """The same as plain text, wrapped."""
    plain = text.line_ends(text.wrapped(width)(text.html_to_text(F.col(html))), dos)
    rows = chapters.select(story, position, F.concat(F.lit("\n\n\t"), F.col(title), F.lit("\n\n"), plain).alias("_t"))
    return rows.groupBy(story).agg(_ordered(F.struct(F.col(position).alias("o"), F.col("_t").alias("t")), "\n").alias("body"), F.count("*").alias("n"))


def epub_entries(stories: DataFrame, chapters: DataFrame, story: str, number: str, title: str, html: str) -> DataFrame:
    """Files of a book: story, seq, path, media_type, content; the mimetype first."""
    page = F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml"><head><title>'), text.escape_xml(F.col(title)), F.lit("</title></head><body><h3>"), text.escape_xml(F.col(title)), F.lit("</h3>\n"), F.col(html), F.lit("</body></html>"))
    path = F.concat(F.lit("OEBPS/file"), F.lpad(F.col(number).cast("string"), 4, "0"), F.lit(".xhtml"))
    files = chapters.select(F.col(story), (F.col(number) + 10).cast("bigint").alias("seq"), path.alias("path"), F.lit("application/xhtml+xml").alias("media_type"), page.alias("content"))
    item = F.concat(F.lit('<item id="f'), F.col(number).cast("string"), F.lit('" href="file'), F.lpad(F.col(number).cast("string"), 4, "0"), F.lit('.xhtml" media-type="application/xhtml+xml"/>'))
    manifests = chapters.groupBy(story).agg(_ordered(F.struct(F.col(number).alias("o"), item.alias("t"))).alias("_items"), _ordered(F.struct(F.col(number).alias("o"), F.concat(F.lit('<itemref idref="f'), F.col(number).cast("string"), F.lit('"/>')).alias("t"))).alias("_spine"))
    opf = F.concat(F.lit('<package version="2.0" xmlns="http://www.idpf.org/2007/opf"><manifest>'), "_items", F.lit("</manifest><spine>"), "_spine", F.lit("</spine></package>"))
    fixed = stories.join(manifests, story).select(F.col(story), F.explode(F.array(*(F.struct(F.lit(s).cast("bigint").alias("seq"), F.lit(p).alias("path"), F.lit(m).alias("media_type"), c.alias("content")) for s, p, m, c in ((0, "mimetype", "", F.lit("application/epub+zip")), (1, "META-INF/container.xml", "text/xml", F.lit('<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')), (2, "OEBPS/content.opf", "application/oebps-package+xml", opf))))).alias("e"))
    return fixed.select(story, "e.*").unionByName(files)


def zipped(entries: DataFrame, story: str) -> DataFrame:
    """The bytes of each book's zip; the first file is stored, others packed."""

    def one(key, table):
        rows = sorted(zip(table.column("seq").to_pylist(), table.column("path").to_pylist(), table.column("content").to_pylist()))
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as book:
            for seq, path, content in rows:
                info = zipfile.ZipInfo(path)
                book.writestr(info, content or "", zipfile.ZIP_STORED if seq == 0 else zipfile.ZIP_DEFLATED)
        import pyarrow as pa

        return pa.table({story: pa.array([key[0].as_py()], table.schema.field(story).type), "data": pa.array([data.getvalue()], pa.binary())})

    kind = dict(entries.dtypes)[story]
    return entries.groupBy(story).applyInArrow(one, f"{story} {kind}, data binary")


def log_page(changes: DataFrame, story: str, version: str, entry: str, value: str) -> DataFrame:
    """``log``: a block for each version, newest first, of its changed entries by name."""
    line = F.concat(F.lit("<b>"), F.col(entry), F.lit(":</b> "), F.coalesce(F.col(value).cast("string"), F.lit("")), F.lit("<br />"))
    blocks = changes.groupBy(story, version).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("_b"))
    whole = F.concat(F.lit('<div class="log" id="'), F.col(version).cast("string"), F.lit('">\n'), "_b", F.lit("\n</div>"))
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct(F.col(version).alias("o"), whole.alias("t")))))
    return blocks.groupBy(story).agg(F.array_join(F.transform(ordered, lambda r: r["t"]), "\n").alias("log"))


def without_new_marks(chapters: DataFrame, title: str = "title", original: str = "origtitle") -> DataFrame:
    """Chapters under their original titles again."""
    return chapters.withColumn(title, F.coalesce(original, title))


#: Output formats and what makes their rows.
FORMATS = {"html": html_bodies, "txt": text_bodies, "epub": epub_entries}


def writer(name: str):
    if name not in FORMATS:
        raise ValueError(f"no such format: {name}")
    return FORMATS[name]
