"""Queries that write files and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyflow.functions import text
from storyflow.plans.registry import query
from storyflow.shared import fresh_path, table
from storyflow.sinks import books
from storyflow.sources import readers

_PAGE = "'<p>' || replace(replace(replace(text, '&', '&amp;'), '>', '&gt;'), '<', '&lt;') || '</p>'"


def _shelf(spark, sf):
    """Conversations as stories, their turns as chapters."""
    turns = table(spark, sf, "conversations").where("text <> ''")
    stories = turns.groupBy(F.col("conv_id").alias("story")).agg(F.sort_array(F.collect_set("role")).alias("author"))
    stories = stories.withColumns({"title": F.concat(F.lit("Talk & "), "story"), "url": F.concat(F.lit("http://talks/?id="), "story", F.lit("&v=1"))})
    url = F.concat(F.lit("http://talks/?id="), "conv_id", F.lit("&turn="), "turn")
    chapters = turns.select(F.col("conv_id").alias("story"), (F.col("turn") + 1).cast("int").alias("number"), url.alias("url"), F.concat("role", F.lit(" <1>")).alias("origtitle"), F.concat("role", F.lit(" <1>")).alias("title"), F.concat(F.lit("<p>"), text.escape_xml(F.col("text")), F.lit("</p>")).alias("html"))
    return stories, chapters, F.concat((F.col("story") % 7).cast("string"), F.lit("/"), F.col("story").cast("string"))


@query(f"""select 'http://talks/?id=' || conv_id || '&v=1' as source, cast(row_number() over (partition by conv_id order by turn) as int) as number, 'OEBPS/file' || lpad(cast(turn + 1 as varchar), 4, '0') || '.xhtml' as name,
  'http://talks/?id=' || conv_id || '&turn=' || turn as url, role || ' <1>' as origtitle, role || ' <1>' as title, {_PAGE} as html from conversations where text <> ''""")
def books_written_and_read(spark, sf):
    stories, chapters, name = _shelf(spark, sf)
    path = fresh_path(spark, "books")
    books.save(stories, chapters, path, F.concat(name, F.lit(".epub")))
    return readers.books(spark, f"{path}/*/*.epub").drop("path")


@query(f"""select conv_id as story, cast(count(*) as bigint) as chapters, sha256(string_agg('<h3>' || role || ' &lt;1&gt;</h3>' || chr(10) || {_PAGE}, chr(10) order by turn)) as body_sha256
  from conversations where text <> '' group by conv_id""")
def pages_written_and_read(spark, sf):
    stories, chapters, name = _shelf(spark, sf)
    path = fresh_path(spark, "pages")
    books.save_pages(stories, chapters, path, F.concat(name, F.lit(".html")))
    found = spark.read.format("binaryFile").load(f"{path}/*/*.html").select("path", F.col("content").cast("string").alias("page"))
    body = F.regexp_extract("page", r"(?s)<br />\n(<h3>.*)\n</body>", 1)
    return found.select(F.regexp_extract("path", r"/(\d+)\.html$", 1).cast("bigint").alias("story"), F.regexp_count("page", F.lit("<h3>")).cast("bigint").alias("chapters"), F.sha2(body, 256).alias("body_sha256"))
