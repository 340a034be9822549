"""Entries and chapters of pages by a table of site patterns.

What differs between sites is data: a row (site, entry, pattern, many) for each
metadata entry, and (site, url_pattern, title_pattern) for chapter lists. Rules
are joined by site, so one plan serves all sites, and adding one changes no code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyflow.functions import text
from storyflow.operators.lookups import small

RULES = "site string, entry string, pattern string, many boolean"
CHAPTERS = "site string, url_pattern string, title_pattern string"


def entries(pages: DataFrame, rules: DataFrame, page: str = "page_id", site: str = "site", html: str = "html", shown: Callable[[Column], Column] = text.strip_html) -> DataFrame:
    """(page, entry, pos, value) of all matches; the first only unless ``many``. Blank values go.

    ``shown`` makes a value of what was found.
    """
    joined = pages.select(page, F.col(site).alias("site"), F.col(html).alias("_html")).join(small(rules), "site")
    found = F.regexp_extract_all("_html", F.col("pattern"), F.lit(1))
    kept = F.when(F.col("many"), found).otherwise(F.slice(found, 1, 1))
    rows = joined.select(page, "entry", F.posexplode(kept).alias("pos", "raw"))
    return rows.select(page, "entry", "pos", shown(F.col("raw")).alias("value")).where("value <> ''")


def stories(found: DataFrame, scalars: list[str], lists: list[str], page: str = "page_id") -> DataFrame:
    """A row for each page of :func:`entries`: scalars as texts, lists as arrays in order."""

    def members(name: str):
        own = F.collect_list(F.when(F.col("entry") == name, F.struct("pos", "value")))
        return F.transform(F.array_sort(own), lambda r: r["value"])

    first = [F.min_by("value", F.when(F.col("entry") == n, F.col("pos"))).alias(n) for n in scalars]
    return found.groupBy(page).agg(*first, *(members(n).alias(n) for n in lists))


def chapters(pages: DataFrame, rules: DataFrame, page: str = "page_id", site: str = "site", html: str = "html", shown: Callable[[Column], Column] = text.strip_html) -> DataFrame:
    """(page, number, url, title) of a page's chapter list; a missing title is empty. ``shown`` makes a title of what was found."""
    joined = pages.select(page, F.col(site).alias("site"), F.col(html).alias("_html")).join(small(rules), "site")
    found = F.arrays_zip(F.regexp_extract_all("_html", F.col("url_pattern"), F.lit(1)), F.regexp_extract_all("_html", F.col("title_pattern"), F.lit(1)))
    rows = joined.select(page, F.posexplode(found.cast("array<struct<url:string,title:string>>")).alias("number", "c"))
    title = F.coalesce(shown(F.col("c.title")), F.lit(""))
    return rows.where("c.url is not null").select(page, (F.col("number") + 1).cast("bigint").alias("number"), F.col("c.url").alias("url"), title.alias("title"))
