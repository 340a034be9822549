"""A new chapter listing against earlier output, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyflow.operators import keys

ERROR_LIMIT = 5


def numbered_chapters(df: DataFrame, story: str, position: str) -> DataFrame:
    """``number`` and ``index04`` of chapters in order."""
    out = keys.numbered(df, [story], F.col(position))
    return out.withColumn("index04", F.lpad(F.col("number").cast("string"), 4, "0"))


def in_range(df: DataFrame, first: int | None, last: int | None, html: str = "html") -> DataFrame:
    """Chapters outside first..last keep their row but lose their text."""
    inside = (F.col("number") >= (first or 1)) & (F.col("number") <= F.lit(last) if last else F.lit(True))
    return df.withColumn(html, F.when(inside, F.col(html)).otherwise(""))


def chapters_counted(total: Column, first: int | None, last: int | None) -> Column:
    """Number of chapters that a range leaves."""
    end = F.least(total, F.lit(last)) if last else total
    return F.greatest(end - F.lit((first or 1) - 1), F.lit(0))


def merged(new: DataFrame, old: DataFrame, key: str = "url", reload_first: bool = False, story: str | None = None, mark_new: bool = True) -> DataFrame:
    """``new`` (key, number, title) with old text where the key was known.

    ``old`` has key, pos, html, origtitle, title; of equal keys the first row
    counts. ``is_new``: not known while there is earlier output (of the same
    ``story``, where both sides have that column), or still marked there (its
    title was decorated); none without ``mark_new``, and never a first chapter
    that is reloaded. ``fetch``: the text must be fetched.
    """
    first = keys.first_by(old.select(key, "pos", F.col("html").alias("old_html"), F.col("origtitle").alias("old_orig"), F.col("title").alias("old_title")), [key], F.col("pos")).drop("pos")
    out = new.join(first, key, "left")
    fetch = F.col("old_html").isNull()
    if reload_first:
        fetch = fetch | (F.col("number") == 1)
    still = F.coalesce(F.col("old_orig") != F.col("old_title"), F.lit(False))
    if story:
        out = out.join(old.select(F.col(story).alias("_story")).distinct(), F.col(story) == F.col("_story"), "left")
        earlier = F.col("_story").isNotNull()
    else:
        earlier = F.lit(not old.isEmpty())
    fresh = (F.col("old_html").isNull() & earlier) | still
    if reload_first:
        fresh = fresh & (F.col("number") != 1)
    return out.withColumns({"fetch": fetch, "is_new": fresh & F.lit(mark_new)}).drop("old_orig", "old_title", "_story")


def merged_by_place(new: DataFrame, old: DataFrame) -> DataFrame:
    """The same for old output without urls: by story and number; of several old rows the least text counts."""
    first = old.groupBy("story", "number").agg(F.min("html").alias("old_html"))
    known = old.select("story", F.lit(True).alias("_known")).distinct()
    out = new.join(first, ["story", "number"], "left").join(known, "story", "left")
    return out.withColumn("is_new", F.col("old_html").isNull() & F.coalesce("_known", F.lit(False))).drop("_known")


def decision(old: Column, new: Column, always: bool = False, force: bool = False) -> Column:
    """skip, refuse, warn or update, by the counts of old and new chapters; forced, they don't matter."""
    if force:
        return F.lit("update")
    out = F.when(old > new, "warn").when(old == 0, "refuse").otherwise("update")
    return out if always else F.when(old == new, "skip").otherwise(out)


#: What to do with a book that exists, by mode.
COLLISIONS = {"skip": "skip", "add_new": "add", "update": "update_if_newer", "update_always": "update", "overwrite": "overwrite_if_newer", "overwrite_always": "overwrite", "metadata_only": "metadata", "save_collection": "metadata"}


def collision(mode: str, exists: Column, newer: Column) -> Column:
    """Action on a book under a collision mode."""
    what = COLLISIONS[mode]
    found = F.when(newer, what.removesuffix("_if_newer")).otherwise("skip") if what.endswith("_if_newer") else F.lit(what)
    return F.when(exists, found).otherwise("skip" if what == "metadata" else "add")


def with_error_limit(df: DataFrame, story: str, position: str, failed: str, limit: int = ERROR_LIMIT) -> DataFrame:
    """``tried``: false once ``limit`` earlier chapters of the story failed; below 0 never."""
    if limit < 0:
        return df.withColumn("tried", F.lit(True))
    before = Window.partitionBy(story).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("tried", F.coalesce(F.count_if(F.col(failed)).over(before), F.lit(0)) < limit)


def from_newest(df: DataFrame, story: str, date: str, position: str) -> DataFrame:
    """``newest``: place of the latest chapter, the first on ties; rows from it on are dropped with :func:`before`."""
    best = df.groupBy(story).agg(F.min_by(position, F.struct(-F.col(date).cast("double"), F.col(position))).alias("newest"))
    return df.join(best, story)


def before_newest(df: DataFrame, story: str, date: str, position: str) -> DataFrame:
    return from_newest(df, story, date, position).where(F.col(position) < F.col("newest"))


def images_carried(new: DataFrame, old: DataFrame) -> DataFrame:
    """Images of new chapters with the names of old ones: by url, else by embedded name."""
    by_url = old.where("used").groupBy("url").agg(F.min("uuid").alias("uuid_by_url"))
    by_name = old.where("used").groupBy("uuid").agg(F.min("newsrc").alias("newsrc"))
    found = new.join(by_url, "url", "left").withColumn("uuid", F.coalesce("uuid_by_url", "uuid")).drop("uuid_by_url")
    return found.join(by_name, "uuid", "left")


def relinked(chapters: DataFrame, story: str, url: str, file: str, html: str) -> DataFrame:
    """Links to other chapters of the story point to their files.

    Links are exploded, joined with the story's map of urls and put back by
    position; only the targets travel, texts are joined back once.
    """
    targets = chapters.select(F.col(story).alias("_s"), F.col(url).alias("_u"), F.col(file).alias("_f"))
    links = chapters.select(story, file, F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1)))).alias("_u"))
    pairs = links.join(targets, (F.col(story) == F.col("_s")) & (links["_u"] == targets["_u"])).select(F.col(story).alias("_s"), F.col(file).alias("_own"), links["_u"].alias("_u"), "_f")
    maps = pairs.groupBy("_s", "_own").agg(F.array_sort(F.collect_set(F.struct("_u", "_f"))).alias("_map"))
    joined = chapters.join(maps, (F.col(story) == F.col("_s")) & (F.col(file) == F.col("_own")), "left")
    swapped = F.aggregate("_map", F.col(html), lambda t, m: F.replace(t, F.concat(F.lit('href="'), m["_u"], F.lit('"')), F.concat(F.lit('href="'), m["_f"], F.lit('"'))))
    return joined.withColumn(html, F.coalesce(swapped, F.col(html))).select(chapters.columns)
