"""Steps that some sites need: labels to columns, routes, notes, forum markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyflow.operators.lookups import small


def pivoted(rows: DataFrame, story: str, labels: dict[str, str]) -> DataFrame:
    """(story, label, value) rows as a column for each label; the first value counts.

    Labels without a column become keys of ``extra``, in lower case without
    blanks. A ``pos`` column gives the order.
    """
    found = [F.min_by("value", F.when(F.col("label") == label, F.col("pos"))).alias(column) for label, column in labels.items()]
    key = F.lower(F.replace("label", F.lit(" "), F.lit("")))
    other = F.when(~F.col("label").isin(*labels), F.struct(key.alias("k"), F.struct("pos", "value").alias("v")))
    extra = F.array_sort(F.collect_list(other))
    grouped = rows.groupBy(story).agg(*found, extra.alias("_extra"))
    first = F.filter("_extra", lambda e, i: (i == 0) | (e["k"] != F.try_element_at("_extra", i)["k"]))
    return grouped.withColumn("extra", F.map_from_entries(F.transform(first, lambda e: F.struct(e["k"], e["v"]["value"])))).drop("_extra")


def route(choice: Column, routes: Column) -> Column:
    """Route of a choice number in a map by its text."""
    return F.try_element_at(routes, choice.cast("string"))


def chapter_addresses(bounds: DataFrame, base: str) -> DataFrame:
    """Address of each part between neighbouring times (start, until); its end is exclusive."""
    return bounds.withColumn("address", F.concat(F.lit(base), F.col("start").cast("string"), F.lit("/"), (F.col("until") - 1).cast("string")))


def reader_pages(marks: DataFrame, posts: DataFrame, per_page: int, around: int = 2) -> DataFrame:
    """Posts of threadmarks, searched on the computed page and those around it, nearest first.

    ``marks``: url, category, index. ``posts``: category, page, url, html.
    """
    steps = F.array(*(F.struct(F.lit(i).alias("try"), F.lit(s).alias("step")) for i, s in enumerate(x for k in range(around + 1) for x in ((k, -k) if k else (0,)))))
    asked = marks.select("*", F.explode(steps).alias("s")).withColumn("page", F.floor((F.col("index") + per_page) / per_page).cast("int") + F.col("s.step"))
    met = asked.join(posts.withColumnRenamed("url", "post_url"), ["category", "page"]).where(F.col("url") == F.col("post_url"))
    return met.groupBy("url", "category", "index").agg(F.min_by("html", F.col("s.try")).alias("html"))


def canonical_chapters(links: DataFrame, chapters: DataFrame) -> DataFrame:
    """Links with a known chapter id get that chapter's own url."""
    known = chapters.select(F.regexp_extract("url", r"(\d+)(?:/[^/]*)?$", 1).alias("_id"), F.col("url").alias("_own")).dropDuplicates(["_id"])
    asked = links.withColumn("_id", F.regexp_extract("url", r"(\d+)(?:/[^/]*)?$", 1))
    return asked.join(known, "_id", "left").withColumn("url", F.when(F.col("_id") != "", F.coalesce("_own", "url")).otherwise(F.col("url"))).drop("_id", "_own")


def rendered_parts(parts: DataFrame, kind: str = "nt") -> DataFrame:
    """``html`` of typed parts: chapters as they are, choices as lists, posts quoted; appendices go."""
    choices = F.concat(F.lit("<ul><li>"), F.array_join("choices", "</li><li>"), F.lit("</li></ul>"))
    made = F.when(F.col(kind) == "chapter", F.col("body")).when(F.col(kind) == "choice", choices).when(F.col(kind) == "post", F.concat(F.lit("<blockquote>"), "body", F.lit("</blockquote>")))
    return parts.where(~F.startswith("title", F.lit("#special"))).withColumn("html", F.coalesce(made, F.lit("<p>unknown part</p>")))


def achievements(ids: DataFrame, known: DataFrame, story: str) -> DataFrame:
    """Titles of achievements by id; unknown ones say so."""
    return ids.join(small(known.select("id", "title")), "id", "left").select(story, "id", F.coalesce("title", F.lit("unknown achievement")).alias("title"))


def without_notes(markup: Column, kinds: list[str]) -> Column:
    """Without ``div`` blocks of the given note classes (without inner ``div``)."""
    for kind in kinds:
        markup = F.regexp_replace(markup, rf'(?is)<div[^>]*class="[^"]*\b{kind}\b[^"]*"[^>]*>(?:(?!</?div\b).)*</div>', "")
    return markup


def plain_elements(markup: Column, known: list[str]) -> Column:
    """Comments go, and elements outside ``known`` become ``span``."""
    names = "|".join(known)
    out = F.regexp_replace(markup, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(out, rf"(?i)<(/?)(?!(?:{names})\b)[a-z][\w:-]*\b[^>]*?(/?)>", "<$1span$2>")


def forum_markup(markup: Column, spoilers: str = "keep") -> Column:
    """Lazy images get their source, quotes become ``blockquote``, frames go; spoilers are kept, opened or dropped."""
    out = F.regexp_replace(markup, r'(?i)<img\b([^>]*?)\s+src="[^"]*"([^>]*?)\bdata-src="([^"]*)"', '<img$1$2src="$3"')
    out = F.regexp_replace(out, r"(?is)<(noscript|iframe)\b.*?</\1>", "")
    out = F.regexp_replace(out, r'(?is)<div class="bbCodeBlock--quote">((?:(?!</?div\b).)*)</div>', "<blockquote>$1</blockquote>")
    if spoilers != "keep":
        out = F.regexp_replace(out, r'(?is)<div class="bbCodeSpoiler">((?:(?!</?div\b).)*)</div>', "$1" if spoilers == "open" else "")
    return out


def enough_marks(marks: DataFrame, story: str, least: int = 2) -> DataFrame:
    """Threadmarks of stories that have at least ``least``."""
    counts = marks.groupBy(story).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return marks.join(counts.select(story), story, "left_semi")


def first_posts(posts: DataFrame, thread: str, place: str) -> DataFrame:
    """The first of a thread's first three posts that isn't pinned, else the first."""
    rank = F.struct(F.when(~F.col("sticky") & (F.col(place) <= 3), 0).otherwise(1).alias("a"), F.col(place).alias("b"))
    return posts.groupBy(thread).agg(F.min_by("html", rank).alias("html"))
