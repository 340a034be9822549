"""A library table: matching, rejecting, merging, reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyflow.functions import arrays, urls
from storyflow.operators import keys, positions

#: Report order of the statuses, good ones first.
STATUSES = ("Add", "Update", "Meta", "Different URL", "Skipped", "Bad", "Error")


def matched(books: DataFrame, library: DataFrame) -> DataFrame:
    """``book_id`` of each book (url, title, author): by url whatever its scheme, else by title and author.

    Several matches give the smallest id.
    """
    by_url = library.groupBy(urls.without_scheme(F.col("url")).alias("_key")).agg(F.min("book_id").alias("_by_url"))
    by_name = library.groupBy(F.lower("title").alias("_title"), F.lower("author").alias("_author")).agg(F.min("book_id").alias("_by_name"))
    out = books.withColumn("_key", urls.without_scheme(F.col("url"))).join(by_url, "_key", "left")
    out = out.withColumns({"_title": F.lower("title"), "_author": F.lower("author")}).join(by_name, ["_title", "_author"], "left")
    how = F.when(F.col("_by_url").isNotNull(), "url").when(F.col("_by_name").isNotNull(), "title").otherwise("none")
    return out.withColumns({"book_id": F.coalesce("_by_url", "_by_name"), "matched_by": how}).drop("_key", "_title", "_author", "_by_url", "_by_name")


def wanted(books: DataFrame, rejects: DataFrame, section: str = "section_url", existing: DataFrame | None = None) -> DataFrame:
    """Books that are not rejected, and only existing ones where given."""
    out = keys.drop(books, rejects, [section])
    return keys.keep(out, existing, [section]) if existing is not None else out


def reject_list(df: DataFrame) -> DataFrame:
    """One row per section url: the longer url wins, the earlier on ties."""
    return keys.longest_first(df, ["section_url"], "url", "pos")


def anthology(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Every key of either side as kept, added or removed."""
    both = new.select(key, F.lit(1).alias("_new")).distinct().join(old.select(key, F.lit(1).alias("_old")).distinct(), key, "full")
    return both.select(key, F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "added").otherwise("kept").alias("state"))


def merged_books(df: DataFrame, group: str, position: str) -> DataFrame:
    """One book of each group.

    Authors are an ordered set, tags a sorted one; earliest publication, latest
    update, sums of chapters and words, the publisher if all agree, and
    descriptions joined in order.
    """
    first_seen = df.groupBy(group, "author").agg(F.min(position).alias("p")).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "author"))), lambda x: x["author"]).alias("authors"))
    base = df.groupBy(group).agg(
        F.min("published").alias("published"),
        F.max("updated").alias("updated"),
        F.sum("chapters").alias("chapters"),
        F.sum("words").alias("words"),
        F.when(F.count_distinct("publisher") == 1, F.min("publisher")).alias("publisher"),
        F.array_sort(F.collect_set("tag")).alias("tags"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, "description"))), lambda x: x["description"]), "\n\n").alias("description"),
    )
    return base.join(first_seen, group, "left")


def common_members(df: DataFrame, group: str, owner: str, member: str) -> DataFrame:
    """Members that every owner of a group has, as (group, member).

    Counting owners of each member replaces intersecting collected lists.
    """
    own = df.select(group, owner, member).distinct()
    owners = own.groupBy(group).agg(F.count_distinct(owner).alias("_owners"))
    return own.groupBy(group, member).agg(F.count("*").alias("_n")).join(owners, group).where("_n = _owners").select(group, member)


def report(df: DataFrame, status: str, good: str, order: str) -> DataFrame:
    """``report_order``: bucket of (good, status), ten thousand apart, and the list order."""
    known = F.array(*map(F.lit, STATUSES))
    place = F.array_position(known, F.col(status))
    bucket = F.when(F.col(good), F.lit(0)).otherwise(len(STATUSES) + 1) + F.when(place > 0, place - 1).otherwise(len(STATUSES))
    return df.withColumn("report_order", bucket.cast("bigint") * 10000 + F.col(order))


def report_lines(df: DataFrame) -> DataFrame:
    """Books in report order, with a count of each bucket."""
    return df.groupBy("good", "status").agg(F.count("*").alias("books"))


def casts(value: Column) -> dict[str, Column]:
    """A metadata text as the types that library columns have."""
    plain = F.replace(value, F.lit(","), F.lit(""))
    return {"int": plain.try_cast("bigint"), "float": plain.try_cast("double"), "bool": arrays.bool_words(value), "text": value}


def status_flags(status: Column) -> tuple[Column, Column]:
    """Whether a status says complete, and in progress."""
    return F.contains(F.lower(status), F.lit("complete")), F.contains(F.lower(status), F.lit("progress"))


def new_only(added: Column, new: Column, old: Column) -> Column:
    """A column that only added books set."""
    return F.when(added, new).otherwise(old)


def upserted(library: DataFrame, changes: DataFrame, key: str = "book_id") -> DataFrame:
    """``library`` with changed rows replaced and new ones added."""
    return library.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def error_column(old: Column, failed: Column, message: Column) -> Column:
    """The error of a failed check; a passed one clears an earlier error."""
    return F.when(failed, message).when(old.isNotNull(), F.lit(None).cast("string")).otherwise(old)


def reading_list(current: DataFrame, add: DataFrame, remove: DataFrame, key: str = "book_id") -> DataFrame:
    """A list's books after adding and removing some."""
    return current.select(key).unionByName(add.select(key)).distinct().join(remove.select(key), key, "left_anti")


def site_counts(stories: DataFrame, site: str, new: str) -> DataFrame:
    """``stories`` of each site and the sum of their new chapters."""
    return stories.groupBy(site).agg(F.count("*").alias("stories"), F.coalesce(F.sum(new), F.lit(0)).cast("bigint").alias("new_chapters"))


def valid_metadata(title: Column, chapters: Column) -> tuple[Column, Column]:
    """Whether a story can be written, and why not: it needs a title and a chapter."""
    why = F.when(F.coalesce(title, F.lit("")) == "", "no title").when(F.coalesce(chapters, F.lit(0)) < 1, "no chapters")
    return why.isNull(), why


def good_and_bad(stories: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """Stories that went well, and all others; null isn't good."""
    fine = F.coalesce(good, F.lit(False))
    return stories.where(fine), stories.where(~fine)


def list_order(books: DataFrame, by: str) -> DataFrame:
    """``listorder``: a book's place from 0 by a column."""
    return positions.placed(books, by, "listorder").withColumn("listorder", F.col("listorder") - 1)


def result_marks(results: DataFrame, by: str, failed: str, chapter_error: str, prefix: str = "fff") -> DataFrame:
    """``mark`` of each book of a batch, numbered from 0 in each list by ``by``.

    Every book is in the list of all; one that failed gets that list's mark instead,
    and one with a chapter error that one's.
    """
    lists = (("success", F.lit(True)), ("failed", F.col(failed)), ("chapter_error", F.col(chapter_error)))
    out, marks = results, []
    for name, inside in lists:
        numbered = positions.placed(results.where(inside).select(by), by, "_place").select(by, F.format_string(f"{prefix}_{name}_%04d", F.col("_place") - 1).alias(f"_{name}"))
        out = out.join(numbered, by, "left")
        marks.insert(0, F.col(f"_{name}"))
    return out.withColumn("mark", F.coalesce(*marks)).drop(*(f"_{name}" for name, _ in lists))


def in_launch_order(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts with ``launched``, the part's place; a part's own ``ord`` orders its rows."""
    whole = parts[0].withColumn("launched", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        whole = whole.unionByName(part.withColumn("launched", F.lit(k)), allowMissingColumns=True)
    return whole


def blanked(books: DataFrame, secrets: tuple[str, ...] = ("password", "username", "totp"), note: str = "(was set, removed for security)") -> DataFrame:
    """Columns of secrets replaced by a note where they are set, before a row is shown."""
    return books.withColumns({c: F.when(F.col(c).cast("string") != "", F.lit(note)).otherwise(F.col(c).cast("string")) for c in books.columns if c.lower() in secrets})


def counters_summed(*counters: Column) -> Column:
    """Sum of counters of one row; a missing one makes it null, as nothing is known then."""
    total = counters[0].cast("bigint")
    for counter in counters[1:]:
        total = total + counter.cast("bigint")
    return total


def title_changes(new: DataFrame, old: DataFrame, key: str = "url") -> DataFrame:
    """(key, old_title, new_title) of listed entries whose original title isn't what earlier output has."""
    both = new.select(key, F.col("title").alias("new_title")).join(old.groupBy(key).agg(F.min("origtitle").alias("old_title")), key)
    return both.where("new_title <> old_title").select(key, "old_title", "new_title")
