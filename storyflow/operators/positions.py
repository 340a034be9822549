"""Places, neighbours and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyflow.shared import cut


def pairs(df: DataFrame, by: str, *order: Column, value: str = "ts") -> DataFrame:
    """Each value with the next one of its group; the last has none and is dropped."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("until", F.lead(value).over(w)).where(F.col("until").isNotNull())


def changes(df: DataFrame, by: list[str], value: str, *order: Column) -> DataFrame:
    """Rows whose value differs from the one before, with ``previous``; the first row counts."""
    w = Window.partitionBy(*by).orderBy(*order)
    seen = df.withColumns({"previous": F.lag(value).over(w), "_n": F.row_number().over(w)})
    return seen.where((F.col("_n") == 1) | ~F.col("previous").eqNullSafe(F.col(value))).drop("_n")


def delta(df: DataFrame, by: list[str], value: str, *order: Column) -> DataFrame:
    """``added``: value less the one before, null for the first."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("added", F.col(value) - F.lag(value).over(w))


def last_values(df: DataFrame, by: list[str], value: str, order: Column) -> DataFrame:
    """The last value of each key, by an order without ties."""
    return df.groupBy(*by).agg(F.max_by(value, order).alias(value))


def first_and_last(df: DataFrame, by: str, value: str, order: Column) -> DataFrame:
    """First and last non-null value of each group, by an order without ties."""
    some = F.col(value).isNotNull()
    return df.groupBy(by).agg(F.min_by(value, F.when(some, order)).alias("first_value"), F.max_by(value, F.when(some, order)).alias("last_value"))


def category_order(df: DataFrame, category: str, order: list[str], date: str, position: str, by_date: list[str] = (), skip: list[str] = (), renamed: dict[str, str] | None = None) -> DataFrame:
    """``rank`` of rows: categories sorted by date first, configured ones next, others by name.

    Within a category of ``by_date`` rows follow date and position, elsewhere
    position. Skipped categories go, renamed ones count under their new name.
    """
    name = F.col(category)
    for old, new in (renamed or {}).items():
        name = F.when(name == old, new).otherwise(name)
    df = df.where(~F.col(category).isin(*skip)) if skip else df
    place = F.array_position(F.array(*map(F.lit, order)).cast("array<string>"), name)
    dated = name.isin(*by_date) if by_date else F.lit(False)
    named = df.withColumn(category, name)
    sort = [F.when(dated, 0).otherwise(1), F.when(place > 0, place).otherwise(len(order) + 1), F.col(category), F.when(dated, F.col(date)), F.col(position)]
    return named.withColumn("rank", F.struct(*(c.alias(f"k{i}") for i, c in enumerate(sort))))


def sections(df: DataFrame, story: str, position: str, level: str, title: str, depth: int = 3) -> DataFrame:
    """``path``: titles of the sections around each row, by their levels 1..depth.

    A section of a level ends those at its level and below.
    """
    upto = Window.partitionBy(story).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    here = F.struct(F.col(position).alias("p"), F.col(title).alias("t"))
    last = [F.last(F.when(F.col(level) == k, here), ignorenulls=True).over(upto) for k in range(1, depth + 1)]
    held = df.withColumns({f"_l{k}": c for k, c in enumerate(last, 1)})
    kept = []
    for k in range(1, depth + 1):
        own = F.col(f"_l{k}")
        newer = F.coalesce(*(F.when(F.col(f"_l{j}")["p"] > own["p"], True) for j in range(1, k)), F.lit(False)) if k > 1 else F.lit(False)
        kept.append(F.when(~newer, own["t"]))
    return held.withColumn("path", F.array_join(F.array(*kept), " / ")).drop(*(f"_l{k}" for k in range(1, depth + 1)))


def placed(df: DataFrame, rank: str, name: str = "place") -> DataFrame:
    """1-based place of every row of the whole table by ``rank``.

    Rows are dealt out by ranges of the rank and written once; a row's place is
    its place within its range after the sizes of the ranges before. Only those
    sizes, one number a range, reach the driver.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(rank).withColumn("_range", F.spark_partition_id())
    held, _ = cut(dealt, "placed")
    before, total = {}, 0
    for r in sorted(held.groupBy("_range").count().collect()):
        before[r[0]], total = total, total + r[1]
    sizes = spark.createDataFrame(list(before.items()) or [(0, 0)], "_range int, _before bigint")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(rank))
    return held.join(F.broadcast(sizes), "_range").withColumn(name, (F.col("_before") + own).cast("bigint")).drop("_range", "_before")


def series_places(listed: DataFrame, stories: DataFrame, series: str, page: str, place: str, link: str, pattern: str, story: str = "story_id") -> DataFrame:
    """``stories`` with ``series`` and ``series_index``, their first place in a series' list over all its pages.

    ``pattern``'s first group is the story's id in a link. A place counts all links
    before it, whether they are of known stories or not. Places are partial counts
    by page, so a long series is never sorted in one task.
    """
    sizes = listed.groupBy(series, page).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(series).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(series, page, before.alias("_before"))
    within = F.row_number().over(Window.partitionBy(series, page).orderBy(place))
    rows = listed.withColumn("_w", within).join(starts, [series, page])
    found = rows.select(F.col(series), F.regexp_extract(link, pattern, 1).alias("_id"), (F.col("_before") + F.col("_w")).alias("series_index")).where("_id <> ''")
    first = found.groupBy("_id").agg(F.min(F.struct("series_index", series)).alias("_f")).select("_id", F.col(f"_f.{series}").alias("series"), F.col("_f.series_index").alias("series_index"))
    return stories.join(first, F.col(story).cast("string") == F.col("_id"), "left").drop("_id")
