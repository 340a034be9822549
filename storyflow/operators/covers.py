"""Images: which are kept, named and used as a cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyflow.functions import binary


def large_enough(width: Column, height: Column, least_wide: int, least_high: int) -> Column:
    return (width >= least_wide) & (height >= least_high)


def candidates(images: DataFrame, least: tuple[int, int] = (0, 0), excluded: str | None = None) -> DataFrame:
    """Images (url, width, height) that may be a cover: size and url pass."""
    fits = large_enough(F.col("width"), F.col("height"), *least)
    return images.where(fits & ~F.col("url").rlike(excluded) if excluded else fits)


def covers(images: DataFrame, story: str, order: list[str] = ("specific", "first", "default")) -> DataFrame:
    """The cover of each story: by kind in ``order``, then by place."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    ranked = images.withColumn("_rank", rank).where("_rank > 0")
    return ranked.groupBy(story).agg(F.min_by("url", F.struct("_rank", "seq")).alias("cover"))


def named(images: DataFrame) -> DataFrame:
    """``name`` of each image's file: by the bytes of inline ones, else by url; copies share the first one's."""
    inline = binary.inline_image_name(F.regexp_replace("url", r"(?<!:)/{2,}", "/"))
    own = images.withColumn("src", inline).withColumn("name", binary.uuid5(F.col("src")))
    first = own.groupBy(F.octet_length("data").alias("_n"), F.sha2("data", 256).alias("_h")).agg(F.min_by("name", F.struct("seq", "name")).alias("_first"))
    joined = own.withColumns({"_n": F.octet_length("data"), "_h": F.sha2("data", 256)}).join(first, ["_n", "_h"], "left")
    return joined.withColumn("name", F.coalesce("_first", "name")).drop("_n", "_h", "_first")
