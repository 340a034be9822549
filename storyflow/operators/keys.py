"""Keep-first and keep-longest by explicit order, and semi and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key; null keys are a key of their own.

    One aggregate with a partial step, so a hot key costs no sort of its rows.
    """
    ordered = F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order)))
    rest = F.struct(*(F.col(c) for c in df.columns))
    return df.groupBy(*keys).agg(F.min_by(rest, ordered).alias("_row")).select("_row.*")


def longest_first(df: DataFrame, keys: list[str], text: str, position: str) -> DataFrame:
    """The row with the longest text of each key, the earliest on ties."""
    return first_by(df, keys, -F.length(text), F.col(position))


def keep(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(on), on, "left_semi")


def drop(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(on), on, "left_anti")


def numbered(df: DataFrame, by: list[str], *order: Column, name: str = "number") -> DataFrame:
    """1-based place within ``by``, as a bigint."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))


def repeats(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """``skipped``: whether an earlier row has the same key."""
    return numbered(df, by, *order, name="_n").withColumn("skipped", F.col("_n") > 1).drop("_n")


def shared_file(df: DataFrame, data: str, order: str, name: str) -> DataFrame:
    """Each row gets ``name`` of the first row with the same bytes (length and SHA-256)."""
    keyed = df.withColumns({"_len": F.octet_length(data), "_sum": F.sha2(data, 256)})
    first = keyed.groupBy("_len", "_sum").agg(F.min_by(name, order).alias("file"))
    return keyed.join(first, ["_len", "_sum"]).drop("_len", "_sum")
