"""Incremental operators under Structured Streaming.

Batches go through ``foreachBatch`` with plain DataFrame steps; the state is a
table of its own per batch in the shared folder, written before it is used, so
a batch that runs again overwrites what it had written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyflow.shared import fresh_path

RETRY_LIMIT = 6


def arriving(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A table of a folder as a stream of its files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


class Fold:
    """A state table that each batch replaces, and the rows that each batch gives.

    ``step(state, batch) -> (new state, rows)``. State and rows of batch ``n``
    lie under ``<path>/state/n`` and ``<path>/rows/batch=n``. The state's schema
    follows from the types of the stream's columns.
    """

    def __init__(self, spark: SparkSession, path: str, state_schema: Callable[[dict[str, str]], str], step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]):
        self.spark, self.path, self.state_schema, self.step = spark, path, state_schema, step

    def state(self, batch: int, kinds: dict[str, str] | None = None) -> DataFrame:
        """The state after a batch; before the first it is empty, by the stream's types."""
        if batch < 0:
            return self.spark.createDataFrame([], self.state_schema(kinds or {}))
        return self.spark.read.parquet(f"{self.path}/state/{batch}")

    def __call__(self, batch: DataFrame, number: int) -> None:
        state, rows = self.step(self.state(number - 1, dict(batch.dtypes)), batch)
        state.write.mode("overwrite").parquet(f"{self.path}/state/{number}")
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/batch={number}")


def run(stream: DataFrame, fold: Fold, trigger: dict | None = None) -> None:
    """Process what is there (or as ``trigger`` says) and stop."""
    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{fold.path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()


def log_differences(spark: SparkSession, path: str, by: str, value: str, order: str) -> Fold:
    """Rows whose value differs from the last one of their key, with ``previous``."""
    w = Window.partitionBy(by).orderBy(order)

    def step(state: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = batch.select(by, order, value).withColumn("_old", F.lit(False)).unionByName(state.withColumn("_old", F.lit(True)))
        seen = rows.withColumns({"previous": F.lag(value).over(w), "_n": F.row_number().over(w)})
        changed = seen.where(~F.col("_old") & ((F.col("_n") == 1) | ~F.col("previous").eqNullSafe(F.col(value))))
        last = rows.groupBy(by).agg(F.max_by(F.struct(order, value), order).alias("l")).select(by, "l.*")
        return last, changed.select(by, order, value, "previous")

    return Fold(spark, path, lambda kinds: ", ".join(f"`{c}` {kinds[c]}" for c in (by, order, value)), step)


def retry_counters(spark: SparkSession, path: str, by: str, order: str, failed: str, passed: str, limit: int = RETRY_LIMIT) -> Fold:
    """Failures of each key since its last success, and whether they ever reached ``limit``."""
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)

    def step(state: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        runs = batch.select(by, order, failed, F.sum(F.col(passed).cast("int")).over(upto).alias("_run"))
        sizes = runs.groupBy(by, "_run").agg(F.count_if(failed).alias("n"))
        last = sizes.groupBy(by).agg(F.max_by("n", "_run").alias("n"), F.max("_run").alias("_last"), F.max(F.when(F.col("_run") == 0, F.col("n"))).alias("first"), F.max("n").alias("most"))
        both = last.join(state.withColumnRenamed("failures", "before"), by, "full")
        before = F.coalesce("before", F.lit(0))
        failures = F.when(F.coalesce("_last", F.lit(0)) == 0, before + F.coalesce("n", F.lit(0))).otherwise(F.col("n"))
        reached = F.greatest(F.coalesce("most", F.lit(0)), before + F.coalesce("first", F.lit(0))) >= limit
        new = both.select(by, failures.cast("bigint").alias("failures"), (reached | F.coalesce("tripped", F.lit(False))).alias("tripped"))
        return new, new

    return Fold(spark, path, lambda kinds: f"`{by}` {kinds[by]}, failures bigint, tripped boolean", step)


def first_seen(stream: DataFrame, keys: list[str], ts: str, keep: str) -> DataFrame:
    """The first row of each key while it is remembered, as a page cache does."""
    return stream.withWatermark(ts, keep).dropDuplicatesWithinWatermark(keys)


def stored(stream: DataFrame, name: str) -> DataFrame:
    """Write an append stream to a fresh table, as far as it goes, and read it."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
