"""Incremental operators on keyed state: a batch touches the state of its own keys only.

State lives in Spark's state store (RocksDB, with a changelog in the checkpoint),
partitioned by key, so it survives lost executors and restarts and never passes
through the driver. A key's rows of one batch are sorted in one task; the stream's
``maxBytesPerTrigger`` or ``maxFilesPerTrigger`` bounds them. Rows without a key
form a key of their own; rows without an order can't be placed and give nothing.
Values of any atomic type but binary are kept as text and cast back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from storyflow.streaming.incremental import RETRY_LIMIT

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _whole(rows: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    """A key's rows of a batch, in order; rows of one order as they came."""
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


def _text(value) -> str | None:
    return None if value is None or value != value else value


class LastValues(StatefulProcessor):
    """Rows whose value differs from the one before; the state is a key's last row."""

    def __init__(self, order_kind: str):
        self.order_kind = order_kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", f"at {self.order_kind}, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _whole(rows, "at").assign(old=False)
        if self.last.exists():
            at, value = self.last.get()
            held = pd.DataFrame({"at": pd.Series([at]).astype(new["at"].dtype), "value": pd.Series([value], dtype=object), "old": [True]})
            new = pd.concat([held, new[["at", "value", "old"]]], ignore_index=True).sort_values("at", kind="stable", ignore_index=True)
        value = new["value"].astype(object).where(new["value"].notna(), None)
        previous = value.shift(1)
        previous = previous.where(previous.notna(), None)
        same = (value == previous) | (value.isna() & previous.isna())
        same.iloc[0] = False
        kept = ~same & ~new["old"]
        self.last.update((new["at"].iloc[-1].to_pydatetime() if hasattr(new["at"].iloc[-1], "to_pydatetime") else new["at"].iloc[-1].item() if hasattr(new["at"].iloc[-1], "item") else new["at"].iloc[-1], value.iloc[-1]))
        if kept.any():
            n = int(kept.sum())
            yield pd.DataFrame({"key": [key[0]] * n, "at": new["at"][kept].to_list(), "value": value[kept].to_list(), "previous": previous[kept].to_list()})

    def close(self) -> None:
        pass


class Retries(StatefulProcessor):
    """Failures since the last success, and whether they ever reached a limit."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counter = handle.getValueState("counter", "failures bigint, tripped boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before, tripped = self.counter.get() if self.counter.exists() else (0, False)
        new = _whole(rows, "at")
        passed, failed = new["passed"].fillna(False).astype(bool), new["failed"].fillna(False).astype(bool)
        run = passed.cumsum()
        # A success begins a run; the first one goes on with what the state holds.
        counts = failed.groupby(run).sum()
        if 0 in counts.index:
            counts[0] += before
        tripped = bool(tripped or (counts >= self.limit).any() or before >= self.limit)
        failures = int(counts.iloc[-1])
        self.counter.update((failures, tripped))
        yield pd.DataFrame({"key": [key[0]], "failures": [failures], "tripped": [tripped]})

    def close(self) -> None:
        pass


class LogEntries(StatefulProcessor):
    """Changed entries of every version of a story; the state is a map of the last values.

    An entry without a value changes nothing. ``counted`` is an entry of a number
    with commas; where it was known before, its growth is one more entry.
    """

    def __init__(self, counted: str, growth: str):
        self.counted, self.growth = counted, growth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "entry string", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _whole(rows, "at")
        known: dict[str, str | None] = {}
        start, out = dict(known), []

        def before(entry: str) -> str | None:
            if entry not in known:
                held = (entry,)
                start[entry] = known[entry] = self.values.getValue(held)[0] if self.values.containsKey(held) else None
            return known[entry]

        for at, version in new.groupby("at", sort=True):
            found = sorted((e, v) for e, v in zip(version["entry"], version["value"]) if _text(e) and _text(v))
            values = dict(found)
            if self.counted in values and before(self.counted) is not None:
                numbers = [x.replace(",", "") for x in (before(self.counted), values[self.counted])]
                if all(x.lstrip("-").isdigit() for x in numbers):
                    values[self.growth] = f"{int(numbers[1]) - int(numbers[0]):,}"
            for entry, value in sorted(values.items()):
                if before(entry) != value:
                    out.append((key[0], at, entry, value, known[entry]))
                    known[entry] = value
        for entry, value in known.items():
            if value is not None and value != start[entry]:
                self.values.updateValue((entry,), (value,))
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "entry", "value", "previous"])

    def close(self) -> None:
        pass


def _key(stream: DataFrame, by: str):
    """A key as text that is never null, as workers tell neither nulls nor large numbers apart."""
    return F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")).alias("key")


def _by(stream: DataFrame, by: str):
    return F.when(F.col("key") != "", F.substring("key", 2, 2**31 - 1).cast(dict(stream.dtypes)[by])).alias(by)


def _grouped(stream: DataFrame, by: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    return stream.groupBy(by).transformWithStateInPandas(processor, schema, "Update", "None")


def log_differences(stream: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """A stream of (by, order, value, previous): rows whose value differs from the last one of their key.

    A row that comes late is compared with what its batch and the last row have before it.
    """
    kinds = dict(stream.dtypes)
    given = stream.where(F.col(order).isNotNull()).select(_key(stream, by), F.col(order).alias("at"), F.col(value).cast("string").alias("value"))
    found = _grouped(given, "key", LastValues(kinds[order]), f"key string, at {kinds[order]}, value string, previous string")
    return found.select(_by(stream, by), F.col("at").alias(order), F.col("value").cast(kinds[value]).alias(value), F.col("previous").cast(kinds[value]).alias("previous"))


def retry_counters(stream: DataFrame, by: str, order: str, failed: str, passed: str, limit: int = RETRY_LIMIT) -> DataFrame:
    """A stream of (by, failures, tripped), a row for every key of a batch."""
    kinds = dict(stream.dtypes)
    given = stream.where(F.col(order).isNotNull()).select(_key(stream, by), F.col(order).alias("at"), F.col(failed).alias("failed"), F.col(passed).alias("passed"))
    found = _grouped(given, "key", Retries(limit), "key string, failures bigint, tripped boolean")
    return found.select(_by(stream, by), "failures", "tripped")


def log_entries(stream: DataFrame, story: str, version: str, entry: str, value: str, counted: str = "numWords", growth: str = "words_added") -> DataFrame:
    """A stream of (story, version, entry, value, previous): what a story's log says of each version."""
    kinds = dict(stream.dtypes)
    given = stream.where(F.col(version).isNotNull()).select(_key(stream, story), F.col(version).alias("at"), F.col(entry).cast("string").alias("entry"), F.col(value).cast("string").alias("value"))
    found = _grouped(given, "key", LogEntries(counted, growth), f"key string, at {kinds[version]}, entry string, value string, previous string")
    return found.select(_by(stream, story), F.col("at").alias(version), F.col("entry").alias("entry"), F.col("value").alias("value"), "previous")


def written(stream: DataFrame, path: str, trigger: dict | None = None) -> list[dict]:
    """Run a keyed stream as far as its input goes; batch ``n`` lies under ``<path>/rows/batch=n``.

    A batch that runs again writes its rows anew. Returns the progress of each batch.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        query = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
        query.awaitTermination()
        return [dict(p) for p in query.recentProgress]
    finally:
        spark.conf.set(_PROVIDER, before)


def rows(spark: SparkSession, path: str, schema: DataFrame) -> DataFrame:
    """What :func:`written` has written so far, with the number of its ``batch``."""
    kinds = ", ".join(f"`{c}` {k}" for c, k in schema.dtypes)
    return spark.read.schema(f"{kinds}, batch int").parquet(f"{path}/rows")


def latest(found: DataFrame, by: str) -> DataFrame:
    """The row of each key that the last batch with it gave."""
    others = [c for c in found.columns if c not in (by, "batch")]
    return found.groupBy(by).agg(F.max_by(F.struct(*others), "batch").alias("l")).select(by, "l.*")
