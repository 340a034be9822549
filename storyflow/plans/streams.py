"""Queries that run as streams over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyflow.plans.registry import ORACLES, query
from storyflow.plans import books  # noqa: F401
from storyflow.shared import fresh_path, table
from storyflow.streaming import incremental, keyed


def _events(spark, sf):
    return incremental.arriving(spark, sf, "events", table(spark, sf, "events").schema)


@query(ORACLES["log_changed_entries"])
def stream_log_diff(spark, sf):
    fold = incremental.log_differences(spark, fresh_path(spark, "log"), "user_id", "event_type", "event_id")
    incremental.run(_events(spark, sf), fold)
    return spark.read.parquet(f"{fold.path}/rows").select("user_id", "event_id", "event_type", "previous")


@query("select distinct user_id, event_type from events")
def stream_cache_dedup(spark, sf):
    timed = _events(spark, sf).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return incremental.stored(incremental.first_seen(timed, ["user_id", "event_type"], "ts", "1000 days"), "cache").select("user_id", "event_type")


@query("""
  with r as (select user_id, event_type, sum((event_type in ('purchase', 'signup'))::int) over (partition by user_id order by event_id) as run from events),
  n as (select user_id, run, count(*) filter (where event_type = 'error') as n from r group by user_id, run)
  select user_id, arg_max(n, run) as failures, max(n) >= 3 as tripped from n group by user_id""")
def stream_retry_counter(spark, sf):
    fold = incremental.retry_counters(spark, fresh_path(spark, "retries"), "user_id", "event_id", "failed", "passed", limit=3)
    marked = _events(spark, sf).withColumns({"failed": F.col("event_type") == "error", "passed": F.col("event_type").isin("purchase", "signup")})
    incremental.run(marked, fold)
    last = spark.read.parquet(f"{fold.path}/rows")
    return last.where(F.col("batch") == last.agg(F.max("batch")).first()[0]).select("user_id", "failures", "tripped")


@query(ORACLES["log_changed_entries"])
def stream_log_keyed(spark, sf):
    path = fresh_path(spark, "log")
    found = keyed.log_differences(_events(spark, sf), "user_id", "event_type", "event_id")
    keyed.written(found, path)
    return keyed.rows(spark, path, found).drop("batch")


@query(ORACLES["stream_retry_counter"])
def stream_retry_keyed(spark, sf):
    path = fresh_path(spark, "retries")
    marked = _events(spark, sf).withColumns({"failed": F.col("event_type") == "error", "passed": F.col("event_type").isin("purchase", "signup")})
    counted = keyed.retry_counters(marked, "user_id", "event_id", "failed", "passed", limit=3)
    keyed.written(counted, path)
    return keyed.latest(keyed.rows(spark, path, counted), "user_id").select("user_id", "failures", "tripped")


@query("""
  with e as (select user_id, event_id, unnest(['kind', 'numWords']) as entry, unnest([event_type, cast(event_id * 37 % 5000 as varchar)]) as value from events),
  p as (select *, lag(value) over (partition by user_id, entry order by event_id) as previous from e),
  w as (select user_id, event_id, 'words_added' as entry, cast(value as bigint) - cast(previous as bigint) as n from p where entry = 'numWords' and previous is not null),
  g as (select user_id, event_id, entry, case when n < 0 then '-' else '' end || regexp_replace(cast(abs(n) as varchar), '^(\\d+)(\\d{3})$', '\\1,\\2') as value from w),
  a as (select user_id, event_id, entry, value, previous from p union all select *, lag(value) over (partition by user_id order by event_id) from g)
  select user_id, event_id, entry, value, previous from a where value is distinct from previous""")
def stream_log_entries(spark, sf):
    path = fresh_path(spark, "entries")
    entries = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("numWords"), (F.col("event_id") * 37 % 5000).cast("string"))
    told = _events(spark, sf).select("user_id", "event_id", F.explode(entries).alias("entry", "value"))
    found = keyed.log_entries(told, "user_id", "event_id", "entry", "value")
    keyed.written(found, path)
    return keyed.rows(spark, path, found).drop("batch")
