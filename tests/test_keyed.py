from collections import Counter

import pytest

from pyspark.sql import functions as F

from storyflow.streaming import keyed

SCHEMA = "user_id bigint, event_id bigint, event_type string"
ROWS = [(u, i, ("error", "view", "purchase", None)[(i * (u + 2) // 3) % 4]) for i in range(40) for u in range(4) if u < 3 or i // 10 == 2] + [(None, i, "view") for i in range(3)]


def put(spark, tmp_path, parts):
    for part in parts:
        spark.createDataFrame([r for r in ROWS if r[1] // 10 == part], SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in/{part}")


def stream(spark, tmp_path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")


def changes():
    out = []
    for u in {r[0] for r in ROWS}:
        last, first = None, True
        for _, i, kind in sorted((r for r in ROWS if r[0] == u), key=lambda r: r[1]):
            if first or kind != last:
                out.append((u, i, kind, last))
            last, first = kind, False
    return sorted(out, key=repr)


def test_differences_over_batches_and_a_restart(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    put(spark, tmp_path, [0, 1])
    found = keyed.log_differences(stream(spark, tmp_path), "user_id", "event_type", "event_id")
    progress = keyed.written(found, path)
    put(spark, tmp_path, [2])
    put(spark, tmp_path, [3])
    progress += keyed.written(keyed.log_differences(stream(spark, tmp_path), "user_id", "event_type", "event_id"), path)
    got = [tuple(r)[:4] for r in keyed.rows(spark, path, found).collect()]
    assert sorted(got, key=repr) == changes()
    # A batch updates the state of its own keys and no other.
    touched = [p["stateOperators"][0]["numRowsUpdated"] for p in progress if p["numInputRows"]]
    per_part = Counter(part for part, u in {(r[1] // 10, r[0]) for r in ROWS})
    assert touched == [per_part[k] for k in range(4)]


def test_retries_over_batches(spark, tmp_path):
    put(spark, tmp_path, range(4))
    marked = stream(spark, tmp_path).withColumns({"failed": F.col("event_type") == "error", "passed": F.col("event_type") == "purchase"})
    counted = keyed.retry_counters(marked, "user_id", "event_id", "failed", "passed", limit=3)
    path = f"file://{tmp_path}/retries"
    keyed.written(counted, path)
    got = {r.user_id: (r.failures, r.tripped) for r in keyed.latest(keyed.rows(spark, path, counted), "user_id").collect()}
    for u in {r[0] for r in ROWS}:
        n, tripped = 0, False
        for _, _, kind in sorted((r for r in ROWS if r[0] == u), key=lambda r: r[1]):
            n = 0 if kind == "purchase" else n + (kind == "error")
            tripped |= n >= 3
        assert got[u] == (n, tripped)


def test_log_entries_over_batches(spark, tmp_path):
    versions = [
        (1, 1, {"title": "A", "numWords": "1,200", "status": None}),
        (1, 2, {"title": "A", "numWords": "2,500", "status": "Done"}),
        (2, 1, {"title": "B", "numWords": "x"}),
        (2, 2, {"title": "B", "numWords": "7"}),
        (1, 3, {"title": "A2", "numWords": "2,400", "status": ""}),
        (1, 4, {"title": "A2", "numWords": "2,300", "status": "Done"}),
    ]
    for n, (story, version, entries) in enumerate(versions):
        spark.createDataFrame([(story, version, e, v) for e, v in entries.items()], "story bigint, version int, entry string, value string").coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
    read = spark.readStream.schema("story bigint, version int, entry string, value string").option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    found = keyed.log_entries(read, "story", "version", "entry", "value")
    path = f"file://{tmp_path}/entries"
    keyed.written(found, path)
    assert sorted(tuple(r)[:5] for r in keyed.rows(spark, path, found).collect()) == [
        (1, 1, "numWords", "1,200", None),
        (1, 1, "title", "A", None),
        (1, 2, "numWords", "2,500", "1,200"),
        (1, 2, "status", "Done", None),
        (1, 2, "words_added", "1,300", None),
        (1, 3, "numWords", "2,400", "2,500"),
        (1, 3, "title", "A2", "A"),
        (1, 3, "words_added", "-100", "1,300"),
        (1, 4, "numWords", "2,300", "2,400"),
        (2, 1, "numWords", "x", None),
        (2, 1, "title", "B", None),
        (2, 2, "numWords", "7", "x"),
    ]


@pytest.mark.parametrize("kind, values", [("bigint", [2**60 + 1, None, 2**60]), ("timestamp", ["2020-01-01 00:00:01.000001", None, "2020-01-01"]), ("double", [0.1, None, 2.5])])
def test_values_of_other_types(spark, tmp_path, kind, values):
    df = spark.createDataFrame([(1, i, None if v is None else str(v)) for i, v in enumerate(values)], "k int, at bigint, v string").withColumns({"v": F.col("v").cast(kind), "at": F.timestamp_seconds("at")})
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    read = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    found = keyed.log_differences(read, "k", "v", "at")
    keyed.written(found, f"file://{tmp_path}/out")
    got = sorted((r["at"], r.v, r.previous) for r in keyed.rows(spark, f"file://{tmp_path}/out", found).collect())
    want = [r.v for r in df.orderBy("at").collect()]
    assert [(v, p) for _, v, p in got] == list(zip(want, [None, *want]))
