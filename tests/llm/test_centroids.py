import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from storyflow.llm import centroids
from storyflow.shared import table

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain(rows, k=16, rounds=3):
    """Plain scans of all centroids, with Python's integers."""
    kept = [(i, tuple(int(np.floor(64 * float(x))) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    means = [v for _, v in sorted(((i, v) for i, v in kept if i is not None), key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    if not means:
        return []
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(means)) for _, v in kept]
        if turn < rounds:
            for c in range(len(means)):
                own = [v for (_, v), (_, at) in zip(kept, near) if at == c]
                means[c] = tuple(sum(x) // len(own) for x in zip(*own)) if own else means[c]
    each = {c: sum(d for d, at in near if at == c) for c in range(len(means))}
    return [(i, c, d, each[c], sum(each.values()), hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, near)]


def found(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=repr)


def stored(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("cluster", "v", "upper", "distance", "n", "at")})
    df.write.parquet(f"file://{tmp_path}/embeddings.parquet")
    return f"file://{tmp_path}"


def test_query_equals_plain_scans_and_sql(spark, small):
    got = found(centroids.op11_centroids(spark, small))
    rows = [(r.vec_id, r.embedding) for r in table(spark, small, "embeddings").collect()]
    assert got == sorted(plain(rows), key=repr)
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{small}/embeddings.parquet'")
    assert got == sorted(db.sql(centroids.SQL).select(", ".join(COLUMNS)).fetchall(), key=repr)


def test_edge_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 64) / 64], 1) for i in range(60)]
    same = [0.5] * 64
    rows += [(100 + i % 3, same, 2) for i in range(40)] + [(None, same, 1), (None, [0.25] * 64, None)]
    rows += [(200, None, 1), (201, [], 1), (202, [1.0] * 63, 1), (203, [1.0] * 63 + [None], 1), (204, [float("nan")] * 64, 1), (205, [float("inf")] + [0.0] * 63, 1)]
    got = found(centroids.op11_centroids(spark, stored(spark, tmp_path / "a", rows)))
    assert len(got) == 102 and got == sorted(plain([r[:2] for r in rows]), key=repr)


def test_few_and_no_vectors(spark, tmp_path):
    rows = [(1, [0.0] * 64, 1), (2, [1.0] * 64, 1), (2, [1.0] * 64, 1)]
    assert found(centroids.op11_centroids(spark, stored(spark, tmp_path / "a", rows))) == sorted(plain([r[:2] for r in rows]), key=repr)
    assert found(centroids.op11_centroids(spark, stored(spark, tmp_path / "b", []))) == []
    assert found(centroids.op11_centroids(spark, stored(spark, tmp_path / "c", [(None, [1.0] * 64, 1)]))) == []


def test_bounds_spare_scans_and_never_differ():
    rng = np.random.default_rng(5)
    places = rng.integers(-200, 200, (8, 16))
    v = places[rng.integers(0, 8, 3000)] + rng.integers(-9, 10, (3000, 16))
    means, before, k = v[:8].copy(), None, 8
    cluster, upper, lower = np.zeros(3000, np.int64), np.full(3000, np.inf), np.zeros(3000)
    for turn in range(12):
        bounds = centroids.Bounds(means, before)
        scanned = []
        own, bounds.own = bounds.own, lambda a, b, own=bounds.own: scanned.append(len(a)) or own(a, b)
        cluster, upper, lower, _ = bounds.assign(v, cluster, upper, lower, False)
        assert (cluster == centroids.distances(v, means).argmin(1)).all()
        before, means = means, np.array([v[cluster == c].sum(0) // max(1, (cluster == c).sum()) if (cluster == c).any() else means[c] for c in range(k)])
    assert sum(scanned) < 100


def test_large_components_stay_exact_or_are_refused(spark, tmp_path):
    rows = [(i, [float((i * 7919 + j * 104729) % 65537 * 30 - 10**6) for j in range(64)], 1) for i in range(40)]
    assert found(centroids.op11_centroids(spark, stored(spark, tmp_path / "a", rows))) == sorted(plain([r[:2] for r in rows]), key=repr)
    with pytest.raises(Exception, match="in size after scaling"):
        found(centroids.op11_centroids(spark, stored(spark, tmp_path / "b", [(1, [1e30] * 64, 1)])))
