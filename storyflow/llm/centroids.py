"""Centroid clustering of integer vectors with Hamerly's bounds.

Every vector keeps its cluster, an upper bound of the distance to its own centroid
and one lower bound of the distance to the second nearest. When centroids move,
the bounds are loosened by how far; only a vector whose bounds overlap measures its
own distance anew, and only if they still overlap is it held against all centroids,
in exact integers. The table of vectors and bounds is written after every round.
Sums of a cluster change by the vectors that left or joined it: tasks add these up,
and clusters x dimensions numbers reach the driver, which floors the means.

Defined cases: vectors of another length, null ones and ones with a null or
non-finite component take no part. A null id is clustered like any other but can't
name a first centroid. Rows of one id each count; ties for a first centroid go to
the smaller vector. Fewer vectors than clusters give fewer centroids, an empty
table no rows. Other columns, whatever their names, are ignored. A component of
2**27 or more in size after scaling (at 64 dimensions) is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyflow.llm.vectors import finite, largest, matrix, products, scaled
from storyflow.shared import cut, drop, table

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
#: Bounds are widened by this share of themselves and this much, far more than floats lose in a round.
SLACK = 1e-9
STATE = "vec_id bigint, v array<int>, cluster int, upper double, lower double, left_from int, distance bigint"


def integers(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """The rows that take part, as (vec_id, v)."""
    kept = vectors.where((F.size("embedding") == dims) & finite(F.col("embedding")))
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled(F.col("embedding"), scale, largest(dims)).alias("v"))


def first_centroids(ints: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids have the smallest digests, in their order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = ints.where("vec_id is not null").orderBy(digest, "v").select("v").limit(clusters).collect()
    return np.array([r.v for r in rows], np.int64)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    return (v * v).sum(1)[:, None] - 2 * products(v, centroids) + (centroids * centroids).sum(1)[None, :]


class Bounds:
    """One pass over vectors, given where centroids are and how far they came."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        k = len(centroids)
        self.centroids = centroids
        moved = np.zeros(k) if before is None else np.sqrt(((centroids - before) ** 2).sum(1).astype(np.float64))
        self.moved = moved * (1 + SLACK)
        self.others = np.array([np.delete(self.moved, c).max(initial=0) for c in range(k)])
        apart = np.sqrt(distances(centroids, centroids).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(1) / 2 * (1 - SLACK)

    def own(self, v: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        apart = v - self.centroids[cluster]
        return (apart * apart).sum(1)

    def assign(self, v, cluster, upper, lower, exact: bool):
        """New (cluster, upper, lower, distance); distances are all measured if ``exact``."""
        cluster = cluster.copy()
        upper = (upper + self.moved[cluster]) * (1 + SLACK)
        lower = lower * (1 - SLACK) - self.others[cluster] - SLACK
        safe = np.maximum(lower, self.half[cluster])
        distance = np.zeros(len(v), np.int64)
        near = np.arange(len(v)) if exact else np.flatnonzero(~(upper < safe))
        distance[near] = self.own(v[near], cluster[near])
        upper[near] = np.sqrt(distance[near]) * (1 + SLACK)
        open_ = near[~(upper[near] < safe[near])]
        if len(open_):
            all_ = distances(v[open_], self.centroids)
            rows, best = np.arange(len(open_)), all_.argmin(1)
            cluster[open_], distance[open_] = best, all_[rows, best]
            upper[open_] = np.sqrt(distance[open_]) * (1 + SLACK)
            rest = all_.astype(np.float64)
            rest[rows, best] = np.inf
            lower[open_] = np.sqrt(rest.min(1)) * (1 - SLACK)
        return cluster, upper, lower, distance


def _round(state: DataFrame, bounds: Bounds, dims: int, exact: bool, first: bool) -> DataFrame:
    held = state.sparkSession.sparkContext.broadcast(bounds)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, v = batch.num_rows, matrix(batch["v"], dims)
            if first:
                cluster, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n)
            else:
                cluster, upper, lower = (batch[c].to_numpy().astype(t) for c, t in (("cluster", np.int64), ("upper", float), ("lower", float)))
            new, upper, lower, distance = held.value.assign(v, cluster, upper, lower, exact)
            left = pa.nulls(n, pa.int32()) if first else pa.array(cluster.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(new.astype(np.int32)), pa.array(upper), pa.array(lower), left, pa.array(distance)], names=["vec_id", "v", "cluster", "upper", "lower", "left_from", "distance"])

    return state.mapInArrow(assigned, STATE)


def _changes(state: DataFrame, clusters: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """By how many vectors, and by how much in sum, clusters have grown."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(clusters, np.int64), np.zeros((clusters, dims), np.int64)
        for batch in batches:
            v = matrix(batch["v"], dims)
            for column, sign in (("cluster", 1), ("left_from", -1)):
                c = batch[column].fill_null(-1).to_numpy()
                for k in np.unique(c[c >= 0]):
                    count[k] += sign * (c == k).sum()
                    total[k] += sign * v[c == k].sum(0)
        used = np.flatnonzero((count != 0) | total.any(1))
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(used.astype(np.int32)), "n": pa.array(count[used]), "total": pa.array(total[used].tolist(), pa.list_(pa.int64()))})

    moved = state.where("left_from is null or left_from <> cluster").select("cluster", "left_from", "v")
    parts = moved.mapInArrow(added, "cluster int, n bigint, total array<bigint>")
    wide = parts.select("cluster", F.posexplode(F.concat(F.array("n"), "total")).alias("at", "x"))
    sums = wide.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect()
    count, total = np.zeros(clusters, object), np.zeros((clusters, dims), object)
    for r in sums:
        if r["at"]:
            total[r["cluster"], r["at"] - 1] = int(r["x"])
        else:
            count[r["cluster"]] = int(r["x"])
    return count, total


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, upper, lower, left_from, distance) of every vector, and the final centroids."""
    state, path = integers(vectors, dims, scale), None
    centroids = first_centroids(state, clusters, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], STATE), centroids
    k, before = len(centroids), None
    count, total = np.zeros(k, object), np.zeros((k, dims), object)
    for turn in range(rounds + 1):
        last = path
        state, path = cut(_round(state, Bounds(centroids, before), dims, turn == rounds, turn == 0), "clusters")
        if last:
            drop(state.sparkSession, last)
        if turn < rounds:
            n, x = _changes(state, k, dims)
            count, total, before = count + n, total + x, centroids
            centroids = np.array([[t // c for t in ts] if c else list(old) for c, ts, old in zip(count, total, centroids)], np.int64)
    return state, centroids


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, centroids = clustered(table(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    k = max(1, len(centroids))
    each = F.array(*[F.lit(int(sums.get(c, 0))).cast("bigint") for c in range(k)])
    names = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids.tolist()] or [F.lit(None).cast("string")])
    return state.select(
        "vec_id",
        "cluster",
        "distance",
        F.element_at(each, F.col("cluster") + 1).alias("cluster_inertia"),
        F.lit(int(sum(sums.values()))).cast("bigint").alias("inertia"),
        F.element_at(names, F.col("cluster") + 1).alias("centroid_sha256"),
    )


def _sql() -> str:
    ctes = [
        f"kept as (select vec_id, row_number() over () r, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) v from embeddings where len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMS})",
        f"c0 as (select row_number() over (order by sha256('{SEED}:' || vec_id), v) - 1 c, v from kept where vec_id is not null qualify c < {CLUSTERS})",
    ]
    for t in range(ROUNDS + 1):
        ctes.append(f"a{t} as (select r, any_value(k.vec_id) vec_id, any_value(k.v) v, min({{'d': cast(list_dot_product(k.v::double[], k.v::double[]) + list_dot_product(c.v::double[], c.v::double[]) - 2 * list_dot_product(k.v::double[], c.v::double[]) as bigint), 'c': c.c}}) m from kept k, c{t} c group by r)")
        if t < ROUNDS:
            ctes += [
                f"s{t} as (select m.c c, generate_subscripts(v, 1) i, unnest(v) x from a{t})",
                f"n{t} as (select c, list(cast((s - ((s % n + n) % n)) // n as bigint) order by i) v from (select c, i, sum(x) s, count(*) n from s{t} group by c, i) group by c)",
                f"c{t + 1} as (select c0.c, coalesce(n.v, c0.v) v from c{t} c0 left join n{t} n on n.c = c0.c)",
            ]
    return f"with {', '.join(ctes)} select a.vec_id, cast(a.m.c as int) cluster, a.m.d distance, cast(sum(a.m.d) over (partition by a.m.c) as bigint) cluster_inertia, cast(sum(a.m.d) over () as bigint) inertia, sha256(array_to_string(c.v, ',')) centroid_sha256 from a{ROUNDS} a join c{ROUNDS} c on c.c = a.m.c"


SQL = _sql()
