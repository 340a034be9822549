"""Hard-negative mining: rows of another label whose scores lie in a window, by a vantage-point tree.

Vectors become integers, a score is their inner product. A row gets one more
component that brings its norm to the largest one, an anchor gets zero there; then
``distance**2 = |anchor|**2 + largest**2 - 2 * score``, so a window of scores is an
annulus of distances and the best score is nearest. A vantage-point tree, fitted on
a bounded sample, deals all rows into cells; large cells are cut into parts, so no
group of equal vectors meets in one task. What a cell holds (labels, and distances
to the vantage points above it) is aggregated over all its rows. An anchor first
visits the nearest cells, which bounds its k-th score, then every cell whose bounds
meet its annulus within that score. In a cell, a tree of its own orders leaves
nearest first, and they are searched until the bound of the next is beyond the
k-th row found. Scores are exact integers; distances only prune, with slack.

Defined cases: rows with a null id, label or vector or with a null or non-finite
component take no part; shorter vectors count as filled up with zeros. Repeated
rows each count as candidates, but rows of the anchor's own id are never found, and
equal anchors answer once. Ties go to the smaller id. A negative positive_score has
an empty window. An empty table gives no rows. Other columns, whatever their names,
are ignored. A component of 2**23 or more in size after scaling is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyflow.llm.vectors import finite, matrix, products, scaled
from storyflow.shared import cut, drop, table

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 5
#: A negative's score is at least this many hundredths of the positive's.
LEAST = 80
#: Components are smaller than this after scaling, so 100 times a score of up to 1,024 components fits a long.
MOST = 2**23
#: Rows on which the tree of cells is fitted, and the most cells that it has.
SAMPLE, MAX_CELLS = 16_384, 4_096
#: Anchors that are held against a part of a cell at once, and that a task searches with together.
ANCHORS, TOGETHER = 16_384, 256
#: Cells that an anchor visits first.
HOME = 2
LEAF = 64
FAR = 2**62
ROWS = "cell int, vec_id bigint, label int, v array<int>, norm bigint, apart array<double>"
VISITS = "cell int, part int, chunk int, anchor string, vec_id bigint, label int, v array<int>, windows array<struct<lo:bigint,hi:bigint,least:bigint>>"
FOUND = "anchor string, hi bigint, found_id bigint, score bigint"


def part_rows(rows: int) -> int:
    """Rows of a part: few enough for a task, more where there are many rows, so that anchors visit fewer parts."""
    return int(min(32_768, max(1_024, 2 * rows**0.5)))


class Tree:
    """A vantage-point tree over integer rows whose norms are filled up to ``top``.

    A node is cut at the median distance to its vantage point. ``cells`` leaves at
    most, the fullest node being cut first; rows that all lie at one distance, or
    that many cuts have not parted, stay together.
    """

    def __init__(self, v: np.ndarray, top: int, cells: int, least: int = 1):
        self.top, self.points, self.cuts, self.below = top, [], [], []
        self.paths: list[list[int]] = []
        self.members: list[np.ndarray] = []
        extra = np.sqrt(np.maximum(0, top - (v * v).sum(1)).astype(float))
        self.extra = []
        open_, order, count = [(-len(v), 0, np.arange(len(v)), [], None)], 0, 1
        deepest = 2 * cells.bit_length() + 4
        while open_:
            size, _, rows, path, link = heappop(open_)
            split = None
            if count < cells and -size > least and len(path) < deepest:
                # The row farthest from the last vantage point sees the others at the most different distances.
                at = rows[np.argmax(self._apart(v, extra, rows, path[-1]))] if path else rows[0]
                far = self._between(v[rows], extra[rows], v[at], extra[at])
                middle = float(np.partition(far, (len(far) - 1) // 2)[(len(far) - 1) // 2])
                if (far > middle).any():
                    split = far > middle
            if split is None:
                self._link(link, -1 - len(self.paths))
                self.paths.append(path)
                self.members.append(rows)
                continue
            node = len(self.points)
            self._link(link, node)
            self.points.append(v[at])
            self.extra.append(extra[at])
            self.cuts.append(middle)
            self.below.append([0, 0])
            count += 1
            for side, own in enumerate((rows[~split], rows[split])):
                order += 1
                heappush(open_, (-len(own), order, own, [*path, node], (node, side)))
        self.points = np.array(self.points, np.int64).reshape(-1, v.shape[1])
        self.extra, self.cuts = np.array(self.extra, float), np.array(self.cuts, float)
        self.below = np.array(self.below, np.int64).reshape(-1, 2)
        self.depth = max(map(len, self.paths))
        self.path = np.full((len(self.paths), self.depth), -1)
        for i, p in enumerate(self.paths):
            self.path[i, : len(p)] = p

    def _link(self, link, to: int) -> None:
        if link:
            self.below[link[0]][link[1]] = to

    def _apart(self, v, extra, rows, node):
        return self._between(v[rows], extra[rows], self.points[node], self.extra[node])

    def _between(self, v: np.ndarray, extra: np.ndarray, point: np.ndarray, more: float) -> np.ndarray:
        """Distances of filled up rows to one vantage point."""
        square = 2.0 * self.top - 2.0 * (products(v, point[None, :])[:, 0] + extra * more)
        return np.sqrt(np.maximum(square, 0))

    def deal(self, v: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every row's cell, and its distances to the vantage points on the way."""
        cell = np.full(len(v), -1 if not len(self.points) else 0, np.int64)
        apart = np.full((len(v), self.depth), np.nan)
        for level in range(self.depth):
            rows = np.flatnonzero(cell >= 0)
            if not len(rows):
                break
            node = cell[rows]
            inner = np.einsum("ij,ij->i", v[rows], self.points[node]) + extra[rows] * self.extra[node]
            far = np.sqrt(np.maximum(2.0 * self.top - 2.0 * inner, 0))
            apart[rows, level] = far
            cell[rows] = self.below[node, (far > self.cuts[node]).astype(int)]
        return -1 - cell, apart

    def bounds(self, v: np.ndarray, norm: np.ndarray, nearest: np.ndarray, farthest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most distance of every anchor to the rows of every leaf, by the triangle inequality."""
        low, high = np.zeros((len(v), len(self.paths))), np.full((len(v), len(self.paths)), np.inf)
        if len(self.points):
            far = np.sqrt(np.maximum(norm[:, None] + float(self.top) - 2.0 * products(v, self.points), 0))
            for level in range(self.depth):
                own = np.flatnonzero(self.path[:, level] >= 0)
                d = far[:, self.path[own, level]]
                low[:, own] = np.maximum(low[:, own], np.maximum(d - farthest[own, level], nearest[own, level] - d))
                high[:, own] = np.minimum(high[:, own], d + farthest[own, level])
        slack = 1e-6 * (self.top + norm[:, None].astype(float) + 1) ** 0.5
        return np.maximum(low - slack, 0), high + slack


class Held:
    """What the cells of a tree hold, aggregated over all rows."""

    def __init__(self, tree: Tree, rows: list, part: int):
        n = len(tree.paths)
        self.tree, self.parts = tree, np.zeros(n, np.int64)
        self.near, self.far = np.zeros((n, tree.depth)), np.full((n, tree.depth), np.inf)
        self.labels = np.zeros((n, 2), np.int64)
        for r in rows:
            c = r["cell"]
            self.parts[c] = -(-r["n"] // part)
            self.labels[c] = r["low"], r["high"]
            for level in range(len(tree.paths[c])):
                self.near[c, level], self.far[c, level] = r[f"near{level}"], r[f"far{level}"]


def can_hold(low: np.ndarray, high: np.ndarray, label: np.ndarray, same: bool) -> np.ndarray:
    """Whether rows with labels from ``low`` to ``high`` may have the anchor's label, or another."""
    label = label[:, None]
    return (low[None, :] <= label) & (label <= high[None, :]) if same else ~((low == high)[None, :] & (low[None, :] == label))


def radius(norm: np.ndarray, top: int, score: np.ndarray) -> np.ndarray:
    """The distance at which an anchor has a score; scores may lie beyond what any row reaches."""
    return np.sqrt(np.maximum(norm.astype(float) + top - 2.0 * score.astype(float), 0))


class Windows:
    """Windows of scores of a batch of anchors: a row each, with the anchor that it belongs to."""

    def __init__(self, batch, dims: int):
        of = lambda c: batch[c].combine_chunks() if isinstance(batch[c], pa.ChunkedArray) else batch[c]
        self.v, self.label, self.id = matrix(of("v"), dims), of("label").to_numpy().astype(np.int64), of("vec_id").to_numpy()
        self.norm = (self.v * self.v).sum(1)
        windows = of("windows")
        flat = windows.flatten()
        self.of = np.repeat(np.arange(len(self.v)), np.diff(windows.offsets.to_numpy()))
        self.lo, self.hi, self.least = (flat.field(i).fill_null(-FAR).to_numpy() for i in range(3))

    def annuli(self, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Inner and outer radius; the outer one ends at the k-th score that is known."""
        norm = self.norm[self.of]
        return radius(norm, top, self.hi), radius(norm, top, np.maximum(self.lo, self.least))


def visits(anchors: DataFrame, held, same: bool, dims: int, chunks: int, home: int) -> DataFrame:
    """A row for every part of a cell that an anchor visits; with ``home``, the nearest cells only."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Held = held.value
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(start, TOGETHER)
                w = Windows(batch, dims)
                low, high = own.tree.bounds(w.v, w.norm, own.near, own.far)
                inner, outer = w.annuli(own.tree.top)
                low, high = low[w.of], high[w.of]
                meets = (low <= outer[:, None]) & (high >= inner[:, None]) & (own.parts > 0)[None, :]
                meets &= can_hold(own.labels[:, 0], own.labels[:, 1], w.label[w.of], same)
                if home:
                    order = np.where(meets, np.maximum(low, inner[:, None]), np.inf)
                    first = np.argsort(order, axis=1, kind="stable")[:, :home]
                    kept = np.zeros_like(meets)
                    np.put_along_axis(kept, first, True, axis=1)
                    meets &= kept
                wanted = np.zeros((len(w.v), meets.shape[1]), bool)
                np.logical_or.at(wanted, w.of, meets)
                at, cell = np.nonzero(wanted)
                parts = own.parts[cell]
                at, cell = np.repeat(at, parts), np.repeat(cell, parts)
                part = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
                found = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), found["chunk"], *(found[c] for c in ("anchor", "vec_id", "label", "v", "windows"))],
                    names=["cell", "part", "chunk", "anchor", "vec_id", "label", "v", "windows"],
                )

    dealt_out = anchors.withColumn("chunk", F.pmod(F.xxhash64("anchor"), F.lit(chunks)).cast("int"))
    return dealt_out.mapInArrow(dealt, VISITS)


def nearest(w: Windows, v: np.ndarray, ids: np.ndarray, labels: np.ndarray, top: int, same: bool, k: int, leaf: int = LEAF):
    """The first ``k`` rows of every window: (window, id, score) arrays.

    Leaves are visited in the order of their bounds, all windows at once: in each
    step every open window searches its next leaf, and closes when the bound of
    the following one is beyond its k-th row.
    """
    tree = Tree(v, top, max(1, -(-len(v) // leaf)), leaf)
    extra = np.sqrt(np.maximum(0, top - (v * v).sum(1)).astype(float))
    n = len(tree.paths)
    near, far = np.zeros((n, tree.depth)), np.full((n, tree.depth), np.inf)
    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, rows in enumerate(tree.members):
        low[i], high[i] = labels[rows].min(), labels[rows].max()
        for level, node in enumerate(tree.paths[i]):
            d = tree._between(v[rows], extra[rows], tree.points[node], tree.extra[node])
            near[i, level], far[i, level] = d.min(), d.max()
    least, most = tree.bounds(w.v, w.norm, near, far)
    inner, outer = w.annuli(top)
    meets = (least[w.of] <= outer[:, None]) & (most[w.of] >= inner[:, None]) & can_hold(low, high, w.label[w.of], same)
    first = np.where(meets, np.maximum(least[w.of], inner[:, None]), np.inf)
    order = np.argsort(first, axis=1, kind="stable")
    first = np.take_along_axis(first, order, axis=1)
    least_score, norm = w.least.copy(), w.norm[w.of]
    best = (np.zeros(0, np.int64),) * 3
    open_ = np.flatnonzero(first[:, 0] < np.inf)
    for step in range(n):
        open_ = open_[first[open_, step] <= np.minimum(outer[open_], radius(norm[open_], top, least_score[open_]))]
        if not len(open_):
            break
        new = [best]
        for at in np.unique(order[open_, step]):
            own, rows = open_[order[open_, step] == at], tree.members[at]
            anchors, back = np.unique(w.of[own], return_inverse=True)
            score = products(w.v[anchors], v[rows])[back]
            fits = (score >= np.maximum(w.lo, least_score)[own][:, None]) & (score <= w.hi[own][:, None])
            a, b = np.nonzero(fits)
            window, row = own[a], rows[b]
            ok = ((labels[row] == w.label[w.of[window]]) == same) & (ids[row] != w.id[w.of[window]])
            new.append((window[ok], ids[row[ok]], score[a[ok], b[ok]]))
        window, id_, score = (np.concatenate(x) for x in zip(*new))
        by = np.lexsort((id_, -score, window))
        window, id_, score = window[by], id_[by], score[by]
        starts = np.flatnonzero(np.r_[True, window[1:] != window[:-1]]) if len(window) else np.zeros(0, np.int64)
        place = np.arange(len(window)) - np.repeat(starts, np.diff(np.r_[starts, len(window)]))
        full = place == k - 1
        least_score[window[full]] = np.maximum(least_score[window[full]], score[full])
        best = window[place < k], id_[place < k], score[place < k]
    return best


def search(anchors: DataFrame, index: DataFrame, held, same: bool, k: int, dims: int, chunks: int) -> DataFrame:
    """The first ``k`` rows of every window of every anchor, as (anchor, hi, found_id, score), a window being named by its ``hi``."""
    top = held.value.tree.top

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table({"anchor": pa.array([], pa.string()), "hi": pa.array([], pa.int64()), "found_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})]
        if right.num_rows:
            v, ids, labels = matrix(right["v"], dims), right["vec_id"].to_numpy(), right["label"].to_numpy().astype(np.int64)
            for start in range(0, left.num_rows, TOGETHER):
                batch = left.slice(start, TOGETHER).combine_chunks()
                w = Windows(batch, dims)
                window, id_, score = nearest(w, v, ids, labels, top, same, k)
                out.append(pa.table({"anchor": batch["anchor"].take(pa.array(w.of[window])), "hi": pa.array(w.hi[window]), "found_id": pa.array(id_), "score": pa.array(score)}))
        return pa.concat_tables(out).combine_chunks()

    def found(asked: DataFrame, home: int) -> DataFrame:
        visited = visits(asked, held, same, dims, chunks, home)
        wanted = visited.select("cell", "part", "chunk").distinct()
        keys = ["cell", "part", "chunk"]
        rows = index.join(wanted, ["cell", "part"]).select(*[F.col(c).alias(f"its_{c}") for c in keys], "vec_id", "label", "v")
        return visited.groupBy(*keys).cogroup(rows.groupBy(*[f"its_{c}" for c in keys])).applyInArrow(searched, FOUND)

    def ranked(df: DataFrame) -> DataFrame:
        by = Window.partitionBy("anchor", "hi").orderBy(F.desc("score"), "found_id")
        return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    kth = ranked(found(anchors, HOME)).where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("hi", "score"))).alias("kth"))
    asked = anchors.join(kth, "anchor", "left").withColumn("windows", F.transform("windows", lambda w: F.struct(w["lo"].alias("lo"), w["hi"].alias("hi"), F.try_element_at("kth", w["hi"]).alias("least")))).drop("kth")
    return ranked(found(asked, 0))


def mined(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors, the ids that ``every`` divides.

    ``vectors``: vec_id, embedding, label.
    """
    spark = vectors.sparkSession
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
    ints = kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("int").alias("label"), scaled(F.col("embedding"), scale, MOST).alias("v"))
    ints = ints.withColumn("norm", F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint") * x.cast("bigint")))
    total, dims, top = ints.agg(F.count("*"), F.max(F.size("v")), F.max("norm")).first()
    dims, top = max(1, dims or 0), top or 0
    part = part_rows(total)
    sample = ints.select("v").sample(min(1.0, SAMPLE / max(1, total)), 7).limit(2 * SAMPLE).toArrow() if total else None
    fitted = matrix(sample["v"], dims) if sample is not None and sample.num_rows else np.zeros((1, dims), np.int64)
    tree = Tree(fitted, top, min(MAX_CELLS, max(1, -(-4 * total // (3 * part)))))
    shared_tree = spark.sparkContext.broadcast(tree)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Tree = shared_tree.value
        for batch in batches:
            v = matrix(batch["v"], dims)
            extra = np.sqrt(np.maximum(0, own.top - batch["norm"].to_numpy()).astype(float))
            cell, apart = own.deal(v, extra)
            apart = pa.FixedSizeListArray.from_arrays(pa.array(apart.ravel()), own.depth).cast(pa.list_(pa.float64())) if own.depth else pa.array([[]] * len(v), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch["vec_id"], batch["label"], batch["v"], batch["norm"], apart], names=["cell", "vec_id", "label", "v", "norm", "apart"])

    index, path = cut(ints.mapInArrow(dealt, ROWS), "vectors")
    levels = [f(F.col("apart")[i]).alias(f"{name}{i}") for i in range(tree.depth) for f, name in ((F.min, "near"), (F.max, "far"))]
    cells = index.groupBy("cell").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), *levels).collect()
    held = spark.sparkContext.broadcast(Held(tree, cells, part))
    parts = F.array(*[F.lit(int(p)) for p in held.value.parts])
    parted = index.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.element_at(parts, F.col("cell") + 1)).cast("int"))

    own = index.where(F.col("vec_id") % every == 0).groupBy("vec_id", "label", "v").agg(F.count("*").alias("n"))
    own = own.withColumn("anchor", F.sha2(F.concat_ws(",", F.col("vec_id").cast("string"), F.col("label").cast("string"), F.col("v").cast("array<string>")), 256)).drop("n")
    anchors, anchors_path = cut(own, "anchors")
    chunks = max(1, -(-anchors.count() // ANCHORS))

    def windows(lo, hi):
        return F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"), F.lit(None).cast("bigint").alias("least"))

    asked = anchors.withColumn("windows", F.array(windows(F.lit(-FAR), F.lit(FAR))))
    near = search(asked, parted, held, True, positives, dims, chunks).select("anchor", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near, near_path = cut(near, "positives")
    lo = F.expr(f"({least} * positive_score + 99) div 100")
    annuli = near.where("positive_score >= 0").groupBy("anchor").agg(F.collect_set(windows(lo, F.col("positive_score"))).alias("windows"))
    hard = search(anchors.join(annuli, "anchor"), parted, held, False, negatives, dims, chunks)
    result = near.join(hard, [near["anchor"] == hard["anchor"], near["positive_score"] == hard["hi"]]).drop(hard["anchor"])
    result = result.join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    done, _ = cut(result.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    for used in (path, anchors_path, near_path):
        drop(spark, used)
    return done


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", noisy.alias("label")))


SQL = f"""with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor({SCALE} * cast(x as double))) v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
scored as (select a.vec_id anchor_id, b.vec_id, a.label = b.label same, cast(list_dot_product(a.v, b.v) as bigint) score from v a join v b on a.vec_id % {EVERY} = 0 and a.vec_id <> b.vec_id),
positives as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) r from scored where same qualify r <= {POSITIVES}),
hard as (select p.anchor_id, p.vec_id positive_id, n.vec_id negative_id, p.score positive_score, n.score negative_score,
  row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) r
  from positives p join scored n on n.anchor_id = p.anchor_id and not n.same and {LEAST} * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score)
select anchor_id, positive_id, cast(r as int) rank, negative_id, positive_score, negative_score from hard where r <= {NEGATIVES}"""
