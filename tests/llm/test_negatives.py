from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyflow.llm import negatives
from storyflow.llm.vectors import products
from storyflow.shared import table

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, every=100, noise=True):
    """Scores of every anchor with every row, in Python's integers."""
    kept = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, tuple(int(np.floor(256 * float(x))) for x in v), (label + 1) % 10 if noise and i % 7 == 0 else label))
    out = []
    for i, v, label in sorted({r for r in kept if r[0] % every == 0}):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in kept if j != i)
        for ps, p, _ in [s for s in scored if s[2] == label][:5]:
            hard = [s for s in scored if s[2] != label and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:5]
            out += [(i, p, r, j, -ps, -s) for r, (s, j, _) in enumerate(hard, 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()))


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("cell", "v", "norm", "part", "anchor", "rank", "score")})


def stored(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    return f"file://{tmp_path}"


def test_query_equals_all_scores_and_sql(spark, small):
    got = found(negatives.op12_negatives(spark, small))
    assert got and got == plain([(r.vec_id, r.embedding, r.label) for r in table(spark, small, "embeddings").collect()])
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{small}/embeddings.parquet'")
    assert got == sorted(db.sql(negatives.SQL).select(", ".join(COLUMNS)).fetchall())


def test_many_cells_and_parts_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    middle = rng.normal(0, 1, (12, 64))
    rows = [(i, [float(x) for x in (middle[i % 12] + rng.normal(0, 0.3, 64)) / 8], int(rng.integers(0, 10))) for i in range(1500)]
    rows += [(2000 + i, rows[0][1], i % 2) for i in range(700)]
    want = plain(rows)
    monkeypatch.setattr(negatives, "part_rows", lambda n: 60)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "TOGETHER", 3)
    monkeypatch.setattr(negatives, "SAMPLE", 400)
    monkeypatch.setattr(negatives, "LEAF", 16)
    noisy = frame(spark, rows).withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    assert found(negatives.mined(noisy)) == want


def test_edge_rows(spark, tmp_path):
    same, other = [0.5] * 64, [0.25, -0.5] * 32
    rows = [(i, same, i % 3) for i in range(0, 300, 10)] + [(i, other, 1) for i in range(1, 60, 10)]
    rows += [(100, same, 1)] * 4 + [(210, same, 2)] * 3 + [(200, other, 2)]
    rows += [(None, same, 1), (None, same, None), (400, None, 1), (401, same, None), (402, [None] + same[1:], 2), (500, [float("nan")] * 64, 1), (600, [float("-inf")] * 64, 0)]
    rows += [(700, [], 1), (701, [1.0], 1), (800, [-1.0] * 64, 3), (802, [1.0] * 64, 3), (803, [-0.9] * 64, 4)]
    assert found(negatives.op12_negatives(spark, stored(spark, tmp_path / "a", rows))) == plain(rows)
    assert found(negatives.op12_negatives(spark, stored(spark, tmp_path / "b", []))) == []
    assert found(negatives.op12_negatives(spark, stored(spark, tmp_path / "c", rows[:1]))) == []
    with pytest.raises(Exception, match="in size after scaling"):
        found(negatives.op12_negatives(spark, stored(spark, tmp_path / "d", [(1, [1e30] * 64, 1)])))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 200), st.integers(2, 20), st.integers(1, 40), st.booleans())
def test_bounds_hold_for_every_leaf(seed, n, size, cells, large):
    rng = np.random.default_rng(seed)
    v = rng.integers(-size, size, (n, 5)) * (10**6 if large else 1)
    v[rng.integers(0, n, n // 3)] = v[0]
    norm = (v * v).sum(1)
    tree = negatives.Tree(v, int(norm.max()), cells)
    cell, apart = tree.deal(v, np.sqrt((norm.max() - norm).astype(float)))
    assert sorted(np.concatenate(tree.members)) == list(range(n))
    near, far = np.zeros((len(tree.paths), tree.depth)), np.full((len(tree.paths), tree.depth), np.inf)
    for c in np.unique(cell):
        deep = len(tree.paths[c])
        near[c, :deep], far[c, :deep] = apart[cell == c, :deep].min(0), apart[cell == c, :deep].max(0)
    anchors = v[:20]
    low, high = tree.bounds(anchors, norm[:20], near, far)
    exact = np.sqrt((norm[:20, None] + norm.max() - 2 * products(anchors, v)).astype(float))
    assert (low[:, cell] <= exact).all() and (exact <= high[:, cell]).all()


def test_close_groups_are_pruned():
    rng = np.random.default_rng(2)
    middle = rng.integers(-200, 200, (16, 32))
    v = np.repeat(middle, 200, axis=0) + rng.integers(-3, 4, (3200, 32))
    tree = negatives.Tree(v, int((v * v).sum(1).max()), 64)
    seen = defaultdict(int)
    norm = (v * v).sum(1)
    cell, apart = tree.deal(v, np.sqrt((norm.max() - norm).astype(float)))
    near, far = np.zeros((len(tree.paths), tree.depth)), np.full((len(tree.paths), tree.depth), np.inf)
    for c in np.unique(cell):
        deep = len(tree.paths[c])
        near[c, :deep], far[c, :deep] = apart[cell == c, :deep].min(0), apart[cell == c, :deep].max(0)
    own = v[::200]
    low, _ = tree.bounds(own, norm[::200], near, far)
    outer = negatives.radius(norm[::200], tree.top, norm[::200] - 3000)
    for a, b in zip(*np.nonzero(low <= outer[:, None])):
        seen[a] += 1
    assert max(seen.values()) < 32
