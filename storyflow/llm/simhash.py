"""SimHash near-duplicates by a hierarchical index in Gray order.

1. A task fingerprints whole texts; equal fingerprints then count once.
2. Fingerprints are sorted by Gray rank and cut into blocks of about
   ``BLOCK`` at quantiles of the rank. A block's upper node is the bit pattern
   that all its members share. There are at most ``MAX_BLOCKS`` such nodes, 16
   bytes each, so they can be broadcast at any size of the input.
3. Every fingerprint descends the tree over the upper nodes; a node is left
   once the differences accumulated from the root exceed the radius. It is sent
   to the surviving blocks at or after its own.
4. A block's members form a tree of the same kind that its queries descend.
   Links are exact comparisons at the leaves. Of the links that a task finds it
   returns a spanning forest, never all pairs.
5. Alternating large-star and small-star rounds turn links into components.
   Rounds are cut by tables in the shared folder.

Defined cases: a text without words (null, empty) has fingerprint 0 and links
like any other. A component's id is its smallest non-null doc_id, null if it
has none. Repeated rows stay rows. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyflow.llm.arrowtext import text_column
from storyflow.llm.names import unused
from storyflow.shared import cut, drop, table

SHINGLE, RADIUS, SEED = 3, 2, 42
BLOCK, MAX_BLOCKS = 1024, 1 << 14
#: Children of a node of the tree.
FAN = 8
#: Queries that descend the upper nodes, and the tree of a block, together. A
#: query has at most 2,081 fingerprints within two bits, so this bounds memory.
BATCH, LINK_BATCH = 2048, 512
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """Majority of the bits of all shingles' XXH64, as an unsigned integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size))))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, SEED) for s in shingles), np.uint64))


def fingerprints(size: int = SHINGLE) -> "callable":
    """Column function: text to fingerprint, the 64 bits as a signed bigint."""

    def found(texts: list[bytes | None]) -> pa.Array:
        return pa.array(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))

    return text_column(found, "bigint")


def gray_rank(fp: Column) -> Column:
    """Place in Gray order, as a bigint that sorts like the unsigned rank."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _rank(fp: np.ndarray) -> np.ndarray:
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> np.uint64(k))
    return (fp ^ np.uint64(1 << 63)).view(np.int64)


class GrayTree:
    """Nodes over consecutive patterns; a child keeps the bits its parent has not.

    Leaves are patterns: bits ``fixed`` (all, for fingerprints) with the values
    in ``bits``. Searching adds up the differences of each node's own bits and
    leaves a branch once they exceed the radius.
    """

    def __init__(self, bits: np.ndarray, fixed: np.ndarray):
        low, high = bits & fixed, bits | ~fixed
        levels = [(low, high)]
        while len(low) > FAN:
            starts = np.arange(0, len(low), FAN)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            levels.append((low, high))
        self.levels = []
        above = None
        for low, high in reversed(levels):
            mask = ~(low ^ high)
            own = mask if above is None else mask & ~np.repeat(above, FAN)[: len(mask)]
            self.levels.append((low, own))
            above = mask

    def search(self, queries: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, leaf) that differ in at most ``radius`` fixed bits."""
        bits, own = self.levels[0]
        q = np.repeat(np.arange(len(queries)), len(bits))
        node = np.tile(np.arange(len(bits)), len(queries))
        far = np.bitwise_count((queries[q] ^ bits[node]) & own[node])
        near = far <= radius
        q, node, far = q[near], node[near], far[near]
        for bits, own in self.levels[1:]:
            node = (node[:, None] * FAN + np.arange(FAN)).ravel()
            q, far = np.repeat(q, FAN), np.repeat(far, FAN)
            there = node < len(bits)
            q, node, far = q[there], node[there], far[there]
            far = far + np.bitwise_count((queries[q] ^ bits[node]) & own[node])
            near = far <= radius
            q, node, far = q[near], node[near], far[near]
        return q, node


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that the pairs connect it to."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while ((up := root[root]) != root).any():
                root = up
    return root


def _links(group: pa.Table) -> pa.Table:
    """Links of one block's queries, as (fingerprint, smallest it reaches)."""
    fps = group.column("fp").to_numpy().view(np.uint64)
    inside = group.column("member").to_numpy(zero_copy_only=False).astype(bool)
    members, queries = np.unique(fps[inside]), np.unique(fps[~inside])
    members = members[np.argsort(_rank(members))]
    nodes = np.union1d(members, queries)
    if not len(members) or not len(queries):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    tree = GrayTree(members, np.full(len(members), _ALL))

    def pairs():
        for at in range(0, len(queries), LINK_BATCH):
            part = queries[at : at + LINK_BATCH]
            q, m = tree.search(part)
            yield np.searchsorted(nodes, part[q]), np.searchsorted(nodes, members[m])

    root = spanning(len(nodes), pairs())
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.table({"a": nodes[moved].view(np.int64), "b": nodes[root[moved]].view(np.int64)})


def links(distinct: DataFrame) -> DataFrame:
    """Links between different fingerprints of a table of them (column ``fp``).

    Columns a, b. Any two fingerprints within the radius are connected by these
    links; each link is such a pair or follows from some.
    """
    spark = distinct.sparkSession
    ranked = distinct.select("fp", gray_rank(F.col("fp")).alias("rank"))
    n = ranked.count()
    blocks = min(MAX_BLOCKS, max(1, n // BLOCK))
    shares = [k / blocks for k in range(1, blocks)]
    bounds = ranked.agg(F.percentile_approx("rank", shares, 10 * blocks)).first()[0] if shares and n else []
    bounds = spark.sparkContext.broadcast(np.unique(np.array(bounds, np.int64)))
    salts = 4 * min(16, -(-n // (BLOCK * MAX_BLOCKS)) or 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.searchsorted(bounds.value, batch.column("rank").to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(block, pa.int32())], names=["fp", "block"])

    placed = ranked.mapInArrow(place, "fp bigint, block int")
    upper = placed.groupBy("block").agg(F.expr("bit_and(fp)").alias("low"), F.expr("bit_or(fp)").alias("high")).toPandas().sort_values("block")
    upper = spark.sparkContext.broadcast(tuple(upper[c].to_numpy() for c in ("block", "low", "high")))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, low, high = upper.value
        low, high = low.astype(np.int64).view(np.uint64), high.astype(np.int64).view(np.uint64)
        tree = GrayTree(low, ~(low ^ high))
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            block = batch.column("block").to_numpy()
            for at in range(0, len(fp), BATCH):
                own, mine = fp[at : at + BATCH], block[at : at + BATCH]
                q, node = tree.search(own.view(np.uint64))
                later = names[node] >= mine[q]
                q, node = q[later], node[later]
                k = len(own)
                to = np.concatenate([np.repeat(mine, salts), names[node]]).astype(np.int32)
                salt = np.concatenate([np.tile(np.arange(salts), k), (mine[q] + at + q) % salts]).astype(np.int32)
                member = np.concatenate([np.ones(k * salts, bool), np.zeros(len(q), bool)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.repeat(own, salts), own[q]])), pa.array(to), pa.array(salt), pa.array(member)], names=["fp", "block", "salt", "member"])

    routed = placed.mapInArrow(route, "fp bigint, block int, salt int, member boolean")
    return routed.groupBy("block", "salt").applyInArrow(_links, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """Columns node, root: every linked node and the smallest node it reaches."""
    edges, path = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    spark, state = links.sparkSession, None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = down.union(least.select("a", F.col("m").alias("b"))).distinct()
        edges, newer = cut(small, "links")
        drop(spark, path)
        path = newer


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, key, fp, root, component_id.

    ``key`` is the text's SHA-256 (null for a null text), ``fp`` its fingerprint
    as a bigint, ``root`` the component's smallest fingerprint.
    """
    own, _ = cut(docs.select(F.col(doc_id).alias("doc_id"), F.sha2(F.col(text), 256).alias("key"), fingerprints()(F.col(text)).alias("fp")), "fingerprints")
    distinct, _ = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct))
    group = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = group.groupBy("root").agg(F.min("first").alias("component_id"))
    named = group.join(ids, "root").select("fp", "root", "component_id")
    return own.join(named, "fp").select("doc_id", "key", "fp", "root", "component_id")


def _row_key(doc_id: Column, key: Column) -> Column:
    """A never-null key of an id and a text, by which rows meet in a single shuffle."""
    return F.sha2(F.concat_ws(":", F.when(doc_id.isNull(), "none").otherwise(F.concat(F.lit("id "), doc_id.cast("string"))), F.coalesce(key, F.lit("none"))), 256)


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", groups: Callable[[DataFrame, str, str], DataFrame] = near_duplicates) -> DataFrame:
    """``docs`` with one row of each component: smallest id (nulls last), then key.

    ``groups`` gives doc_id, key and root of every row.
    """
    found = groups(docs, doc_id, text)
    row, best_row = unused(docs, "row_key"), unused(docs, "best_row_key")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("b")
    best = found.groupBy("root").agg(least).select(_row_key(F.col("b.doc_id"), F.col("b.key")).alias(best_row))
    keyed = docs.withColumn(row, _row_key(F.col(doc_id), F.sha2(F.col(text), 256)))
    return keyed.join(best, F.col(row) == F.col(best_row), "left_semi").dropDuplicates([row]).select(docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
