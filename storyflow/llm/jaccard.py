"""Near-duplicates by the Jaccard similarity of word shingles, without a miss.

1. A task hashes a text's shingles (XXH64). Texts with equal sets of hashes then
   count once, as a set. Sets are named by 64 bits and told apart by 64 more.
2. A set's shingles are put in an order: those that a sample of texts does not
   repeat first, then by how many sampled texts have them. Two sets of a similarity
   of ``least`` or more share one of their first ``n - ceil(least * n) + 1``
   shingles in any order, whichever it is; the sample only decides how few sets
   share one. So only these name buckets, and frequent passages seldom do.
3. Where the first common shingle of a similar pair lies in both is bounded by
   what may follow it: pairs that miss this are passed over, and a bucket in which
   no set can be the shorter one of a pair is dropped.
4. The Gray-order index of ``simhash`` names near copies first: sets whose
   fingerprints, of the same shingles, differ in few bits. Those that are similar,
   compared as below, are components from the start. What is less alike than the
   index reaches is left to the buckets.
5. Then rounds: each set is compared with one other, the first of all that are the
   first of one of its buckets; linked sets become components, and only pairs
   between components are left. First comes what has fewest shingles of its own, as the
   text has that a group's others are copies of; later rounds take others, while
   they find links and more than ``PAIRS`` a set may be left. So copies of one text,
   however many, take a comparison a set, and no link between components is lost.
6. What is left is compared pair by pair. A pair is named by the first bucket that
   it shares: a set's row has the ``BEFORE`` buckets before it, and where two sets
   share one of those, an earlier bucket has named them.
   Sets are compared by counts of their hashes in cells, which bound what they have
   in common, then exactly.

Defined cases: words are those between ASCII white space, A-Z in lower case. A
text of fewer words than a shingle is one shingle; texts without words are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyflow.llm.arrowtext import text_column
from storyflow.llm.simhash import SEED, components, majority
from storyflow.llm.simhash import links as index_links
from storyflow.shared import cut, drop

SHINGLE, SIMILARITY, PAIRS = 5, 0.8, 64
#: Pairs a set that are looked at, by place and size alone, to see how many may link.
LOOKED = 2_000
#: Cells by which two sets' hashes are counted before they are compared.
CELLS = 256
#: Pairs that are named to every task, 16 bytes each; more are joined by a shuffle, as what is compared always is.
NAMED = 250_000
#: Buckets of a set before a bucket of its, by which two sets' first common one is known.
BEFORE = 4
#: Texts that are looked at for frequent shingles, in how many of them a shingle counts as one, and the most that are named to every task.
SAMPLE, REPEATED, FREQUENT = 4_096, 3, 262_144
#: Texts that are named to every task, 64 bytes each; more are joined by a shuffle.
BROADCAST = 500_000
#: Shared buckets that are named to every task, 8 bytes each; more are joined by a shuffle.
BUCKETS = 2_000_000
_SLACK = 1e-6


def hashes(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted different XXH64 hashes of a text's shingles."""
    words = (text or b"").lower().split()
    shingles = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in shingles), np.uint64))


def first_shingles(own: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The shingles of a set of which it shares one with any similar set; ``frequent``: sorted hashes and their counts."""
    known, counts = frequent
    if len(known):
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        own = own[np.lexsort((own, np.where(known[at] == own, counts[at], 0)))]
    return own[: len(own) - int(np.ceil(least * len(own) - _SLACK)) + 1]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = pa.array(np.append(0, np.cumsum([len(o) for o in arrays], dtype=np.int64)).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def _names(owns: list[np.ndarray], seed: int) -> pa.Array:
    return pa.array(np.array([xxhash.xxh64_intdigest(o.tobytes(), seed) for o in owns], np.uint64).view(np.int64))


def sets(frequent, size: int = SHINGLE, least: float = SIMILARITY) -> "callable":
    """Column function: struct<set, other, n, first, fp> of a text: two hashes of its set, the set's size, its first shingles and its fingerprint."""

    def found(texts: list[bytes | None]) -> pa.Array:
        owns = [hashes(t, size) for t in texts]
        first = _lists([first_shingles(o, frequent.value, least) for o in owns])
        fp = pa.array(np.array([majority(o) for o in owns], np.uint64).view(np.int64))
        return pa.StructArray.from_arrays([_names(owns, SEED), _names(owns, SEED + 1), pa.array([len(o) for o in owns], pa.int32()), first, fp], names=["set", "other", "n", "first", "fp"])

    return text_column(found, "struct<set:bigint,other:bigint,n:int,first:array<bigint>,fp:bigint>")


def shingles(size: int = SHINGLE) -> "callable":
    """Column function: hashes of a text's shingles."""
    return text_column(lambda texts: _lists([hashes(t, size) for t in texts]), "array<bigint>")


def frequent_shingles(texts: DataFrame, size: int = SHINGLE):
    """Broadcast (sorted hashes, counts) of shingles that several texts of a bounded sample have. Any sample gives the same result."""
    n = max(1, texts.count())
    sample = texts.sample(min(1.0, SAMPLE / n), 7).limit(2 * SAMPLE)
    counted = sample.select(F.explode(shingles(size)(F.col("text"))).alias("h")).groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") >= REPEATED)
    rows = counted.orderBy(F.desc("k"), "h").limit(FREQUENT).toArrow()
    known, counts = rows["h"].to_numpy().view(np.uint64), rows["k"].to_numpy()
    order = np.argsort(known)
    return texts.sparkSession.sparkContext.broadcast((known[order], counts[order]))


def _told_apart(own: DataFrame) -> DataFrame:
    """Different sets of one name get names of their own."""
    clashing = own.groupBy("set").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo < hi").select("set", F.lit(True).alias("clash"))
    if clashing.isEmpty():
        return own
    return own.join(clashing, "set", "left").withColumn("set", F.when(F.col("clash"), F.xxhash64("set", "other")).otherwise(F.col("set"))).drop("clash")


def _can_begin(least: float) -> Column:
    """Whether a bucket's shingle may be the first common one with a set of the same size or more."""
    return (1 + least) * (F.col("n") - F.col("at")) + _SLACK >= 2 * least * F.col("n")


def _may_link(least: float, x: str = "", y: str = "its_") -> Column:
    """Whether a bucket's shingle may be the first common one of two sets."""
    n, at, m, to = (F.col(c) for c in (f"{x}n", f"{x}at", f"{y}n", f"{y}at"))
    return (1 + least) * F.least(n - at, m - to) + _SLACK >= least * (n + m)


def counts(size: int = SHINGLE) -> "callable":
    """Column function: how many of a text's shingle hashes fall into each of ``CELLS`` cells; null where one is too full to say."""

    def found(texts: list[bytes | None]) -> pa.Array:
        each = [np.bincount((hashes(t, size) >> np.uint64(7)).astype(np.int64) % CELLS, minlength=CELLS) for t in texts]
        return pa.array([None if e.max() > 32_767 else e.astype(np.int16) for e in each], pa.list_(pa.int16()))

    return text_column(found, "array<smallint>")


def _of_sets(pairs: DataFrame, own: DataFrame, texts: DataFrame, column: "callable") -> tuple[DataFrame, str]:
    """(set, value) for every set of ``pairs``, from one of its texts."""
    key = F.coalesce("key", F.sha2(F.lit(""), 256))
    sets_ = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    named = own.select("set", "key").join(sets_, "set", "left_semi")
    wanted, path = cut(named.groupBy("set").agg(F.min(key).alias("key")), "wanted")
    if wanted.count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    rows = texts.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256)).join(wanted, "key")
    held = cut(rows.select("set", column(F.col("text")).alias("value")).dropDuplicates(["set"]), "held")
    drop(texts.sparkSession, path)
    return held


def _both(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs with both sets' values; the values meet in shuffles, never on the driver."""
    if pairs.count() <= NAMED:
        pairs = F.broadcast(pairs)
    x, y = held.select(F.col("set").alias("a"), F.col("value").alias("x")), held.select(F.col("set").alias("b"), F.col("value").alias("y"))
    return x.join(pairs, "a").join(y.hint("merge"), "b")


def _similar(pairs: DataFrame, own: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """Links (a, b) that join the same sets as all similar pairs do, written.

    Counts by cells of the hashes bound from above what two sets have in common;
    only pairs that pass have their hashes compared. First each set is compared with
    the smallest one that it is paired with; then the pairs between the components
    that this gives.
    """
    spark = pairs.sparkSession
    told, first = _of_sets(pairs, own, texts, counts(size))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    may = (1 + least) * F.aggregate(F.zip_with("x", "y", lambda a, b: F.least(a, b)), F.lit(0), lambda a, x: a + x) + _SLACK >= least * (total(F.col("x")) + total(F.col("y")))
    near, second = cut(_both(pairs, told).where(F.coalesce(may, F.lit(True))).select("a", "b"), "near")
    held, third = _of_sets(near, own, texts, shingles(size))
    common = F.size(F.array_intersect("x", "y"))

    def compared(some: DataFrame) -> tuple[DataFrame, str]:
        return cut(_both(some, held).where(common / (F.size("x") + F.size("y") - common) >= least).select("a", "b"), "similar")

    begun, _ = compared(near.groupBy("a").agg(F.min("b").alias("b")))
    roots = components(begun)
    named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    rest = near.join(named("a"), "a", "left").join(named("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    others, fourth = cut(rest.join(near.groupBy("a").agg(F.min("b").alias("b")), ["a", "b"], "left_anti").select("a", "b"), "others")
    found = begun.union(compared(others)[0])
    for path in (first, second, third, fourth):
        drop(spark, path)
    return found


def by_index(own: DataFrame, texts: DataFrame, size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between similar sets that the Gray-order index names, written.

    Sets of one fingerprint are compared with the smallest of them, and those with
    the smallest of each fingerprint that the index links to theirs.
    """
    spark = own.sparkSession
    firsts, first = cut(own.groupBy("fp").agg(F.min("set").alias("of_fp")), "fingerprints")
    named = lambda fp, of: firsts.select(F.col("fp").alias(fp), F.col("of_fp").alias(of))
    across = index_links(firsts.select("fp")).join(named("a", "x"), "a").join(named("b", "y"), "b")
    within = own.select("set", "fp").distinct().join(firsts, "fp").where("set <> of_fp").select(F.col("set").alias("a"), F.col("of_fp").alias("b"))
    pairs, second = cut(across.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).union(within).distinct(), "pairs")
    found = _similar(pairs, own, texts, size, least)
    for path in (first, second):
        drop(spark, path)
    return found


def _shared(spread: DataFrame, least: float) -> DataFrame:
    """Rows (bucket, ...) of buckets with several sets, one of which can be the shorter of a pair.

    A set is in a bucket once, so a single number a bucket says both: how many sets,
    and above them how many that can. ``before`` are the last of a set's buckets
    before the row's; ``rank`` is how many of its first shingles no other set shares,
    then less how many are shared.
    """
    told = F.sum(F.when(_can_begin(least), (1 << 32) + 1).otherwise(1).cast("bigint")).alias("told")
    open_, path = cut(spread.groupBy("bucket").agg(told).where(f"told > {1 << 32} and told % {1 << 32} > 1").select("bucket"), "buckets")
    if open_.count() <= BUCKETS:
        open_ = F.broadcast(open_)
    its = Window.partitionBy("set")
    before = F.collect_list("bucket").over(its.orderBy("at").rowsBetween(-BEFORE, -1))
    rank = F.struct((F.max("at").over(its) + 1 - F.count("*").over(its)).alias("alone"), (-F.count("*").over(its)).alias("shared"))
    members = cut(spread.join(open_, "bucket", "left_semi").select("bucket", "set", "n", "at", F.col("set").alias("root"), before.alias("before"), rank.alias("rank")), "members")
    drop(spread.sparkSession, path)
    return members


def _open(members: DataFrame, least: float) -> DataFrame:
    """Buckets in which different components may link."""
    return members.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(_can_begin(least)).alias("begins")).where("lo < hi and begins").select("bucket")


def _rooted(members: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Members with their component's root, of buckets with several."""
    named = members.drop("root").join(roots.withColumnRenamed("node", "set"), "set", "left").select("bucket", "set", "n", "at", F.coalesce("root", "set").alias("root"), "before", "rank")
    return named.join(_open(named, least), "bucket", "left_semi")


def links(own: DataFrame, texts: DataFrame, size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between different sets of a table with set, n, first, fp, key.

    ``texts`` (column text) are read again for the sets that share a bucket, so
    the hashes of all others are never stored or shuffled.

    Each link is a similar pair or follows from some: a round hands on every
    linked set with its root instead of all links before.
    """
    spark = own.sparkSession
    different = own.select("set", "n", "first").dropDuplicates(["set"])
    spread = different.select("set", "n", F.posexplode("first").alias("at", "bucket"))
    members, before = _shared(spread, least)
    n = members.select("set").distinct().count()
    roots, turn, grown = None, 0, True
    begun = by_index(own, texts, size, least)
    if not begun.isEmpty():
        roots = components(begun)
        members, after = cut(_rooted(members, roots, least), "members")
        drop(spark, before)
        before = after
    columns = ("set", "n", "at", "root")
    its = [F.col(c).alias(f"its_{c}") for c in columns]
    while True:
        last = not grown
        if last or turn and _left(members, least) <= LOOKED * n:
            other = members.select("bucket", F.col("before").alias("its_before"), *its)
            longer = "its_root <> root and (its_n > n or its_n = n and its_set > set)"
            met = members.where(_can_begin(least)).join(other, "bucket").where(longer).where(_may_link(least)).where("not arrays_overlap(before, its_before)")
            pairs, path = _named(met)
            last = last or pairs.count() <= PAIRS * n
            if not last:
                drop(spark, path)
        if not last:
            order: Column = F.struct((F.struct(F.lit(0)) if turn else F.col("rank")).alias("rank"), F.xxhash64("set", F.lit(turn)).alias("turn"), *[F.col(c) for c in columns])
            first = members.where(_can_begin(least)).groupBy("bucket").agg(F.min(order).alias("f")).select("bucket", F.col("f.rank").alias("its_rank"), "f.turn", *[F.col(f"f.{c}").alias(f"its_{c}") for c in columns])
            met = members.join(first, "bucket").where("root <> its_root").where(_may_link(least))
            pairs, path = _named(met.groupBy("set").agg(F.min(F.struct("its_rank", "turn", "its_set")).alias("f")).select("set", F.col("f.its_set").alias("its_set")))
        new = _similar(pairs, own, texts, size, least)
        drop(spark, path)
        found = new if roots is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(new)
        if last:
            drop(spark, before)
            return found
        grown, turn = not new.isEmpty(), turn + 1
        if grown:
            roots = components(found)
            members, after = cut(_rooted(members, roots, least), "members")
            drop(spark, before)
            before = after


def _left(members: DataFrame, least: float) -> float:
    """At most so many pairs between components share a bucket."""
    sizes = members.groupBy("bucket", "root").agg(F.count("*").cast("double").alias("k"), F.count_if(_can_begin(least)).cast("double").alias("i"))
    sizes = sizes.groupBy("bucket").agg((F.sum("k") * F.sum("i") - F.sum(F.col("k") * F.col("i"))).alias("left"))
    return sizes.agg(F.sum("left")).first()[0] or 0


def _named(rows: DataFrame) -> tuple[DataFrame, str]:
    """Different pairs (a, b) of sets of rows with set and its_set, written."""
    return cut(rows.select(F.greatest("set", "its_set").alias("a"), F.least("set", "its_set").alias("b")).distinct(), "pairs")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, root.

    ``key`` is the text's SHA-256 (null for a null text), ``root`` the smallest
    set of its component.
    """
    texts = docs.select(F.col(text).alias("text"))
    frequent = frequent_shingles(texts, size)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(F.col(text), 256).alias("key"), sets(frequent, size, least)(F.col(text)).alias("s")).select("doc_id", "key", "s.*")
    own = _told_apart(cut(own, "sets")[0])
    roots = components(links(own, texts, size, least))
    return own.select("doc_id", "key", "set").join(roots, F.col("set") == F.col("node"), "left").select("doc_id", "key", F.coalesce("root", "set").alias("root"))
