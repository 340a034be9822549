"""URL filter: rules first, then a ratio of two character Markov models.

A url that a rule fits gets the longest rule's verdict. Those urls also train
two models, of allowed and of blocked urls: byte contexts of orders 0 to
``ORDER``, each smoothed by the next shorter one. Counts are summed in Spark in
hashed buckets, so the driver and the broadcast hold at most ``4 * BUCKETS``
counts. One fifth of the labelled urls, by hash, is kept from training; the
threshold on the difference of log-likelihoods per byte is where those are
divided best. Other urls are allowed at or above it.

Defined cases: a null url, or one without ``://``, has an empty host and path
and fits no rule; null is scored as an empty url. Without labelled urls every
score and the threshold are 0, so everything is allowed. Equal urls get equal
verdicts, and repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyflow.llm.arrowtext import text_column
from storyflow.shared import table

#: Fixed values: (verdict, host, path) of the rules.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
ORDER = 4
BUCKETS = 1 << 18
#: Weight of the shorter context, in observations.
SMOOTHING = 2.0
#: Width and number of the score bins among which the threshold is chosen.
BIN, BINS = 0.01, 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host and path joined) and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for does, own_host, own_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        rule, verdict = F.when(fits, own_host + own_path).otherwise(rule), F.when(fits, does).otherwise(verdict)
    return rule, verdict


def _keys(urls: list[bytes | None]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(context bucket, symbol bucket) of each order, and the url of each symbol.

    A url's symbols are its bytes and an end; before it stand ``ORDER`` starts.
    """
    texts = [u or b"" for u in urls]
    symbols = np.frombuffer(b"".join(b"\0" * ORDER + t + b"\n" for t in texts), np.uint8).astype(np.uint64)
    sizes = np.array([ORDER + len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    real = np.ones(len(symbols), bool)
    for k in range(ORDER):
        real[first + k] = False
    at = np.flatnonzero(real)
    context, out = np.full(len(at), 14695981039346656037, np.uint64), []

    def bucket(h: np.ndarray) -> np.ndarray:
        h = h ^ (h >> np.uint64(29))
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & np.uint64(BUCKETS - 1)

    for k in range(ORDER + 1):
        if k:
            context = (context ^ (symbols[at - k] + np.uint64(1))) * np.uint64(1099511628211)
        own = context + np.uint64(k)
        out.append((bucket(own), bucket((own ^ (symbols[at] << np.uint64(48))) * np.uint64(0xC2B2AE3D27D4EB4F))))
    return out, owner[at]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((2, 2, BUCKETS), np.int64)
    for batch in batches:
        allowed = np.array(batch.column(1).to_pylist(), bool)
        if not len(allowed):
            continue
        orders, owner = _keys(batch.column(0).cast(pa.binary()).to_pylist())
        for side in (0, 1):
            mine = allowed[owner] == side
            for keys in orders:
                for which in (0, 1):
                    sums[side, which] += np.bincount(keys[which][mine].astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums.ravel()[at])], names=["bucket", "n"])


class Model:
    """Counts by [blocked, allowed][context, symbol][bucket]."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.float32)

    def score(self, urls: list[bytes | None]) -> np.ndarray:
        """Difference of log-likelihoods per symbol, allowed less blocked."""
        if not urls:
            return np.zeros(0)
        orders, owner = _keys(urls)
        total = np.zeros((2, len(urls)))
        for side in (0, 1):
            p = np.full(len(owner), 1 / 256)
            for context, symbol in orders:
                seen = self.counts[side, 0, context]
                p = (np.minimum(self.counts[side, 1, symbol], seen) + SMOOTHING * p) / (seen + SMOOTHING)
            total[side] = np.bincount(owner, np.log(p), len(urls))
        return (total[1] - total[0]) / np.bincount(owner, minlength=len(urls))


def _scores(spark: SparkSession, model: Model) -> "callable":
    held = spark.sparkContext.broadcast(model)
    return text_column(lambda urls: pa.array(held.value.score(urls), pa.float64()), "double")


def train(labelled: DataFrame, url: str = "url", allowed: str = "allowed") -> tuple[Model, float]:
    """The model and its threshold, from rows with a boolean label."""
    rows = labelled.select(F.col(url).alias("url"), F.col(allowed).alias("allowed")).where("url is not null and allowed is not null")
    kept = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    sums = rows.where(~kept).mapInArrow(_count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(4 * BUCKETS)
    counts[sums["bucket"]] = sums["n"]
    model = Model(counts.reshape(2, 2, BUCKETS))
    place = F.least(F.greatest(F.floor(F.col("score") / BIN), F.lit(-BINS)), F.lit(BINS)).cast("int").alias("bin")
    seen = rows.where(kept).select("allowed", _scores(rows.sparkSession, model)(F.col("url")).alias("score")).groupBy("allowed", place).count().toPandas()
    shares = np.zeros((2, 2 * BINS + 1))
    np.add.at(shares, (seen["allowed"].astype(int), seen["bin"] + BINS), seen["count"])
    if not shares.sum(1).all():
        return model, 0.0
    shares /= shares.sum(1, keepdims=True)
    right = np.r_[0, np.cumsum(shares[0])] + 1 - np.r_[0, np.cumsum(shares[1])]
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return model, float((best[len(best) // 2] - BINS) * BIN)


def judge(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, score and verdict; own columns of those names are replaced."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    known = pages.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "verdict": verdict})
    model, threshold = train(known.select(F.col(url).alias("url"), (F.col("verdict") == "allow").alias("allowed")))
    scored = known.withColumn("score", _scores(pages.sparkSession, model)(F.col(url)))
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block")))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")
