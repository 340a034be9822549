"""Language identification by naive Bayes over hashed character n-grams.

Letters are lower-cased, runs of anything else count as one space, and every
2- and 3-gram of the whole text is hashed to one of ``BUCKETS`` columns. Counts
per language are summed in Spark over all labelled rows; only the matrix of
log-probabilities (``BUCKETS`` rows, at most ``MAX_LANGUAGES`` columns of 4
bytes) reaches the driver and is broadcast.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
so is every text if no row has a label. Ties go to the language first in
code-point order. Repeated rows count as often as they occur in learning and
get equal predictions. A null id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyflow.llm.arrowtext import slices, text_column
from storyflow.shared import cut, table

BUCKETS = 1 << 16
ORDERS = (2, 3)
#: More languages than this are refused, as the matrix would outgrow its bound.
MAX_LANGUAGES = 512
#: Added to each count.
SMOOTHING = 0.1
#: Odd multipliers of the gram hash.
MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
SPACE = 32


@lru_cache(1)
def letters() -> np.ndarray:
    """By code point: the lower-case letter, or a space for anything else."""
    out = np.full(0x110000, SPACE, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all grams, the text that each is from, and which texts have letters."""
    words = [(t or b"").decode("utf-8", "replace") for t in texts]
    sizes = np.array([len(t) + 1 for t in words])
    points = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    code, owner = letters()[points], np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    blank = code == SPACE
    lettered = np.bincount(owner[~blank], minlength=len(words)) > 0
    kept = ~blank
    kept[1:] |= ~blank[:-1]
    code, owner = code[kept], owner[kept]
    found, of = [], []
    for n in ORDERS:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ code[k : len(code) - n + 1 + k]) * MIX[k]
            h ^= h >> np.uint32(15)
        own = owner[: len(h)]
        inside = own == owner[n - 1 :]
        found.append(h[inside] & np.uint32(BUCKETS - 1))
        of.append(own[inside])
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32), lettered
    found, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return found[order], of[order], lettered


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        at = 0
        for part in slices(batch.column(0)):
            own = np.array(langs[at : at + len(part)], dtype=object)
            at += len(part)
            found, of, _ = grams(part.cast(pa.binary()).to_pylist())
            for lang in set(own):
                mine = own == lang
                n = held.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                n[:BUCKETS] += np.bincount(found[mine[of]], minlength=BUCKETS)
                n[BUCKETS] += mine.sum()
    for lang, n in held.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], names=["lang", "bucket", "n"])


class Model:
    """Languages in code-point order and their matrix of log-probabilities."""

    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray):
        self.langs = langs
        total = counts.sum(0, keepdims=True)
        self.log = np.log((counts + SMOOTHING) / (total + SMOOTHING * BUCKETS)).astype(np.float32)
        self.prior = np.log(np.maximum(docs, 1) / max(1, docs.sum()))

    def score(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        found, of, lettered = grams(texts)
        total = np.tile(self.prior, (len(texts), 1))
        if len(found):
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            total[of[starts]] += np.add.reduceat(self.log[found], starts, axis=0, dtype=np.float64)
        best = total.argmax(1)
        share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, lettered)], np.where(lettered, share, 0.0)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """Counts over all rows with a text and a label; None if there are none."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sums = rows.mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums, _ = cut(sums, "ngrams")
    langs = sorted(r.lang for r in sums.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    seen = sums.toPandas()
    if not langs:
        return None
    counts = np.zeros((BUCKETS + 1, len(langs)))
    counts[seen["bucket"], seen["lang"].map({x: i for i, x in enumerate(langs)})] = seen["n"]
    return Model(langs, counts[:BUCKETS], counts[BUCKETS])


def predict(spark: SparkSession, model: Model | None) -> "callable":
    """Column function: text to struct<lang_pred, score>."""
    held = spark.sparkContext.broadcast(model)

    def predicted(texts: list[bytes | None]) -> pa.Array:
        if held.value is None or not texts:
            names, score = ["und"] * len(texts), np.zeros(len(texts))
        else:
            names, score = held.value.score(texts)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

    return text_column(predicted, "struct<lang_pred:string,score:double>")


def held_out(doc_id: str = "doc_id", parts: int = 3) -> Column:
    """True for ids whose CRC-32, as text, leaves remainder 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == 1, F.lit(False))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    out = docs.select("doc_id", held_out().alias("held_out"), predict(spark, model)(F.col("text")).alias("r"))
    return out.select("doc_id", "held_out", "r.*")
