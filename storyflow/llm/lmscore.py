"""Language-model scores of whole texts: a unigram base and causal attention.

Counting: words of the training rows are counted in tasks and summed by a
shuffle into a table of (word, n), which grows with the input and stays in the
shared folder. Subword counts follow from that table. Only the words above a
count that at most ``FREQUENT`` words reach are sent to every task; a text's
other words are joined with the table by a shuffle.

Equal texts meet in a shuffle by their SHA-256. What is left of a text is two
bytes a subword, its base and its rarer words; the other passes read that table.

Training: how often a symbol follows another is counted over all training texts.
Then the attention model learns from all of them too: texts are dealt to shards
by hash, a shard's texts come in order of hash, and each shard trains a copy of
the model on all its training texts, each as many times as it occurs. The mean of
the copies is summed by a shuffle in integers, so the model doesn't depend on
how rows lie in partitions. It has a fixed size (``attention.SYMBOLS``), and so
have the pairs of symbols that are counted.

Defined cases: a null text counts as empty and is scored as its end alone.
Repeated rows count as often as they occur and get equal scores. Without
training rows N and V are 0 and the model is untrained. A null id is not held
out. Invalid UTF-8 is replaced before subwords are taken. A text of any length
is read in pieces of about a megabyte.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from itertools import groupby, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyflow.llm import attention
from storyflow.llm.arrowtext import array_column, ascii_words, pieces, short_parts, text_column
from storyflow.shared import cut, drop, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
FREQUENT = 1 << 18
#: Subwords of a shard, and the least number of shards.
SHARD, SHARDS = 2_000_000, 16
#: Blocks that are scored together.
SCORE_BLOCKS = 4096
#: Pairs of symbols that a counting task holds before it sums them.
PAIRS = 1 << 20
#: Keys of pairs that are shuffled as one row.
SPAN = 4096
#: Distinct words that a counting task holds before it hands them on.
HELD_WORDS = 400_000


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or b"").lower().split()


def held_out(doc_id: str = "doc_id", parts: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == 1, F.lit(False))


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _ranks(path: str | None) -> dict[bytes, int]:
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


_own: dict[str, tiktoken.Encoding] = {}


class Subwords:
    """Subword ids of word lists; the vocabulary is read on the driver.

    Words are split from each other by a space, which the pattern always
    splits before, so a word's ids don't depend on its neighbours.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        ranks = _ranks(path)
        self.all_ids = max(ranks.values()) + 1
        self.opens = np.zeros(self.all_ids, bool)
        self.opens[[i for token, i in ranks.items() if token[:1] == b" "]] = True
        self.held = spark.sparkContext.broadcast(ranks)
        self.name = path or VOCABULARY

    def encoding(self) -> tiktoken.Encoding:
        if self.name not in _own:
            _own[self.name] = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.held.value, special_tokens={})
        return _own[self.name]

    def each(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids one after another, and how many each word has.

        Only a word's first id begins with the space before it.
        """
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        flat = np.asarray(self.encoding().encode_to_numpy(" " + b" ".join(words).decode("utf-8", "replace"))).astype(np.int64)
        return flat, np.diff(np.append(np.flatnonzero(self.opens[flat]), len(flat)))


def _summed(held: list[tuple[pa.Array, pa.Array]]) -> pa.Table:
    words, n = (pa.chunked_array([h[i] for h in held], kind) for i, kind in ((0, pa.binary()), (1, pa.int64())))
    return pa.table({"word": words, "n": n}).group_by("word").aggregate([("n", "sum")]).combine_chunks()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[pa.Array, pa.Array]] = []

    def given() -> Iterator[pa.RecordBatch]:
        for found in _summed(held).rename_columns(["word", "n"]).select(["word", "n"]).to_batches():
            yield found

    k = 0
    for batch in batches:
        for part, _ in short_parts(batch.column(0)):
            seen = ascii_words(part)[0].value_counts()
            held.append((seen.field("values").cast(pa.binary()), seen.field("counts")))
            k += len(seen)
            if k > 2 * HELD_WORDS:
                found = _summed(held)
                held, k = [(c.chunk(0), n.chunk(0)) for c, n in [(found["word"], found["n_sum"])]], len(found)
                if k > HELD_WORDS:
                    yield from given()
                    held, k = [], 0
    yield from given()


def word_counts(texts: DataFrame) -> DataFrame:
    """Columns word (binary), n, of a table with one text column."""
    return texts.mapInArrow(_count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = FREQUENT) -> dict[bytes, int]:
    """Words from some count on, as many counts as fit into ``most`` words."""
    step = F.when(F.col("n") < 1024, F.col("n").cast("double")).otherwise(1024 + F.floor(F.log(F.col("n") / 1024) * 16))
    least, total = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect(), key=lambda r: -r.step):
        total += r.words
        if total > most:
            break
        least = r.least
    return {} if least is None else {bytes(r.word): r.n for r in counts.where(F.col("n") >= least).collect()}


def subword_counts(counts: DataFrame, subwords: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur, and how often, from the table of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(subwords.all_ids, np.int64)
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            found, sizes = subwords.each(words)
            total += np.bincount(found, np.repeat(n, sizes), subwords.all_ids).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["id", "n"])

    seen = counts.mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    return seen["id"].to_numpy(np.int64), seen["n"].to_numpy(np.int64)


def follows(texts: DataFrame, v: attention.Vocabulary) -> attention.Follows:
    """What follows what in a table with symbols and times, counted; a negative key is a cell's."""
    # keys are sorted, which is cheaper in four bytes
    kind = np.int32 if max(len(v.mass), v.classes**2) * len(v.mass) < 1 << 31 else np.int64
    size, end, classes, class_of = len(v.mass), np.array([v.end], kind), v.classes, v.class_of.astype(kind)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (np.zeros(0, kind), np.zeros(0, np.int64))
        once, often, k = [], [total], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate(once) if once else total[0][:0]
            keys.sort()
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else keys.astype(np.int64)
            parts = [(keys[first], np.diff(np.append(first, len(keys)))), *often, total]
            keys, n = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else keys.astype(np.int64)
            return keys[first], np.add.reduceat(n, first) if len(first) else n

        for batch in batches:
            for raw, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.concatenate([end, end, np.frombuffer(raw, np.uint16).astype(kind), end])
                group = class_of[own]
                for keys in (own[1:-1] * size + own[2:], -1 - ((own[1:-1] * classes + group[:-2]) * classes + group[2:])):
                    if times == 1:
                        once.append(keys)
                    else:
                        often.append((keys, np.full(len(keys), times)))
                k += len(own)
                if k >= PAIRS:
                    total = summed()
                    once, often, k = [], [], 0
        keys, n = summed()
        if len(keys):
            # a row holds all counts of a span of keys, as rows cost more than what is in them
            spans = keys // SPAN
            first = np.flatnonzero(np.append(True, spans[1:] != spans[:-1]))
            columns = [pa.array(spans[first], pa.int32())]
            for values in ((keys - spans * SPAN).astype(np.uint16), n.astype(np.int64)):
                ends = pa.array(np.append(first, len(keys)) * values.itemsize, pa.int32())
                columns.append(pa.Array.from_buffers(pa.binary(), len(first), [None, ends.buffers()[1], pa.py_buffer(values)]))
            yield pa.RecordBatch.from_arrays(columns, names=["span", "low", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("span", "low", "n"))))
        for span, own in groupby(rows, lambda r: r[0]):
            total = np.zeros(SPAN, np.int64)
            for _, low, n in own:
                total[np.frombuffer(low, np.uint16)] += np.frombuffer(n, np.int64)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at + span * SPAN), pa.array(total[at])], names=["pair", "n"])

    spans = texts.select("symbols", "times").mapInArrow(count, "span int, low binary, n binary")
    seen = spans.repartition("span").sortWithinPartitions("span").mapInArrow(add, "pair bigint, n bigint").toArrow().sort_by("pair")
    keys, n = (seen.column(c).to_numpy() for c in ("pair", "n"))
    at = np.searchsorted(keys, 0)
    return attention.Follows(v, keys[at:], n[at:], -1 - keys[:at][::-1], n[:at][::-1])


def train(texts: DataFrame, counted: Broadcast, subwords: int) -> np.ndarray:
    """Parameters of the model: the mean of the copies that each shard trains on all its texts.

    ``texts`` has key, symbols and times; about ``subwords`` symbols. ``counted`` is :func:`follows`, broadcast.
    """
    shards = max(SHARDS, -(-subwords // SHARD))
    dealt = texts.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "symbols", "times")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, total = attention.Model(counted.value), None
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "symbols", "times"))))
        for _, own in groupby(rows, lambda r: r[0]):
            flat, seen = attention.trained(start, ((np.frombuffer(raw, np.uint16), times) for _, raw, times in own))
            seen = round(seen / SHARD * 1024)
            part = np.append(np.rint(flat.astype(np.float64) * attention.UNIT / 1024).astype(np.int64) * seen, seen)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["at", "x"])

    ordered = dealt.repartition("shard").sortWithinPartitions("shard", "key")
    sums = ordered.mapInArrow(learn, "at int, x bigint").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    flat = np.zeros(len(sums))
    flat[sums["at"]] = sums["x"]
    return flat[:-1] / flat[-1] * (1024 / attention.UNIT) if len(flat) and flat[-1] else attention.Model(counted.value).flat()


class Frequent:
    """Frequent words with what scoring needs of each: log10 of its share, symbols, rare ids' log."""

    def __init__(self, counts: dict[bytes, int], bottom: float, subwords: Subwords, vocabulary: attention.Vocabulary):
        self.words = list(counts)
        self.log = np.log10(np.fromiter(counts.values(), float, len(counts)) + 0.5) - bottom
        self.sizes, self.flat, self.share = spelled(*subwords.each(self.words), vocabulary)
        self.places: dict[bytes, int] | None = None

    def of(self, words: pa.Array) -> tuple[np.ndarray, list[bytes]]:
        """Indexes of words, and the words met besides, in the order of theirs."""
        if self.places is None:
            self.places = dict(zip(self.words, range(len(self.words))))
        coded = words.dictionary_encode()
        kinds = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
        place = np.fromiter(map(self.places.get, kinds, repeat(-1)), np.int64, len(kinds))
        more = np.flatnonzero(place < 0)
        place[more] = len(self.words) + np.arange(len(more))
        return place[coded.indices.to_numpy()], kinds[more].tolist()


def spelled(flat: np.ndarray, sizes: np.ndarray, vocabulary: attention.Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words by their ids: number of symbols, all symbols, log-share of rare ids."""
    share = np.bincount(np.repeat(np.arange(len(sizes)), sizes), vocabulary.share[flat], len(sizes))
    return sizes, vocabulary.symbol[flat], share


def _spelled(spark: SparkSession, v: attention.Vocabulary, subwords: Subwords, known: dict[bytes, int], n: int, kinds: int) -> "callable":
    """Column function: struct<words, known, base, share, symbols, rest>; rest are the words not in ``known``."""
    shared = spark.sparkContext.broadcast((v, Frequent(known, np.log10(n + 0.5 * (kinds + 1)), subwords, v)))
    names = ["words", "known", "base", "share", "symbols", "rest"]

    def spell(texts: pa.Array) -> pa.Array:
        v, often = shared.value
        totals, symbols, long, frequent_words = np.zeros((4, len(texts))), [], np.zeros(len(texts), np.int64), len(often.words)
        rest, words, times = np.zeros(len(texts), np.int64), [pa.array([], pa.binary())], [np.zeros(0, np.int32)]
        for part, texts_of in short_parts(texts):
            found, owner = ascii_words(part)
            owner = texts_of[owner]
            place, met = often.of(found)
            rare = place >= frequent_words
            # base: frequent words here, the rest is joined with the table of words
            totals[0] += np.bincount(owner, minlength=len(texts))
            totals[1] += np.bincount(owner[~rare], minlength=len(texts))
            totals[2] += np.bincount(owner, np.append(often.log, np.zeros(len(met)))[place], len(texts))
            kinds, n = np.unique(owner[rare] * len(met) + place[rare] - frequent_words, return_counts=True)
            if len(kinds):
                rest += np.bincount(kinds // len(met), minlength=len(texts))
                words.append(pa.array(met, pa.binary()).take(pa.array(kinds % len(met))))
                times.append(n.astype(np.int32))
            # every word's symbols one after another
            more = spelled(*subwords.each(met), v)
            sizes, flat, share = (np.concatenate([a, b]) for a, b in zip((often.sizes, often.flat, often.share), more))
            first, own = np.cumsum(sizes) - sizes, sizes[place]
            stop = np.cumsum(own)
            symbols.append(flat[np.arange(own.sum()) + np.repeat(first[place] - stop + own, own)])
            long += np.bincount(owner, own, len(texts)).astype(np.int64)
            totals[3] += np.bincount(owner, share[place], len(texts))
        ends, bits = (pa.array(np.append(0, np.cumsum(x)), pa.int32()) for x in (rest, long * 2))
        rest = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.concat_arrays(words), pa.array(np.concatenate(times))], names=["word", "times"]))
        flat = np.concatenate([np.zeros(0, np.uint16), *symbols])
        bits = pa.Array.from_buffers(pa.binary(), len(texts), [None, bits.buffers()[1], pa.py_buffer(flat)])
        return pa.StructArray.from_arrays([pa.array(totals[0].astype(np.int64)), pa.array(totals[1].astype(np.int64)), pa.array(totals[2]), pa.array(totals[3]), bits, rest], names=names)

    return array_column(spell, "struct<words:bigint,known:bigint,base:double,share:double,symbols:binary,rest:array<struct<word:binary,times:int>>>")


def _scored(spark: SparkSession, counted: Broadcast, parameters: np.ndarray) -> "callable":
    """Column function: log10 probability of symbols."""
    held = spark.sparkContext.broadcast(parameters)

    def score(texts: list[bytes]) -> pa.Array:
        model, total = attention.Model(counted.value), np.zeros(len(texts))
        model.load(held.value)
        tables = model.tables()
        for inputs, targets, owner in attention.laid_out((np.frombuffer(t, np.uint16) for t in texts), model.v.end, SCORE_BLOCKS):
            total += np.bincount(owner, model.score(inputs, targets, tables), len(texts))
        return pa.array(total / np.log(10))

    return text_column(score, "double")


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, most_frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``, with the columns of ``op5``."""
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("held_out", held_out())
    learned = own.where(~F.col("held_out")).select("text")
    ends = learned.count()
    counts, _ = cut(word_counts(learned), "words")
    words, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n, kinds = total + ends, words + (ends > 0)
    subwords = Subwords(spark, path)
    seen = subword_counts(counts, subwords)
    v = attention.Vocabulary(*seen, ends, subwords.all_ids)
    known = frequent(counts, most_frequent)
    keyed = own.select(text_key(F.col("text")).alias("key"), "text", (~F.col("held_out")).cast("bigint").alias("times"))
    different = keyed.groupBy("key").agg(F.any_value("text").alias("text"), F.sum("times").alias("times"))
    main, spelled_path = cut(different.select("key", "times", _spelled(spark, v, subwords, known, n, kinds)(F.col("text")).alias("r")).select(F.monotonically_increasing_id().alias("row"), "key", "times", "r.*"), "spelled")
    training = main.where("times > 0").select("key", "symbols", "times")
    counted = spark.sparkContext.broadcast(follows(training, v))
    parameters = train(training, counted, int(seen[1].sum()))
    scored, _ = cut(main.select("row", "key", "words", "known", "base", (F.col("share") / math.log(10) + _scored(spark, counted, parameters)(F.col("symbols"))).alias("score")), "scores")
    bottom = F.log10(F.lit(n + 0.5 * (kinds + 1)))
    rare = main.select("row", F.inline("rest")).join(counts, "word", "left")
    found = F.col("n").isNotNull().cast("bigint") * F.col("times")
    value = F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 0.5) - bottom)
    sums = rare.groupBy(F.col("row").alias("of")).agg(F.sum(found).alias("more_known"), F.sum(value).alias("more_base"))
    end = F.log10(F.lit(ends + 0.5)) - bottom
    joined, _ = cut(scored.join(sums, F.col("row") == F.col("of"), "left").select("key", "words", "known", "base", "score", "more_known", "more_base"), "sums")
    drop(spark, spelled_path)
    return own.select("doc_id", "held_out", text_key(F.col("text")).alias("key")).join(joined, "key").select(
        "doc_id",
        "held_out",
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + end).alias("base_score"),
        "score",
    )


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
