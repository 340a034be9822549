"""A training corpus from ``documents``: five stages, each a table of its own.

Every stage works on all rows that the one before it kept, and all but the last
return the columns of documents. Further columns, whatever their names, are kept
by all but the last. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyflow.llm import bpe, decontaminate, jaccard, langid, secretscan, simhash
from storyflow.llm.names import unused
from storyflow.shared import cut, drop, fresh_path, table

#: Texts whose best language has a smaller share of the probability go.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts with letters and a clear language.

    Null and letterless texts go. Repeated rows stay or go together. Without a
    labelled row no text has a language, so all go.
    """
    model = langid.train(docs.where(~langid.held_out()))
    own = unused(docs, "judged")
    judged = docs.withColumn(own, langid.predict(spark, model)(F.col("text")))
    return judged.where((F.col(own)["lang_pred"] != "und") & (F.col(own)["score"] >= LEAST_SCORE)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of similar ones (0.8 of five-word shingles), the one with the smallest id.

    Null ids come last, ties go to the smaller digest of the text; of rows with
    equal id and text one stays. Texts without words are equal.
    """
    return simhash.first_of_each(docs, groups=jaccard.near_duplicates)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item; null and empty texts and repeated clean rows stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets; ``n_chars`` follows the text. A null text stays null with its ``n_chars``."""
    masked = secretscan.redact(docs, fresh_path(spark, "ledger"))
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("bigint"))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, with digests of the ids and of what they decode to; a null text counts as empty."""
    return docs.select("doc_id", "lang", "source", bpe.digests(spark, ids=True)(F.col("text")).alias("_r")).select("doc_id", "lang", "source", "_r.*")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", decontaminate_benchmark),
    ("secrets", mask_secrets),
    ("encode", encode),
]

#: SQL has no XXH64 of shingles, no naive Bayes and no merges by rank.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = cut(stage(spark, docs, sf_dir), name)
        if before:
            drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
