"""Rows that every operator must stand: nulls, blanks, repeats, long texts, clashing names."""

from pyspark.sql import DataFrame, SparkSession

LONG = "the quick brown fox jumps over the lazy dog again and again " * 4000
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, component_id string, n string, word string, rank string, key string, item string, spans string, row string"
ROWS = [
    (1, "the cat sat on the mat and looked at the other cat all day long", "en"),
    (1, "the cat sat on the mat and looked at the other cat all day long", "en"),
    (2, "The cat sat on the MAT and looked at the other cat all day long", "en"),
    (3, "el gato estaba en la casa y miraba la calle durante todo el largo día", "es"),
    (4, "", "en"),
    (5, None, "es"),
    (None, "le chat était assis sur le tapis et regardait la rue toute la journée", None),
    (None, None, None),
    (7, " \t\r\n\x0b\x0c ", "en"),
    (8, "12345 !!! 67890", "en"),
    (9, LONG, "en"),
    (10, " é ß 😀 \U0001f600 \\ < [ \x1c \x85", None),
    (11, "x" * 5000, "en"),
]


def rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 0.5, "c", "n", "w", "r", "k", "i", "sp", "ro") for i, t, lang in ROWS], SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def store(df: DataFrame, tmp_path, name: str = "documents") -> str:
    """A folder that the queries accept, with ``df`` as the table ``name``."""
    df.write.parquet(f"file://{tmp_path}/{name}.parquet")
    return f"file://{tmp_path}"
