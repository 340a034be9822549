"""Mail files as a stream of urls."""

from __future__ import annotations

import email
import email.policy

import pyarrow as pa
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyflow.functions import urls
from storyflow.functions.udf import lazy


def _parts(data: bytes) -> list[dict]:
    out = []
    for part in email.message_from_bytes(data, policy=email.policy.default).walk():
        kind = part.get_content_type()
        if kind in ("text/plain", "text/html") and not part.is_multipart():
            out.append({"kind": kind, "body": part.get_content(), "base": str(part.get("Content-Base", "")).strip('"')})
    return out


def _read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("body", pa.string()), ("base", pa.string())]))
    for batch in batches:
        yield pa.array([None if x is None else _parts(x) for x in batch.to_pylist()], kind)


parts = lazy(_read, "array<struct<kind:string,body:string,base:string>>")


def urls_of(mails: DataFrame) -> DataFrame:
    """Distinct urls (path, url) of mail files read as ``binaryFile``."""
    each = mails.select("path", F.explode(parts(F.col("content"))).alias("p"))
    found = F.when(F.col("p.kind") == "text/html", urls.from_html(F.col("p.body"))).otherwise(urls.from_text(F.col("p.body")))
    based = F.when(F.col("p.base") != "", F.array("p.base")).otherwise(F.array().cast("array<string>"))
    rows = each.select("path", F.explode(F.concat(based, found)).alias("url"))
    return rows.where(F.col("url").startswith("http")).select("path", urls.cleaned_link(F.col("url")).alias("url")).distinct()


def mailbox(spark: SparkSession, folder: str) -> DataFrame:
    """New ``.eml`` files of a folder; the checkpoint remembers which were seen."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.eml").load(folder)
