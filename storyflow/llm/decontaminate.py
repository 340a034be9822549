"""Benchmark decontamination with DataFrame functions only.

Both sides lower-case A-Z and take words of digits, a-z and code points above
0x7F. The windows of all items (``size`` words, or a shorter item's all) form a
set of 64-bit hashes, which is broadcast where its size has been counted to be at
most ``MAX_WINDOWS``: each text's window hashes are looked up where the text is.
A larger set meets those hashes, eight bytes each, in a shuffled join. A hit is
verified by comparing the words themselves.

Defined cases: a null or empty text has no words and no hits; an item without
words has no window. Repeated rows stay rows, each with its own result. Equal
item_ids count once. Item ids are sorted as strings; null ids are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyflow.llm.names import unused
from storyflow.shared import cut, table

SIZE = 10
#: Window hashes that may be broadcast: 16 bytes each, 64 MB.
MAX_WINDOWS = 4_000_000
#: Bytes of windows with their item ids that may be broadcast for verifying.
MAX_BYTES = 64 << 20
#: Digests of texts that may be broadcast when rows are dropped, 32 bytes each.
MAX_TEXTS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(lowered(text), F.lit("")), _BREAK), lambda w: w != "")


def windows(items: DataFrame, item_id: str, text: str, size: int = SIZE) -> DataFrame:
    """Columns gram (the words, space-joined), n (how many), item (id as string)."""
    own = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w"))
    n = F.least(F.size("w"), F.lit(size))
    gram = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    return own.where("size(w) > 0").select("item", n.alias("n"), F.explode(gram).alias("gram")).distinct()


def window_hash(hashes: Column, n: Column) -> Column:
    """Hash of a window by the hashes of its words."""
    return F.xxhash64(n, hashes)


def _window_hashes(sizes: list[int]) -> Column:
    """array<struct<at, n, h>> of all windows of the word hashes in column ``hs``."""
    parts = ["cast(array() as array<struct<at:int,n:int,h:bigint>>)"]
    for n in sizes:
        starts = f"if(size(hs) >= {n}, sequence(0, size(hs) - {n}), cast(array() as array<int>))"
        parts.append(f"transform({starts}, i -> named_struct('at', i, 'n', {n}, 'h', xxhash64({n}, slice(hs, i + 1, {n}))))")
    return F.expr(parts[1] if len(parts) == 2 else f"concat({', '.join(parts)})")


def covered(spans: Column) -> Column:
    """Number of positions inside any of an array of struct<at, n>."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("total"))

    def add(acc: Column, s: Column) -> Column:
        end = s["at"] + s["n"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["total"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["at"]))).alias("total"))

    return F.aggregate(F.array_sort(spans), zero, add, lambda acc: acc["total"])


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, n_words, spans, n_hit, items.

    ``key`` is the text's SHA-256, null for a null text; equal texts have equal
    results. ``spans`` are the verified windows as struct<at, n> in words.
    """
    owners, _ = cut(windows(items, item_id, item_text, size).groupBy("n", "gram").agg(F.collect_set("item").alias("item")), "windows")
    sizes = [r.n for r in owners.groupBy("n").count().collect()]  # at most ``size`` of them
    known = owners.select(window_hash(F.transform(F.split("gram", " "), lambda x: F.xxhash64(x)), F.col("n")).alias("h")).distinct()
    many, weight = owners.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("gram") + 8 + F.aggregate("item", F.lit(0), lambda n, i: n + F.octet_length(i) + 8)), F.lit(0))).first()
    by_hand = F.broadcast if weight <= MAX_BYTES else (lambda df: df)
    ids = [F.col(doc_id).alias("doc_id"), F.sha2(F.col(text), 256).alias("key")]
    split = docs.select(*ids, words(F.col(text)).alias("w"))
    gram = F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ").alias("gram")
    hashed = split.select("doc_id", "key", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("hs"))
    if many <= max_windows:
        hits = hashed.select("doc_id", "key", "w", F.inline(_window_hashes(sorted(sizes)))).join(F.broadcast(known), "h", "left_semi").select("doc_id", "key", "at", "n", gram)
    else:
        spread = hashed.select("doc_id", "key", F.inline(_window_hashes(sorted(sizes)))).join(known, "h", "left_semi")
        at = spread.groupBy(F.col("doc_id").alias("id"), F.col("key").alias("of")).agg(F.collect_set(F.struct("at", "n")).alias("at"))
        hits = split.join(at, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("key").eqNullSafe(F.col("of"))).select("doc_id", "key", "w", F.inline("at")).select("doc_id", "key", "at", "n", gram)
    spans, found = F.collect_set(F.struct("at", "n")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("item"))).alias("items")
    hits = hits.join(by_hand(owners), ["n", "gram"]).groupBy(F.col("doc_id").alias("id"), F.col("key").alias("of")).agg(spans, found)
    base = docs.select(*ids, F.size(words(F.col(text))).cast("bigint").alias("n_words"))
    rows = base.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("key").eqNullSafe(F.col("of")), "left")
    spans = F.coalesce("spans", F.expr("cast(array() as array<struct<at:int,n:int>>)"))
    return rows.select("doc_id", "key", "n_words", spans.alias("spans"), covered(spans).alias("n_hit"), F.array_sort(F.coalesce("items", F.expr("cast(array() as array<string>)"))).alias("items"))


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a window of an item.

    Digests of such texts are broadcast, where they are counted to be at most
    ``MAX_TEXTS``, so that the texts themselves stay where they are.
    """
    key = unused(docs, "key")
    hit, _ = cut(contamination(docs, items, doc_id, text, item_id, item_text).where("n_hit > 0").select(F.unhex("key").alias(key)).distinct(), "contaminated")
    hit = F.broadcast(hit) if hit.count() <= MAX_TEXTS else hit
    return docs.join(hit, F.unhex(F.sha2(F.col(text), 256)) == F.col(key), "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _sql_words(name: str, key: str) -> str:
    return rf"""(select {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from {name})"""


SQL = f"""
with d as {_sql_words("documents", "doc_id")}, b as {_sql_words("benchmark", "item_id")},
s as (select *, least(len(w), {SIZE}) as n from b where len(w) > 0),
item_windows as (select distinct item_id::varchar as item, n, array_to_string(w[i : i + n - 1], ' ') as gram from s, unnest(range(1, len(w) - n + 2)) as t(i)),
text_windows as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as gram from d, (select distinct n from item_windows), unnest(range(1, len(w) - n + 2)) as t(i)),
hits as (select distinct doc_id, n, i, item from text_windows join item_windows using (n, gram)),
places as (select doc_id, count(distinct p) as n_hit from hits, unnest(range(i, i + n)) as t(p) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join places on d.doc_id = places.doc_id left join items on d.doc_id = items.doc_id
"""
