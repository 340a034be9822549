"""Secret scanning over a ledger of blobs, with DataFrame functions only.

A text is addressed by its SHA-256. The ledger, a Parquet table, has a row for
each (blob, rule version, digest of the rules) that was scanned, with its
findings. A scan takes every distinct blob that the ledger lacks under the
current version and rules, appends it, and joins findings back to all rows that
hold the blob. Rows of older ledgers have no digest and are scanned again.

Positions come from the text itself: ``split`` by a pattern gives the gaps
between its leftmost non-overlapping matches, ``regexp_extract_all`` the
matches; their running lengths are the offsets, in code points. Running sums and
maxima go by blocks of the square root of an array's size, and masking cuts pieces
out of short chunks of the text, so a text of very many findings costs little more
than its length.

Defined cases: a null text counts as empty and has no findings. Repeated rows
are scanned once and all get the findings. A run that died may have left rows
in the ledger; they are found again there, and repeated ones count once.
"""

from __future__ import annotations

import hashlib
from dataclasses import astuple, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyflow.llm.names import unused
from storyflow.shared import fresh_path, table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Group whose length must reach ``least``; 0 is the match.
    group: int = 0
    least: int = 1
    base: bool = False


#: A key from its BEGIN line to the END line of the same label. Where the next
#: marker is another or none, to the last line of base64; such lines may also be
#: long words of the same line, or follow an escaped line break. Loops over
#: groups are possessive, as Java matches those without recursion.
PRIVATE_KEY = (
    r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----(?:(?>[\s\S]*?-----)END \1PRIVATE KEY-----"
    r"|(?:(?:[ \t]*+\r?\n)++[ \t]*+(?:(?:Proc-Type|DEK-Info):[^\r\n]*+|[A-Za-z0-9+/=]++(?=[ \t]*+(?:[\r\n]|\z)))"
    r"|(?:\\r)?\\n[A-Za-z0-9+/=]++|[ \t]++[A-Za-z0-9+/=]{40,}+)*+)"
)
#: Fixed values. ``access`` and ``hex`` carry their lengths in the pattern:
#: matches are whole runs, so no shorter run could have hidden a longer one. A run
#: that begins as a ``jwt`` but isn't one is matched without its group and dropped,
#: so it isn't looked at again from every place in it.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++)|eyJ[A-Za-z0-9_-]*+", 1),
    Rule("private_key", PRIVATE_KEY),
    Rule("hosting_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
VERSION = "1"
MASK = "[SECRET]"
_SPAN = "struct<start:int,no:int,end:int,kind:string>"
_NONE = f"cast(array() as array<{_SPAN}>)"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, though lambdas use it often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(values: Column, merge, first: int) -> Column:
    """For each member of an int array, what ``merge`` makes of all before it, from ``first`` on."""

    def folded(part: Column) -> Column:
        return F.aggregate(part, F.lit(first), merge)

    def each(part: Column) -> Column:
        return F.transform(part, lambda _, i: folded(F.slice(part, F.lit(1), i)))

    def by_blocks(held: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(held))), F.lit(1)).cast("int")
        count = F.ceil(F.size(held) / width).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(held, k * width + 1, width))

        def joined(found: Column) -> Column:
            starts = _let(F.transform(found, folded), each)
            return F.flatten(F.zip_with(found, starts, lambda part, start: F.transform(each(part), lambda x: merge(x, start))))

        return F.when(F.size(held) > 0, _let(blocks, joined)).otherwise(F.expr("cast(array() as array<int>)"))

    return _let(values, by_blocks)


def _spans(text: Column, no: int, rule: Rule) -> Column:
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    whole = F.transform(F.regexp_extract_all(text, pattern, 0), F.char_length)
    value = F.transform(F.regexp_extract_all(text, pattern, rule.group), F.char_length)
    matches = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)), whole, value)
    matches = matches.cast("array<struct<gap:int,whole:int,value:int>>")

    def placed(held: Column) -> Column:
        before = _before(F.transform(held, lambda m: m["gap"] + m["whole"]), lambda a, x: a + x, 0)
        spans = F.zip_with(held, before, lambda m, at: F.struct((at + m["gap"]).alias("start"), F.lit(no).alias("no"), (at + m["gap"] + m["whole"]).alias("end"), F.lit(rule.kind).alias("kind"), m["value"].alias("value")))
        return F.transform(F.filter(spans, lambda s: s["value"] >= rule.least), lambda s: F.struct(*(s[c].alias(c) for c in ("start", "no", "end", "kind"))))

    return F.when(text.rlike(rule.pattern), _let(matches, placed)).otherwise(F.expr(_NONE))


def spans_of(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All findings of a non-null text by start, then rule."""
    return F.array_sort(F.concat(*(_spans(text, no, rule) for no, rule in enumerate(rules))))


def rules_digest(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr([astuple(r) for r in rules]).encode()).hexdigest()


def _ledger(spark: SparkSession, path: str, version: str, digest: str) -> DataFrame | None:
    try:
        rows = spark.read.schema(f"blob string, rule_version string, rules string, spans array<{_SPAN}>").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return rows.where((F.col("rule_version") == version) & (F.col("rules") == digest)).select("blob", "spans")


def scan(docs: DataFrame, ledger: str, text: str = "text", rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> DataFrame:
    """Bring the ledger at ``ledger`` up to date; return its rows with findings (blob, spans)."""
    spark, digest = docs.sparkSession, rules_digest(rules)
    blobs = docs.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    known = _ledger(spark, ledger, version, digest)
    if known is not None:
        blobs = blobs.join(known.select("blob").distinct(), "blob", "left_anti")
    unseen = blobs.dropDuplicates(["blob"])
    unseen.select("blob", F.lit(version).alias("rule_version"), F.lit(digest).alias("rules"), spans_of(F.col("body"), rules).alias("spans")).write.mode("append").parquet(ledger)
    return _ledger(spark, ledger, version, digest).where(F.size("spans") > 0).groupBy("blob").agg(F.any_value("spans").alias("spans"))


def findings(docs: DataFrame, ledger: str, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (empty where there are none)."""
    found = scan(docs, ledger, text, rules, version)
    paths = docs.select(F.col(doc_id).alias("doc_id"), blob_of(F.col(text)).alias("blob"))
    return paths.join(found, "blob", "left").select("doc_id", F.coalesce("spans", F.expr(_NONE)).alias("spans"))


#: Code points of the chunks out of which masking cuts.
CHUNK = 4096


def mask(text: Column, spans: Column, by: str = MASK) -> Column:
    """``text`` with every run of overlapping spans replaced."""

    def cut_out(chunks: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
        chunk = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
        within = F.substring(chunk(first), start % CHUNK + 1, end - start)
        across = F.concat(F.substring(chunk(first), start % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, first + 2, last - first - 1), ""), F.substring(chunk(last), F.lit(1), end % CHUNK))
        return F.when(first == last, within).otherwise(across)

    def masked(chunks: Column) -> Column:
        def pieces(held: Column) -> Column:
            before = _before(F.transform(held, lambda s: s["end"]), lambda a, x: F.greatest(a, x), 0)
            kept = F.zip_with(held, before, lambda s, at: F.when(s["start"] >= at, F.concat(cut_out(chunks, at, s["start"]), F.lit(by))).otherwise(""))
            return F.concat(F.array_join(kept, ""), _let(F.array_max(F.transform(held, lambda s: s["end"])), lambda at: cut_out(chunks, at, F.char_length(text))))

        return _let(spans, pieces)

    return F.when(F.size(spans) > 0, _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), masked)).otherwise(text)


def redact(docs: DataFrame, ledger: str, text: str = "text", rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> DataFrame:
    """``docs`` with the secrets in its texts masked."""
    blob, spans = unused(docs, "blob"), unused(docs, "spans")
    found = scan(docs, ledger, text, rules, version).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    joined = docs.join(found, blob_of(F.col(text)) == F.col(blob), "left")
    return joined.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(mask(F.col(text), F.col(spans)))).select(docs.columns)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(table(spark, sf_dir, "documents"), fresh_path(spark, "ledger"))
    base = [r.kind for r in RULES if r.base]
    counts = [F.size(_of(k)).cast("bigint").alias(f"n_{k}") for k in base]
    own = F.filter("spans", lambda s: s["no"] < len(base))
    return found.select("doc_id", *counts, F.sha2(_joined(own), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _of(kind: str) -> Column:
    return F.filter("spans", lambda s: s["kind"] == kind)
