"""Chat formatting from an event log.

A log row is (conv_id, msg, seq, kind, role, text). Logs are partitioned by
conversation and sorted by (msg, seq); one pass folds them into messages:
``open`` begins a message with its role, ``delta`` appends text, ``edit``
replaces what is there, ``regenerate`` drops it. An event that was delivered
again, with equal values in all columns, counts once. Different events with one
seq are folded by kind (open, regenerate, edit, delta), role, then text. Rendering writes a segment per
message, so neither a long conversation nor its formatted text is ever held
whole; a conversation's output is its segments in order.

In roles and texts a backslash, ``<`` and ``[`` are written ``\\e``, ``\\l`` and
``\\b``, a line break in a role ``\\n``; no control string of common templates survives that, and reading back
is exact. The loss mask is a range of code points of each segment.

Defined cases: a null text or role is empty; rows of one conversation with the
same turn are ordered by role and text, and repeated rows are turns of their
own; rows with a null conv_id form one conversation with a null id. Events of
a message that was never opened give it an empty role; unknown kinds are errors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyflow.shared import table

#: Kinds of events, in the order in which those of one seq are folded.
KINDS = ("open", "regenerate", "edit", "delta")
TURN, END = "<|turn|>", "<|end|>\n"
#: Rows and bytes that a task gathers before it hands them on.
ROWS, BYTES = 2000, 4 << 20
_UNESCAPED = {"\\e": "\\", "\\l": "<", "\\b": "[", "\\n": "\n"}


def escape(text: str) -> str:
    return text.replace("\\", "\\e").replace("<", "\\l").replace("[", "\\b")


def unescape(text: str) -> str:
    return re.sub(r"\\[elbn]", lambda m: _UNESCAPED[m[0]], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A message's segment and the range of it that counts for the loss."""
    head = TURN + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body) * (role == "assistant")


def read(segment: str) -> tuple[str, str]:
    """Role and text of a segment."""
    if not segment.startswith(TURN) or not segment.endswith(END):
        raise ValueError("not a rendered message")
    role, _, body = segment[len(TURN) : -len(END)].partition("\n")
    return unescape(role), unescape(body)


def _emit(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= ROWS or size >= BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("segment", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def messages() -> Iterator[tuple]:
        key, role, parts, before = None, "", [], None
        for conv, msg, seq, _, kind, who, text in _rows(batches):
            if before == (before := (conv, msg, seq, kind, who, text)):
                continue
            if key != (conv, msg):
                if key:
                    yield (*key, *render(role, "".join(parts)))
                key, role, parts = (conv, msg), "", []
            if kind == "open":
                role = who or ""
            elif kind == "delta":
                parts.append(text or "")
            elif kind == "edit":
                parts = [text or ""]
            elif kind == "regenerate":
                parts = []
            else:
                raise ValueError(f"unknown event {kind}")
        if key:
            yield (*key, *render(role, "".join(parts)))

    return _emit(messages(), _SEGMENTS)


def reconstruct(events: DataFrame) -> DataFrame:
    """Log to segments: conv_id, part, segment, loss_start, loss_end."""
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    log = events.select("conv_id", "msg", "seq", place.alias("place"), "kind", "role", "text")
    ordered = log.repartition("conv_id").sortWithinPartitions("conv_id", "msg", "seq", "place", "kind", "role", "text")
    return ordered.mapInArrow(_fold, "conv_id bigint, part bigint, segment string, loss_start bigint, loss_end bigint")


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def conversations() -> Iterator[tuple]:
        own, first = None, True
        for conv, _, segment, start, end in _rows(batches):
            if first or conv != own:
                if not first:
                    yield own, turns, all_text.hexdigest(), chars, loss.hexdigest(), total
                own, first, turns, chars, total = conv, False, 0, 0, 0
                all_text, loss = hashlib.sha256(), hashlib.sha256()
            role, text = read(segment)
            kept = unescape(segment[start:end])
            all_text.update(f"{role}\n{text}\n".encode())
            loss.update(kept.encode())
            turns, chars, total = turns + 1, chars + len(kept), total + len(segment)
        if not first:
            yield own, turns, all_text.hexdigest(), chars, loss.hexdigest(), total

    return _emit(conversations(), _READ)


def read_back(segments: DataFrame) -> DataFrame:
    """What the segments of each conversation hold, in order."""
    ordered = segments.select("conv_id", "part", "segment", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(_digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def to_events(rows: DataFrame) -> DataFrame:
    """A streamed log of finished rows (conv_id, turn, role, text).

    Messages arrive in two deltas; every third was regenerated after a draft,
    and every third was edited into its final text.
    """
    text: Column = F.coalesce("text", F.lit(""))
    msg = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint")
    half = (F.length(text) / 2).cast("int")

    def event(seq: int, kind: str, value: Column) -> Column:
        role = F.col("role") if kind == "open" else F.lit(None).cast("string")
        return F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), value.alias("text"))

    none = F.lit(None).cast("string")
    head, tail = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    deltas = [event(3, "delta", head), event(4, "delta", tail)]
    plain = F.array(event(1, "open", none), *deltas)
    again = F.array(event(1, "open", none), event(2, "delta", F.reverse(tail)), event(3, "regenerate", none), event(4, "delta", head), event(5, "delta", tail))
    edited = F.array(event(1, "open", none), event(2, "delta", tail), event(3, "edit", head), event(4, "delta", tail))
    log = F.when(F.col("msg") % 3 == 0, again).when(F.col("msg") % 3 == 1, edited).otherwise(plain)
    numbered = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").withColumn("msg", msg)
    return numbered.select("conv_id", "msg", F.explode(log).alias("e")).select("conv_id", "msg", "e.*")


_SQL_ESCAPED = r"replace(replace(replace({}, '\', '\e'), '<', '\l'), '[', '\b')"
SQL = f"""
with rows_ as (select conv_id::bigint as conv_id, turn::bigint as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum({len(TURN) + 1 + len(END)} + length(replace({_SQL_ESCAPED.format("role")}, chr(10), '\\n')) + length({_SQL_ESCAPED.format("text")}))::bigint as formatted_chars
from rows_ group by conv_id
"""


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    odd = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(reconstruct(to_events(rows.unionByName(odd))))
