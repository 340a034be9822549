"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is normalised, cut where no piece of the vocabulary reaches across, and
each segment is merged by an agenda of adjacent symbol pairs: the pair that makes
the piece of the best score goes first, the left one on ties. Characters without
a piece become byte pieces. Each Python worker keeps the ids of up to ``MEMO``
recent segments. Every Arrow batch is also encoded by the sentencepiece library,
and a row says whether both agree.

Defined cases: a null text counts as empty; an empty text has no ids, and their
digest is that of no bytes. Invalid UTF-8 is replaced first, as the library
replaces it. Equal texts give equal ids; other columns are kept as they are.
Models with another algorithm, user-defined or unused pieces, a character map or
trimmed white space are refused by an error when the model is loaded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyflow.llm.arrowtext import text_column
from storyflow.shared import table

MODEL = "piece_bpe_32k.model"
#: Fixed values of the format: the mark of a space, what an unknown id decodes to, piece types, the merge-type algorithm.
SPACE, UNKNOWN_TEXT = "▁", " ⁇ "
NORMAL, UNKNOWN, CONTROL, BYTE, MERGES = 1, 2, 3, 6, 2
#: Segments whose ids a worker remembers; beyond that, those not seen in as many others go.
MEMO = 300_000
#: Longer segments are not remembered.
MEMO_CHARS = 48
#: Characters of a segment whose agenda is a list.
SHORT = 40
_NONE = float("inf")


class Vocabulary:
    """Pieces, scores and settings of a model file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        read = sentencepiece_model_pb2.ModelProto.FromString(model)
        kinds = [p.type for p in read.pieces]
        how = read.normalizer_spec
        if read.trainer_spec.model_type != MERGES or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE} or kinds.count(BYTE) != 256:
            raise ValueError("only merge-type models of plain and byte pieces are supported")
        if how.precompiled_charsmap or how.remove_extra_whitespaces or not how.escape_whitespaces or read.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep texts but for marked spaces are supported")
        self.model, self.digest = model, hashlib.sha256(model).hexdigest()
        self.prefix = SPACE if how.add_dummy_prefix else ""
        self.pieces, self.kinds = [p.piece for p in read.pieces], kinds
        self.ids = {p.piece: i for i, p in enumerate(read.pieces) if p.type == NORMAL}
        #: The lower, the sooner a pair is merged into the piece.
        self.order = {p.piece: -p.score for p in read.pieces if p.type == NORMAL}
        #: Pieces that merging their own characters gives; only these may stand for a whole segment.
        self.whole = {p: i for p, i in self.ids.items() if merge(p, self.order) == [p]}
        self.byte = [0] * 256
        for i, p in enumerate(read.pieces):
            if p.type == BYTE:
                self.byte[int(p.piece[1:-1], 16)] = i

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as file:
            return cls(file.read())

    def segments(self) -> Callable[[str], list[str]]:
        """Cuts a normalised text between characters that no piece holds side by side.

        Characters of no longer piece stand alone. Before a marked space a cut is
        safe where marked spaces only begin pieces or make up whole ones.
        """
        long = [p for p in self.ids if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in long):
            return lambda text: [text] if text else []
        joined = "".join(map(re.escape, sorted(set("".join(long)) - {SPACE})))
        if not joined:
            return list
        return re.compile(f"{SPACE}*[{joined}]+|{SPACE}+|.", re.S).findall


def merge(text: str, order: dict[str, float]) -> list[str]:
    """Symbols that are left when no adjacent pair makes a piece.

    The agenda of a short text is a list of its pairs' scores, in which the best
    one is looked up; a longer text's is a heap.
    """
    if len(text) > SHORT:
        return merge_long(text, order)
    symbols, get = list(text), order.get
    agenda = [get(a + b, _NONE) for a, b in zip(symbols, symbols[1:])]
    while agenda and (best := min(agenda)) is not _NONE:
        i = agenda.index(best)
        del agenda[i]
        symbols[i] += symbols.pop(i + 1)
        if i:
            agenda[i - 1] = get(symbols[i - 1] + symbols[i], _NONE)
        if i < len(agenda):
            agenda[i] = get(symbols[i] + symbols[i + 1], _NONE)
    return symbols


def merge_long(text: str, order: dict[str, float]) -> list[str]:
    """As :func:`merge`, with entries (score, place of the left symbol, both symbols' ends) in a heap.

    An entry whose symbols have changed since is passed over.
    """
    n = len(text)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := order.get(text[i : i + 2])) is not None]
    heapify(agenda)
    while agenda:
        _, i, middle, stop = heappop(agenda)
        if end[i] != middle or end[middle] != stop:
            continue
        end[i], end[middle] = stop, -1
        if stop < n:
            before[stop] = i
            if (r := order.get(text[i : end[stop]])) is not None:
                heappush(agenda, (r, i, stop, end[stop]))
        if (h := before[i]) >= 0 and (r := order.get(text[h:stop])) is not None:
            heappush(agenda, (r, h, i, stop))
    symbols, i = [], 0
    while i < n:
        symbols.append(text[i : end[i]])
        i = end[i]
    return symbols


class Tokenizer:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.cut = vocabulary, vocabulary.segments()
        self.memo, self.older = {}, {}
        self.library = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.model)
        self.names = [str(i) for i in range(len(vocabulary.pieces))]
        self.bytes_of = [self._bytes(i) for i in range(len(vocabulary.pieces))]

    def _bytes(self, i: int) -> bytes:
        """What an id stands for inside a text."""
        kind, piece = self.vocabulary.kinds[i], self.vocabulary.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        return b"" if kind == CONTROL else UNKNOWN_TEXT.encode() if kind == UNKNOWN else piece.replace(SPACE, " ").encode()

    def _segment(self, segment: str) -> tuple[int, ...]:
        """Ids of a segment that is not among the recent ones."""
        found = self.older.get(segment)
        if found is None:
            own, whole = self.vocabulary, self.vocabulary.whole.get(segment)
            if whole is None:
                ids = own.ids
                found = []
                for symbol in merge(segment, own.order):
                    found.extend([ids[symbol]] if symbol in ids else [own.byte[b] for b in symbol.encode()])
                found = tuple(found)
            else:
                found = (whole,)
        if len(segment) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo, self.older = {}, self.memo
            self.memo[segment] = found
        return found

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        own, found = self._segment, []
        for segments in _some(self.cut(self.vocabulary.prefix + text.replace(" ", SPACE))):
            memo = self.memo.get
            found.append([memo(s) or own(s) for s in segments])
        return list(chain.from_iterable(chain.from_iterable(found)))

    def decode(self, ids: list[int]) -> str:
        """Text of any ids: the first mark before any text is the prefix, and goes.

        Runs of byte pieces are read as UTF-8; every byte that no valid character
        holds becomes a replacement character of its own.
        """
        own, raw = self.vocabulary, list(map(self.bytes_of.__getitem__, ids))
        if own.prefix:
            at = next((k for k, i in enumerate(ids) if own.kinds[i] != CONTROL), None)
            if at is not None and own.kinds[ids[at]] == NORMAL and own.pieces[ids[at]].startswith(SPACE):
                raw[at] = raw[at][1:]
        whole = b"".join(raw)
        try:
            return whole.decode()
        except UnicodeDecodeError:
            return _utf8(whole)


def _some(segments: list[str], limit: int = 100_000) -> Iterator[list[str]]:
    """A list in parts, so that one text's segments don't outlive the memo."""
    return (segments[i : i + limit] for i in range(0, len(segments), limit)) if len(segments) > limit else iter((segments,))


def _utf8(raw: bytes) -> str:
    """Every byte that no valid character holds becomes a replacement character of its own."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


_own: dict[str, Tokenizer] = {}


def _tokenizer(held) -> Tokenizer:
    """This worker's tokenizer for a broadcast vocabulary."""
    vocabulary = held.value
    if vocabulary.digest not in _own:
        _own.clear()
        _own[vocabulary.digest] = Tokenizer(vocabulary)
    return _own[vocabulary.digest]


def _shared(spark: SparkSession, path: str | None):
    return spark.sparkContext.broadcast(Vocabulary.load(path or public_tokenizers.path(MODEL)))


def encoder(spark: SparkSession, path: str | None = None) -> Callable[[Column], Column]:
    """Column function: text to array of ids. The model file is read on the driver."""
    held = _shared(spark, path)

    def encoded(texts: list[bytes | None]) -> pa.Array:
        return pa.array([_tokenizer(held).encode((t or b"").decode("utf-8", "replace")) for t in texts], pa.list_(pa.int32()))

    return text_column(encoded, "array<int>")


def decoder(spark: SparkSession, path: str | None = None) -> Callable[[Column], Column]:
    """Column function: array of ids to text; null stays null, an id outside the vocabulary is an error."""
    held = _shared(spark, path)

    def decoded(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in ids:
            yield pa.array([None if x is None else _tokenizer(held).decode(x) for x in batch.to_pylist()], pa.string())

    decoded.__annotations__ = {"ids": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(decoded, "string")


def digests(spark: SparkSession, path: str | None = None) -> Callable[[Column], Column]:
    """Column function: text to struct<n_tokens, ids_sha256, decoded_sha256, checked>.

    ``checked`` says that the library gives the same ids for the whole text.
    """
    held = _shared(spark, path)

    def digested(texts: list[bytes | None]) -> pa.Array:
        own, rows = _tokenizer(held), []
        whole = [(t or b"").decode("utf-8", "replace") for t in texts]
        plain = own.library.encode(whole, num_threads=1) if whole else []
        for text, ids in zip(whole, plain):
            found = own.encode(text)
            names = ",".join(map(own.names.__getitem__, found)).encode()
            rows.append((len(found), hashlib.sha256(names).hexdigest(), hashlib.sha256(own.decode(found).encode()).hexdigest(), found == ids))
        kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_()]
        columns = list(zip(*rows)) or [()] * 4
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["n_tokens", "ids_sha256", "decoded_sha256", "checked"])

    return text_column(digested, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string,checked:boolean>")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", digests(spark)(F.col("text")).alias("r")).select("doc_id", "r.*")
