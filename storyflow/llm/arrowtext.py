"""Arrow helpers for operators that look at whole texts inside tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that a task turns into Python objects or numpy arrays at once.
#: One text longer than this is still handled whole.
CHUNK_BYTES = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")


def slices(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of at most ``limit`` bytes, or one text each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield texts.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield texts.slice(start)


def pieces(text: bytes | None, limit: int = CHUNK_BYTES) -> Iterator[bytes]:
    """``text`` in pieces of about ``limit`` bytes, cut at an ASCII white space; a word is never cut."""
    text, at = text or b"", 0
    while len(text) - at > limit:
        found = _SPACE.search(text, at + limit)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def grouped(given: list[tuple[int, bytes]], limit: int = CHUNK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """Consecutive pieces with about ``limit`` bytes together."""
    held, size = [], 0
    for one in given:
        held.append(one)
        size += len(one[1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def ascii_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, A-Z in lower case, and the place of each one's text; null has none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, counts = split.flatten(), pc.fill_null(split.value_lengths(), 0).to_numpy()
    owner = np.repeat(np.arange(len(texts)), counts)
    there = pc.greater(pc.binary_length(words), 0)
    return words.filter(there), owner[there.to_numpy(zero_copy_only=False)]


def short_parts(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Arrays of about a megabyte of text or of pieces of one text, and the place of each one's text."""
    start = 0
    for part in slices(texts):
        if len(part) == 1 and part[0].is_valid and len(text := part.cast(pa.binary())[0].as_py()) > CHUNK_BYTES:
            for piece in pieces(text):
                yield pa.array([piece], pa.binary()).view(pa.string()), np.array([start])
        else:
            yield part, np.arange(start, start + len(part))
        start += len(part)


def array_column(fn: Callable[[pa.Array], pa.Array], schema: str) -> Callable[[Column], Column]:
    """A column function: ``fn`` maps an Arrow array of about a megabyte of text, or of one text, to an Arrow array."""

    def mapped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [fn(part) for part in slices(batch)]
            yield pa.concat_arrays(parts) if parts else fn(batch)

    mapped.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(mapped, schema)


def text_column(fn: Callable[[list[bytes | None]], pa.Array], schema: str) -> Callable[[Column], Column]:
    """A column function: ``fn`` maps UTF-8 texts (or None) to an Arrow array.

    Rows stay with their other columns, so nulls, repeated rows and clashing
    names of other columns need no care in ``fn``.
    """

    def mapped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [fn(part.cast(pa.binary()).to_pylist()) for part in slices(batch)]
            yield pa.concat_arrays(parts) if parts else fn([])

    mapped.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(mapped, schema)
