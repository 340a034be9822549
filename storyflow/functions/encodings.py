"""Bytes to text by a list of encodings, one of which may be a guess.

An entry is a codec name, a codec name with ``:ignore``, or ``auto``. The first
that reads the bytes wins; none of them, and the ASCII bytes stay. Nothing fails:
unknown codecs are passed over. Null in gives null out.
"""

from __future__ import annotations

import codecs
import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from storyflow.functions.text import arrow_text

ENCODINGS = ("utf-8", "windows-1252", "iso-8859-1")
CONFIDENCE = 0.9
#: Letters by frequency, in 1,000 letters beyond ASCII, of Russian and of western European texts.
CYRILLIC = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", [110, 85, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 1, 1], strict=True))
WESTERN = dict(zip("éäüöèàáíóñçßêåøæúâîôûëïãõìòù’“”–—…‘°§€", [200, 95, 85, 70, 60, 60, 45, 45, 45, 40, 30, 25, 25, 25, 15, 10, 15, 10, 8, 8, 5, 5, 5, 15, 8, 5, 5, 5, 90, 45, 45, 40, 25, 30, 10, 3, 3, 4], strict=True))
#: Single-byte encodings that are told apart by their letters.
GUESSED = {"windows-1251": CYRILLIC, "koi8-r": CYRILLIC, "cp866": CYRILLIC, "iso-8859-5": CYRILLIC, "windows-1252": WESTERN, "cp850": WESTERN, "mac-roman": WESTERN}
_RARE = 0.05


def _fits(high: dict[str, int], text: str, common: dict[str, int]) -> float:
    """Log-likelihood of the characters beyond ASCII; capitals count a tenth, and less inside a word."""
    score = 0.0
    for char, n in high.items():
        lower = char.lower()
        share = common.get(lower, 0) / 1000 * (0.1 if lower != char else 1)
        score += n * math.log(max(share, _RARE / 1000))
    inside = sum(1 for a, b in zip(text, text[1:]) if a.islower() and b.isupper() and b > "\x7f")
    return score - 3.0 * inside


def detected(data: bytes) -> tuple[str | None, float]:
    """The likeliest encoding and how sure that is, from marks, zero bytes, multi-byte forms and letters; few letters are never sure."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if data.startswith(mark):
            return name, 1.0
    if not data:
        return "ascii", 1.0
    even, odd = data[0::2].count(0) * 2 / len(data), data[1::2].count(0) * 2 / len(data)
    if len(data) % 2 == 0 and max(even, odd) > 0.3 and min(even, odd) < 0.1:
        return ("utf-16-be" if even > odd else "utf-16-le"), 0.95
    if data.isascii():
        return "ascii", 1.0
    try:
        data.decode("utf-8")
        several = sum(b >= 0xC0 for b in data)
        # A valid form of several bytes is a coincidence in about one of eight.
        return "utf-8", 1 - 0.125**several
    except UnicodeDecodeError:
        pass
    scores = {}
    for name, common in GUESSED.items():
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        high: dict[str, int] = {}
        for char in text:
            if char > "\x7f":
                high[char] = high.get(char, 0) + 1
        scores[name] = _fits(high, text, common)
    if not scores:
        return None, 0.0
    best = max(scores, key=scores.get)
    sure = 1 / sum(math.exp(max(-700.0, s - scores[best])) for s in scores.values())
    return best, sure * (1 - 0.5 ** sum(b > 127 for b in data))


def decode(data: bytes, encodings: Iterable[str] = ENCODINGS, confidence: float = CONFIDENCE) -> str:
    for entry in encodings:
        name, _, errors = entry.partition(":")
        if name == "auto":
            found, sure = detected(data)
            if found is None or sure <= confidence:
                continue
            name = found
        try:
            return data.decode(name, "ignore" if errors == "ignore" else "strict")
        except (UnicodeError, LookupError):
            continue
    return bytes(b for b in data if b < 128).decode("ascii")


def decoded(data: Column, encodings: Iterable[str] = ENCODINGS, confidence: float = CONFIDENCE) -> Column:
    """Text of bytes. Where UTF-8 comes first, valid UTF-8 is read without Python."""
    listed = tuple(encodings)
    other = arrow_text(lambda b: decode(b, listed, confidence))
    if not listed or listed[0].lower().replace("_", "-") not in ("utf-8", "utf8"):
        return other(data)
    valid = F.is_valid_utf8(data.cast("string"))
    return F.when(valid, data.cast("string")).otherwise(other(F.when(~valid, data)))


_FOUND = pa.struct([("encoding", pa.string()), ("confidence", pa.float64())])
#: Column function: struct<encoding, confidence> of bytes.
guessed = arrow_text(lambda b: dict(zip(("encoding", "confidence"), detected(b))), "struct<encoding:string,confidence:double>", _FOUND)
