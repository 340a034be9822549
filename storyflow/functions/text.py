"""String functions: Columns where Spark has the means, Arrow UDFs elsewhere.

Null in gives null out unless a function says otherwise.
"""

from __future__ import annotations

import html
import re
import string
import textwrap
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from storyflow.functions.udf import lazy


#: Bytes of text that a task turns into Python objects at once; one text longer than this is still handled whole.
SLICE_BYTES = 1 << 20


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive slices of at most ``SLICE_BYTES``, or one text each."""
    start = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and total + n > SLICE_BYTES:
            yield texts.slice(start, i - start)
            start, total = i, 0
        total += n
    yield texts.slice(start)


def arrow_text(fn: Callable[[str], object], kind: str = "string", arrow: pa.DataType | None = None) -> Callable[[Column], Column]:
    """A Python function of one text as an Arrow UDF; nulls pass by."""
    arrow = arrow or pa.string()

    def mapped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in slices(batch):
                yield pa.array([None if x is None else fn(x) for x in part.to_pylist()], arrow)

    mapped.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return lazy(mapped, kind)


# --- tags and entities -------------------------------------------------------

#: What the short entity decoder knows, in the order it replaces.
BASIC_ENTITIES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def strip(text: Column) -> Column:
    """Trim white space of all of Unicode, as Python's ``strip`` does."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def drop_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def basic_entities(text: Column) -> Column:
    for name, value in BASIC_ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def strip_html(text: Column) -> Column:
    """Text without tags, basic entities decoded, trimmed."""
    return strip(basic_entities(drop_tags(text)))


_NUMERIC = re.compile(r"&#(?:[xX]([0-9a-fA-F]{1,4})|([0-9]{1,5}));")
_NAMED = re.compile(r"&([A-Za-z][A-Za-z0-9]*);?")
_KEPT = {"amp": "&", "lt": "<", "gt": ">"}


def decode_entities(text: str, remove_all: bool = False) -> str:
    """Numeric entities of up to 5 digits (4 hex) and named ones become characters.

    ``&amp; &lt; &gt;`` stay escaped, and lone ``& < >`` become so, unless
    ``remove_all``. An unknown name followed by ``;`` loses its semicolon.
    """

    def number(m: re.Match) -> str:
        code = int(m[1], 16) if m[1] else int(m[2])
        named = {38: "&amp;", 60: "&lt;", 62: "&gt;"}.get(code)
        return named or (chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0])

    def name(m: re.Match) -> str:
        if m[1] in _KEPT:
            return f"&{m[1]};"
        value = html.entities.html5.get(m[1] + ";")
        if value is None:
            return "&" + m[1]
        return value if m[0].endswith(";") or m[1] in html.entities.html5 else m[0]

    text = _NAMED.sub(name, _NUMERIC.sub(number, text))
    if remove_all:
        return text.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")
    text = re.sub(r"&(?!(?:amp|lt|gt);)", "&amp;", text)
    return text.replace("<", "&lt;").replace(">", "&gt;")


entities = arrow_text(decode_entities)
all_entities = arrow_text(lambda t: decode_entities(t, True).strip())


def escape_xml(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


# --- numbers, names, titles --------------------------------------------------


def comma_groups(text: Column) -> Column:
    """Commas between thousands of the digits that end a text."""
    return F.regexp_replace(text.cast("string"), r"(?<=\d)(?=(?:\d{3})+$)", ",")


def digits(text: Column) -> Column:
    """The digits of a text as a number, null without any or where they are more than a bigint holds."""
    return F.regexp_replace(text, "[^0-9]", "").try_cast("bigint")


def file_name(text: Column) -> Column:
    """Every run of characters that are unsafe in paths becomes ``_``."""
    return F.regexp_replace(text, r"(^\.|/\.|[^a-zA-Z0-9_\. \[\]\(\)&'-]+)", "_")


def without_number(title: Column) -> Column:
    """A title without its leading number, unless nothing else or a digit follows."""
    return F.regexp_replace(title, r"^[0-9]+[\.: -]+(?=[^0-9]|$)", "")


def decorated(title: Column, number: Column, chapters: Column, new: Column, add_numbers: bool = True, mark_new: bool = True) -> Column:
    """Number and mark of a listed title; single chapters get no number."""
    numbered = (chapters > 1) & F.lit(add_numbers)
    marked = new & F.lit(mark_new)
    head = F.when(numbered, F.concat(number.cast("string"), F.lit(". "))).otherwise("")
    return F.concat(F.when(marked, "(new) ").otherwise(""), head, title)


def _title_case(text: str) -> str:
    return re.sub(r"(?<=[\w])(['’])(S|T|Re|Ve|M|Ll|D)\b", lambda m: m[1] + m[2].lower(), text.title())


title_case = arrow_text(_title_case)


def label(name: str, labels: dict[str, str]) -> str:
    """An entry's configured label, else its name in title case."""
    return labels.get(name) or name.title()


def reduce_marks(most: int) -> Callable[[Column], Column]:
    """At most ``most`` combining marks in a row; negative leaves texts alone."""

    def reduced(text: str) -> str:
        out, run = [], 0
        for c in unicodedata.normalize("NFD", text):
            run = run + 1 if unicodedata.category(c) in ("Mn", "Me") else 0
            if run <= most:
                out.append(c)
        return "".join(out)

    return arrow_text(reduced) if most >= 0 else lambda c: c


#: Cyrillic letters and what they are romanised to; a capital becomes one but for those of ``_LOWER``.
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґ", ["a", "b", "v", "gh", "d", "ie", "io", "zh", "z", "i", "y", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "h", "ts", "ch", "sh", "shch", "'", "y", "'", "e", "yu", "ya", "i", "y", "ie", "g"], strict=True))
_LOWER = "йъыьюяієґ"
_ROMAN = {ord(k): v for k, v in CYRILLIC.items()} | {ord(k.upper()): v if k in _LOWER else v.capitalize() for k, v in CYRILLIC.items()}
romanize = arrow_text(lambda t: t.translate(_ROMAN))


# --- spaces and lines --------------------------------------------------------


def squeeze(text: Column) -> Column:
    """Two or more ASCII white spaces become one space."""
    return F.regexp_replace(text, r"[ \t\n\r\f\x0B]{2,}", " ")


def truncated(text: Column, limit: int) -> Column:
    return F.substring(squeeze(text), 1, limit)


def excess_space(text: Column) -> Column:
    """Blank lines become paragraphs, and runs of breaks one paragraph."""
    lines = F.regexp_replace(text, r"(?U)\n\s*\n", "<p>")
    return F.regexp_replace(lines, r"(?iU)(?:\s*<(?:p|br)\s*/?>\s*){2,}", "<p>")


def line_ends(text: Column, dos: bool = False) -> Column:
    unix = F.replace(text, F.lit("\r"), F.lit(""))
    return F.replace(unix, F.lit("\n"), F.lit("\r\n")) if dos else unix


def wrapped(width: int) -> Callable[[Column], Column]:
    """Every line wrapped by itself; width 0 or less leaves texts alone."""
    return arrow_text(lambda t: "\n".join("\n".join(textwrap.wrap(line, width)) if line else "" for line in t.split("\n"))) if width > 0 else lambda c: c


def _plain(markup: str) -> str:
    text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", markup)
    text = re.sub(r"(?i)<br\s*/?>", "\n", text)
    text = re.sub(r"(?i)<hr\b[^>]*>", "\n* * *\n", text)
    text = re.sub(r"(?i)</?(p|div|h[1-6]|li|tr|blockquote)\b[^>]*>", "\n\n", text)
    text = html.unescape(re.sub(r"<[^>]+>", "", text))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


html_to_text = arrow_text(_plain)


# --- lists, templates, secrets ----------------------------------------------


def split_list(text: Column) -> Column:
    """Members between commas, ``\\,`` being a comma; trimmed, blanks dropped."""
    parts = F.transform(F.split(text, r"(?<!\\),"), lambda x: strip(F.replace(x, F.lit("\\,"), F.lit(","))))
    return F.filter(parts, lambda x: x != "")


def template(pattern: str, values: dict[str, Column], safe: bool = False) -> Column:
    """``${name}`` filled from columns; unknown names are errors unless ``safe``."""
    parts, at = [], 0
    for m in string.Template.pattern.finditer(pattern):
        name = m["named"] or m["braced"]
        parts.append(F.lit(pattern[at : m.start()]))
        at = m.end()
        if name in values:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        elif m["escaped"] is not None:
            parts.append(F.lit("$"))
        elif safe:
            parts.append(F.lit(m[0]))
        else:
            raise KeyError(name or m[0])
    return F.concat(*parts, F.lit(pattern[at:]))


def mask_url_secrets(url: Column) -> Column:
    """Values of name, login and password parameters become XXXXXXXX."""
    return F.regexp_replace(url, r"(?i)((?:pass(?:word)?|name|login)[^=&?]?=)[^&]*", "$1XXXXXXXX")


def _unmasked(code: str) -> str:
    digits = "0123456789abcdef"
    if re.fullmatch("(?:[0-9a-fA-F]{2})+", code):
        key, *rest = bytes.fromhex(code)
    else:  # of a pair that isn't hex counts what begins as hex
        pairs = [code[i : i + 2].strip().lower() or "0" for i in range(0, len(code) - 1, 2)]
        key, *rest = [int(p if p[-1] in digits else p[0], 16) if p[0] in digits else 0 for p in pairs] or [0]
    return "".join(chr(b ^ key) for b in rest)


_unmask = arrow_text(_unmasked)


def decode_email(code: Column) -> Column:
    """Hex whose first byte was combined into every other one by exclusive or."""
    return escape_xml(_unmask(code))


def decode_bytes(data: Column, fallback: str = "windows-1252") -> Column:
    """UTF-8 where it is valid, else another encoding; only those rows reach Python."""
    valid = F.is_valid_utf8(data.cast("string"))
    other = arrow_text(lambda b: b.decode(fallback, "replace"))
    return F.when(valid, data.cast("string")).otherwise(other(F.when(~valid, data)))


def word_count(text: Column) -> Column:
    """Runs of word characters, dots being followed by a space first."""
    return F.size(F.regexp_extract_all(F.replace(text, F.lit("."), F.lit(". ")), F.lit(r"(?U)\w+"), F.lit(0))).cast("bigint")


def labelled_parts(text: Column, labels: list[str]) -> Column:
    """Parts between `` - `` that start with none of the labels, joined again."""
    known = "^(?:" + "|".join(map(re.escape, labels)) + "):"
    return F.array_join(F.filter(F.split(text, " - "), lambda x: ~x.rlike(known)), " - ")


def bracketed(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[(.*?)\]"), F.lit(1))


def chapter_title(title: Column, story: Column) -> Column:
    """A chapter's title without its story's, ``ch.`` and ``pt.`` spelled out."""
    rest = F.when(F.startswith(F.lower(title), F.lower(story)), strip(F.substring(title, F.length(story) + 1, F.length(title)))).otherwise(title)
    for short, full in (("ch", "Chapter"), ("pt", "Part")):
        rest = F.regexp_replace(rest, rf"(?i)^[-:, ]*{short}\.? ?0*(\d+)", f"{full} $1")
    return F.when(rest == "", title).otherwise(rest)


def id_of(text: Column) -> Column:
    """Lower case, spaces as dashes, punctuation dropped."""
    return F.translate(F.lower(F.replace(text, F.lit(" "), F.lit("-"))), "\"'.,!?:;()[]{}/\\", "")


def common_prefix(values: Column) -> Column:
    """Longest prefix of all texts of an array, in the first one's spelling, case ignored."""
    first = F.element_at(values, 1)

    def shorter(acc: Column, x: Column) -> Column:
        n = F.least(F.length(acc), F.length(x))
        same = F.filter(F.sequence(F.lit(0), n), lambda k: F.lower(F.substring(acc, F.lit(1), k)) == F.lower(F.substring(x, F.lit(1), k)))
        return F.substring(acc, F.lit(1), F.array_max(same))

    return F.when(F.size(values) > 0, F.aggregate(values, first, shorter)).otherwise("")
