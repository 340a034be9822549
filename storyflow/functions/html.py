"""HTML cleaning on the standard library's parser, and regex stages as Columns.

The parser repairs less than a browser does: unclosed elements are closed at the
end of their parent, stray end tags are dropped.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from storyflow.functions.text import arrow_text

#: Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


@dataclass(frozen=True)
class Cleaning:
    """What :func:`cleaned` keeps, drops and renames."""

    attributes: tuple[str, ...] = ("href", "name", "class", "id", "data-orighref")
    removed: tuple[str, ...] = ("script", "style")
    emptied: tuple[str, ...] = ("p", "td", "th")
    renamed: tuple[tuple[str, str, str], ...] = (("u", "span", "u"), ("center", "div", "center"))
    images: str = "drop"
    base: str = ""


class Markup(HTMLParser):
    """A parser that hands on texts as they were written, with or without whole entities."""

    def __init__(self):
        super().__init__(convert_charrefs=False)

    def reset(self):
        super().reset()
        self.clear_cdata_mode()

    def set_cdata_mode(self, elem, **how):
        super().set_cdata_mode(elem, **how)
        if elem.lower() != "plaintext":
            self.interesting = re.compile(rf"</{elem}(?=[\t\n\r\f />])", re.I | re.A)

    def clear_cdata_mode(self):
        super().clear_cdata_mode()
        self.interesting = re.compile("<")

    def close(self):
        super().close()
        if self.rawdata:  # the text of an element that isn't closed
            self.handle_data(self.rawdata)
            self.rawdata = ""


class _Cleaner(Markup):
    def __init__(self, how: Cleaning):
        super().__init__()
        self.how, self.out, self.open, self.gone = how, [], [], 0
        self.names = {a: (b, c) for a, b, c in how.renamed}

    def _attributes(self, attributes, kind: str | None) -> str:
        kept = [(k, v or "") for k, v in attributes if k in self.how.attributes]
        if kind:
            kept = [(k, v) for k, v in kept if k != "class"] + [("class", kind)]
        return "".join(f' {k}="{entities.escape(v)}"' for k, v in kept)

    def handle_starttag(self, tag, attributes):
        if tag in self.how.removed:
            self.gone += tag not in VOID
            return
        if self.gone:
            return
        if tag == "img":
            source = dict(attributes).get("src")
            if self.how.images == "keep" and source:
                self.out.append(f'<img src="{entities.escape(source)}"/>')
            return
        name, kind = self.names.get(tag, (tag, None))
        self.out.append(f"<{name}{self._attributes(attributes, kind)}{'/' if tag in VOID else ''}>")
        if tag not in VOID:
            self.open.append((tag, name, len(self.out)))

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self):
        tag, name, at = self.open.pop()
        inside = "".join(self.out[at:])
        if not inside.strip() and tag not in self.how.emptied:
            del self.out[at - 1 :]
            self.out.append(inside)
        else:
            self.out.append(f"</{name}>")

    def handle_endtag(self, tag):
        if tag in self.how.removed:
            self.gone -= self.gone > 0
        elif not self.gone and any(t == tag for t, *_ in self.open):
            while self.open[-1][0] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if not self.gone:
            self.out.append(data)

    def result(self) -> str:
        while self.open:
            self._close()
        return "".join(self.out)


def clean_markup(markup: str, how: Cleaning = Cleaning()) -> str:
    parser = _Cleaner(how)
    parser.feed(markup)
    parser.close()
    return parser.result()


def cleaned(how: Cleaning = Cleaning()):
    """Column function: attribute whitelist, removals, renames, empty elements."""
    return arrow_text(lambda t: clean_markup(t, how))


def without_wrappers(markup: Column) -> Column:
    """Without html, head and body tags."""
    return F.regexp_replace(markup, r"(?i)</?(?:html|head|body)\b[^>]*>", "")


def breaks_to_rule(markup: Column, least: int = 3) -> Column:
    """``least`` or more breaks in a row become one rule."""
    return F.regexp_replace(markup, rf"(?i)(?:<br\s*/?>\s*){{{least},}}", '<div class="center"><hr/></div>')


def without_empty_paragraphs(markup: Column) -> Column:
    return F.regexp_replace(markup, r"(?i)<p\b[^>]*>\s*</p>", "")


def rules_to_text(markup: Column) -> Column:
    return F.regexp_replace(markup, r"(?i)<hr\b[^>]*>", '<div class="center">* * *</div>')


def css_urls(css: Column) -> Column:
    """Targets of ``url()``, fonts left out."""
    found = F.regexp_extract_all(css, F.lit(r"url\(\s*[\"']?([^\"')]+)[\"']?\s*\)"), F.lit(1))
    return F.filter(found, lambda u: ~u.rlike(r"(?i)\.(?:ttf|otf|woff2?|eot)(?:[?#]|$)"))


_CSS_URL = r"url\(['\"]?.*?['\"]?\)"


def css_relinked(css: Column, targets: Column, kept: Column | None = None) -> Column:
    """Targets of ``url()`` replaced by what the map ``targets`` has for them.

    Fonts, names in the array ``kept`` and targets that the map lacks stay; all text
    outside the targets is as it was.
    """
    tokens = F.regexp_extract_all(css, F.lit(_CSS_URL), F.lit(0))

    def changed(token: Column) -> Column:
        target = F.regexp_extract(token, r"url\(['\"]?(.*?)['\"]?\)", 1)
        new = F.try_element_at(targets, target)
        stays = new.isNull() | F.lower(target).rlike(r"(?:^|\.)(?:ttf|otf|woff2?)$") | (target == "")
        if kept is not None:
            stays = stays | F.array_contains(kept, target)
        return F.when(stays, token).otherwise(F.replace(token, target, new))

    between = F.split(css, _CSS_URL, -1)
    return F.array_join(F.zip_with(between, F.transform(tokens, changed), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def hidden_classes(markup: Column) -> Column:
    """Classes whose style is ``display: none``."""
    return F.array_distinct(F.regexp_extract_all(markup, F.lit(r"\.([\w-]+)\s*\{[^}]*display\s*:\s*none"), F.lit(1)))


def paragraphs_from_breaks(markup: str) -> str:
    """Lines between breaks as paragraphs.

    The most frequent length of a run of breaks (2 or more, the longer on ties)
    ends a paragraph, longer runs also leave a spacer. Without such runs every
    break ends one if lines are long (90 characters on average or more).
    Markup that has paragraphs already stays.
    """
    if re.search(r"(?i)<p\b", markup) or not re.search(r"(?i)<br\b", markup):
        return markup
    runs = Counter(min(len(re.findall(r"(?i)<br", m[0])), 8) for m in re.finditer(r"(?i)(?:<br\s*/?>\s*)+", markup))
    long = {n: c for n, c in runs.items() if n >= 2}
    lines = [x for x in re.split(r"(?i)<br\s*/?>", markup) if x.strip()]
    if long:
        usual = max(long, key=lambda n: (long[n], n))
    elif sum(map(len, lines)) >= 90 * len(lines):
        usual = 1
    else:
        return f"<p>{markup.strip()}</p>"

    def ended(m: re.Match) -> str:
        n = len(re.findall(r"(?i)<br", m[0]))
        if n < usual:
            return m[0]
        return "</p>" + ('<p class="spacer">&nbsp;</p>' if n > usual else "") + "<p>"

    out = re.sub(r"(?i)(?:<br\s*/?>\s*)+", ended, markup.strip())
    return re.sub(r"<p>\s*</p>", "", f"<p>{out}</p>")


breaks_to_paragraphs = arrow_text(paragraphs_from_breaks)


class _Elements(HTMLParser):
    """Elements with their attributes and own text, in order."""

    def __init__(self):
        super().__init__()
        self.rows, self.open, self.data = [], [], []

    def handle_starttag(self, tag, attributes):
        self.rows.append({"tag": tag, "attributes": [(k, v or "") for k, v in dict(attributes).items()], "text": ""})
        if tag not in VOID:
            self.open.append((tag, len(self.rows) - 1, len(self.data)))

    def _close(self) -> str:
        tag, at, first = self.open.pop()
        self.rows[at]["text"] = "".join(self.data[first:])
        return tag

    def handle_endtag(self, tag):
        while any(t == tag for t, *_ in self.open):
            if self._close() == tag:
                break

    def handle_data(self, data):
        self.data.append(data)

    def close(self):
        super().close()
        while self.open:
            self._close()


def _elements(markup: str) -> list[dict]:
    parser = _Elements()
    parser.feed(markup)
    parser.close()
    return parser.rows


#: Column function: array<struct<tag, attributes, text>> of all elements.
elements = arrow_text(_elements, "array<struct<tag:string,attributes:map<string,string>,text:string>>", pa.list_(pa.struct([("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string())])))


def metadata_rows(markup: str) -> list[dict]:
    """Entries of ``<div class="metadata">``: ``<div class="KIND" id="NAME">``."""
    rows, inside = [], False
    for e in _elements(markup):
        a = dict(e["attributes"])
        if a.get("class") == "metadata":
            inside = True
        elif inside and e["tag"] == "div" and a.get("id"):
            rows.append({"entry": a["id"], "kind": a.get("class", ""), "value": e["text"].strip()})
    return rows


metadata_entries = arrow_text(metadata_rows, "array<struct<entry:string,kind:string,value:string>>", pa.list_(pa.struct([("entry", pa.string()), ("kind", pa.string()), ("value", pa.string())])))
