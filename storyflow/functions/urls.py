"""URL functions: repair, canonical forms, ranges, extraction."""

from __future__ import annotations

from urllib.parse import urljoin

import pyarrow as pa
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

URL_PATTERN = r"https?://[^\s\"'<>()\[\]]+"


def repaired(url: Column) -> Column:
    """Trimmed, with a scheme, and without a fragment unless it is ``#post-``."""
    url = F.trim(url)
    url = F.when(url.rlike("^https?://"), url).when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(F.concat(F.lit("https://"), F.regexp_replace(url, "^[a-zA-Z]*:?/+", "")))
    return F.regexp_replace(url, "#(?!post-).*$", "")


def domain(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://(?:[^/@]*@)?([^/:?#]*)", 1))


def base_domain(url: Column) -> Column:
    """Domain without ``www.``."""
    return F.regexp_replace(domain(url), r"^www\.", "")


def site_key(url: Column) -> Column:
    """The last two labels of the domain."""
    return F.regexp_extract(domain(url), r"([^.]+\.[^.]+)$", 1)


def without_parameters(url: Column) -> Column:
    """Up to the first ``&``."""
    return F.regexp_replace(url, "&.*$", "")


def normalized(url: Column) -> Column:
    """Repaired, domain in lower case, without further parameters."""
    fixed = without_parameters(repaired(url))
    return F.concat(F.regexp_extract(fixed, "^([a-z]+://)", 1), domain(fixed), F.regexp_extract(fixed, "^[a-z]+://[^/?#]*(.*)$", 1))


def without_scheme(url: Column) -> Column:
    """Key by which http and https urls are equal."""
    return F.regexp_replace(url, "^https?:", "")


def chapter_range(url: Column) -> tuple[Column, Column, Column]:
    """(url, first, last) of ``url[3-5]``, ``[3,5]``, ``[3]``, ``[3,]`` or ``[-5]``."""
    pattern = r"^(.*?)(?:\[(\d*)([,-]?)(\d*)\])?$"
    base, first, sign, last = (F.regexp_extract(url, pattern, k) for k in (1, 2, 3, 4))
    begin = F.when(first != "", first.cast("int"))
    return base, begin, F.when(sign == "", begin).when(last != "", last.cast("int"))


def canonical(url: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The first rule (domain, pattern, replacement) that fits rewrites the url."""
    out = url
    for site, pattern, to in reversed(rules):
        fits = (base_domain(url) == site) & url.rlike(pattern)
        out = F.when(fits, F.regexp_replace(url, pattern, to)).otherwise(out)
    return out


def cleaned_link(url: Column) -> Column:
    """Links of mails and lists: ``/../`` folded, tracking parameters and entities gone."""
    url = F.replace(url, F.lit("&amp;"), F.lit("&"))
    url = F.regexp_replace(url, r"/[^/]+/\.\./", "/")
    return F.regexp_replace(F.regexp_replace(url, r"([?&])utm_[a-z]+=[^&#]*(?:&|(?=#|$))", "$1"), r"[?&]+(?=$|#)", "")


def from_text(text: Column) -> Column:
    """Urls of a text in order, without trailing punctuation."""
    return F.transform(F.regexp_extract_all(text, F.lit(URL_PATTERN), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))


def from_html(markup: Column) -> Column:
    """Targets of ``<a href>`` in order."""
    return F.regexp_extract_all(markup, F.lit("(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"']([^\"']*)[\"']"), F.lit(1))


def conditioned(url: Column) -> Column:
    """https, and spaces and non-ASCII characters percent-encoded."""
    url = F.regexp_replace(url, "^http:", "https:")
    chars = F.transform(F.split(url, ""), lambda c: F.when(c.rlike("^[!-~]?$"), c).when(c == " ", "%20").otherwise(F.url_encode(c)))
    return F.array_join(chars, "")


def page_of(index: Column, per_page: int) -> Column:
    """Reader page of a 0-based post."""
    return F.floor((index + per_page) / per_page).cast("bigint")


def folded_path(path: Column) -> Column:
    return F.regexp_replace(path, r"[^/]+/\.\./", "")


def path_part(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*/)[^/]*$", 1)


def shortened(url: Column, most: int = 4) -> Column:
    """The url and those with 1 to ``most`` characters less at its end."""
    return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.substring(url, F.lit(1), F.length(url) - k))


def _join(bases: pa.Array, links: pa.Array) -> pa.Array:
    out = []
    for base, link in zip(bases.to_pylist(), links.to_pylist()):
        try:
            out.append(None if link is None else urljoin(base or "", link.strip()))
        except ValueError:
            out.append(link)
    return pa.array(out, pa.string())


def absolute(base: Column, link: Column) -> Column:
    """``link`` as seen from ``base``; a link that can't be parsed stays."""

    def mapped(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for bases, links in batches:
            yield _join(bases, links)

    mapped.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(mapped, "string")(base, link)
