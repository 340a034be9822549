"""Queries over pages and texts: urls, html, words."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyflow.functions import html, text, urls
from storyflow.operators import keys, lookups
from storyflow.plans.registry import query
from storyflow.rules import engine, language
from storyflow.shared import table

_NORMAL = """
  select page_id, url, regexp_extract(fixed, '^([a-z]+://)', 1)
    || lower(regexp_extract(fixed, '^[a-z]+://(?:[^/@]*@)?([^/:?#]*)', 1))
    || regexp_extract(fixed, '^[a-z]+://[^/?#]*(.*)$', 1) as normal_url
  from (select page_id, url, regexp_replace(case when url like '%#post-%' then trim(url) else regexp_replace(trim(url), '#.*$', '') end, '&.*$', '') as fixed from pages)
"""

_ENTITIES = "regexp_replace({0}, '<[^>]+>', '', 'g')"
for _name, _value in text.BASIC_ENTITIES:
    _ENTITIES = f"replace({_ENTITIES}, '{_name.replace(chr(39), chr(39) * 2)}', '{_value.replace(chr(39), chr(39) * 2)}')"
_STRIPPED_HTML = "regexp_replace(regexp_replace(" + _ENTITIES.replace("{0}", "html") + ", '^[\\s\\p{Z}]+', ''), '[\\s\\p{Z}]+$', '')"


@query(_NORMAL)
def url_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", urls.normalized(F.col("url")).alias("normal_url"))


@query("""
  select page_id, regexp_extract(u, '^(.*?)(?:\\[(\\d*)([,-]?)(\\d*)\\])?$', 1) as base_url,
    try_cast(regexp_extract(u, '\\[(\\d*)', 1) as integer) as first_chapter, try_cast(regexp_extract(u, '-(\\d+)\\]$', 1) as integer) as last_chapter,
    regexp_extract(lower(regexp_extract(u, '^[a-z]+://(?:[^/@]*@)?([^/:?#]*)', 1)), '([^.]+\\.[^.]+)$', 1) as site_key
  from (select page_id, url || case when page_id % 3 = 0 then '[' || page_id % 7 || '-' || (page_id % 7 + 3) || ']' else '' end as u from pages)
""")
def url_fragment_param_variants(spark, sf):
    with_range = F.concat("url", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("["), (F.col("page_id") % 7).cast("string"), F.lit("-"), (F.col("page_id") % 7 + 3).cast("string"), F.lit("]"))).otherwise(""))
    pages = table(spark, sf, "pages").select("page_id", with_range.alias("u"))
    base, first, last = urls.chapter_range(F.col("u"))
    return pages.select("page_id", base.alias("base_url"), first.alias("first_chapter"), last.alias("last_chapter"), urls.site_key(F.col("u")).alias("site_key"))


@query("""
  select page_id, unnest(range(1, len(found) + 1)) as place, regexp_replace(unnest(found), '[.,;:!?]+$', '') as url
  from (select page_id, regexp_extract_all('see (' || url || '), or <' || url || '>; also ' || url || '!', 'https?://[^\\s"''<>()\\[\\]]+') as found from pages)
""")
def url_extract_text(spark, sf):
    said = F.concat(F.lit("see ("), "url", F.lit("), or <"), "url", F.lit(">; also "), "url", F.lit("!"))
    found = table(spark, sf, "pages").select("page_id", F.posexplode(urls.from_text(said)).alias("place", "url"))
    return found.select("page_id", (F.col("place") + 1).cast("bigint").alias("place"), "url")


_LINKS = """select page_id, unnest(range(1, len(found) + 1)) as place, unnest(found) as link
  from (select page_id, regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1) as found from pages)"""


def _links(spark, sf):
    found = table(spark, sf, "pages").select("page_id", F.posexplode(urls.from_html(F.col("html"))).alias("place", "link"))
    return found.withColumn("place", (F.col("place") + 1).cast("bigint"))


@query(_LINKS)
def url_links_exploded(spark, sf):
    return _links(spark, sf)


@query(f"""
  select story, link, page_id from (select *, row_number() over (partition by story order by length(link) desc, page_id, place) as n
    from (select *, lower(regexp_replace(link, '[.,;:!?]', '', 'g')) as story from ({_LINKS}))) where n = 1
""")
def url_longest_per_story(spark, sf):
    found = _links(spark, sf).withColumn("story", F.lower(F.regexp_replace("link", "[.,;:!?]", "")))
    found = found.withColumn("ord", F.struct("page_id", "place"))
    return keys.longest_first(found, ["story"], "link", "ord").select("story", "link", "page_id")


_SITES = [("example.com", "/en/", "english", 0), ("example.com", None, "other", 1), ("www.example.net", None, "net", 2)]


@query("""
  with d as (select page_id, url, lower(regexp_extract(url, '^[a-z]+://(?:[^/@]*@)?([^/:?#]*)', 1)) as domain from pages),
  b as (select page_id, url, regexp_extract(domain, '([^.]+\\.[^.]+)$', 1) as site from d)
  select page_id, case when site = 'example.com' and contains(url, '/en/') then 'english' when site = 'example.com' then 'other' when site = 'example.net' then 'net' end as site from b
""")
def route_by_domain(spark, sf):
    sites = spark.createDataFrame(_SITES, "domain string, fragment string, site string, ord int")
    pages = table(spark, sf, "pages").select("page_id", F.concat(F.lit("http://"), urls.site_key(F.col("url")), F.regexp_extract("url", "^[a-z]+://[^/?#]*(.*)$", 1)).alias("url"))
    return lookups.routed(pages, sites).select("page_id", "site")


@query(f"select page_id, {_STRIPPED_HTML} as plain from pages")
def strip_html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.strip_html(F.col("html")).alias("plain"))


@query("select page_id, " + _ENTITIES.replace("regexp_replace({0}, '<[^>]+>', '', 'g')", "html") + " as decoded from pages")
def entities_decode_basic(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.basic_entities(F.col("html")).alias("decoded"))


@query("select doc_id, substring(regexp_replace(text, '[ \\t\\n\\r\\f\\v]{2,}', ' ', 'g'), 1, 200) as short from documents")
def ws_squeeze_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.truncated(F.col("text"), 200).alias("short"))


@query("""select page_id, regexp_replace(html, '(?i)(?:<br\\s*/?>\\s*){2,}', '<div class="center"><hr/></div>', 'g') as ruled from pages""")
def xbr_to_hr(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.breaks_to_rule(F.col("html"), 2).alias("ruled"))


@query("select page_id, regexp_replace(html, '(?i)</?(?:html|head|body)\\b[^>]*>', '', 'g') as inner_html from pages")
def strip_wrapper_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.without_wrappers(F.col("html")).alias("inner_html"))


@query("select page_id, regexp_replace(replace(html, '<br>', '<p> </p>'), '(?i)<p\\b[^>]*>\\s*</p>', '', 'g') as kept from pages")
def remove_empty_p(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.without_empty_paragraphs(F.replace("html", F.lit("<br>"), F.lit("<p> </p>"))).alias("kept"))


@query()
def html_clean_full(spark, sf):
    body = html.cleaned()(html.without_wrappers(F.col("html")))
    return table(spark, sf, "pages").select("page_id", html.without_empty_paragraphs(html.breaks_to_rule(body)).alias("clean"))


@query()
def br_to_p_heuristic(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.breaks_to_paragraphs(F.concat_ws("<br/><br/>", F.split(text.strip_html(F.col("html")), "\n"))).alias("paragraphs"))


@query()
def attr_whitelist(spark, sf):
    how = html.Cleaning(attributes=("href",), removed=(), renamed=())
    return table(spark, sf, "pages").select("page_id", html.cleaned(how)(F.col("html")).alias("kept"))


@query()
def remove_tags(spark, sf):
    how = html.Cleaning(removed=("script", "style", "nav", "footer"))
    return table(spark, sf, "pages").select("page_id", html.cleaned(how)(F.col("html")).alias("kept"))


@query()
def html_elements(spark, sf):
    found = table(spark, sf, "pages").select("page_id", F.explode(html.elements(F.col("html"))).alias("e"))
    return found.groupBy("page_id", F.col("e.tag").alias("tag")).agg(F.count("*").alias("n"), F.sum(F.length("e.text")).alias("chars"))


@query()
def absolute_links(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", F.explode(urls.from_html(F.col("html"))).alias("link"))
    return pages.select("page_id", "link", urls.absolute(F.col("url"), F.col("link")).alias("target"))


@query()
def zalgo_reduce(spark, sf):
    marked = F.regexp_replace("text", "([aeiou])", "$1́̂̃")
    return table(spark, sf, "documents").select("doc_id", text.reduce_marks(1)(marked).alias("reduced"))


@query()
def entities_decode_full(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.all_entities(F.col("html")).alias("decoded"))


@query("select doc_id, len(regexp_extract_all(replace(text, '.', '. '), '[\\p{L}\\p{N}\\p{M}_]+'))::bigint as words from documents")
def word_count_doc(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@query(f"select page_id, len(regexp_extract_all(replace({_STRIPPED_HTML}, '.', '. '), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'))::bigint as words from pages")
def word_count_page(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.word_count(text.strip_html(F.col("html"))).alias("words"))


_LISTING = f"""
  select row_number() over (order by normal_url, page_id) as ord, page_id, normal_url, words,
    case when words >= 200 then 'length:long' else 'length:short' end || ', ' || 'site:' || regexp_extract(lower(regexp_extract(normal_url, '^[a-z]+://([^/?#]*)', 1)), '([^.]+)$', 1) as tags
  from (select n.page_id, n.normal_url, w.words from ({_NORMAL}) n join (select page_id, len(regexp_extract_all(replace({_STRIPPED_HTML}, '.', '. '), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'))::bigint as words from pages) w using (page_id))
"""


@query(_LISTING.replace("row_number() over (order by normal_url, page_id) as ord, ", ""))
def pages_listing(spark, sf):
    """Pages cleaned, normalised, counted and tagged by a rule program."""
    words = text.word_count(text.strip_html(F.col("html")))
    pages = table(spark, sf, "pages").select("page_id", urls.normalized(F.col("url")).alias("normal_url"), words.alias("words"))
    raw = F.array(F.when(F.col("words") >= 200, "len=long").otherwise("len=short"), F.concat(F.lit("tld="), F.regexp_extract(urls.domain(F.col("normal_url")), r"([^.]+)$", 1)), F.lit(""))
    program = language.parse(replace="tags=>^len=(\\w+)$=>length:\\1\ntags=>^tld=(\\w+)$=>site:\\1", exclude_post="tags==none")
    shown = engine.present(pages.withColumn("tags", raw), program, ["tags"])
    return shown.select("page_id", "normal_url", "words", F.array_join("tags", ", ").alias("tags"))


@query("""select page_id, url || '?' || 'a=' || (page_id % 10) || '&b=' || (page_id % 7) || '&c=x' as cache_key from pages""")
def cache_key_sorted_params(spark, sf):
    from storyflow.functions import arrays

    values = F.create_map(F.lit("c"), F.lit("x"), F.lit("a"), (F.col("page_id") % 10).cast("string"), F.lit("b"), (F.col("page_id") % 7).cast("string"))
    return table(spark, sf, "pages").select("page_id", arrays.sorted_parameters(F.col("url"), values).alias("cache_key"))


@query("""
  select page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(printf('%x', (('0x' || substr(h, 17, 2))::int & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) as uuid
  from (select page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) as h from pages)
""")
def uuid5_images(spark, sf):
    from storyflow.functions import binary

    return table(spark, sf, "pages").select("page_id", binary.uuid5(F.col("url")).alias("uuid"))


@query("""
  select page_id, n, skipped from (select page_id, normal_url, row_number() over (partition by story order by page_id) as n, row_number() over (partition by story order by page_id) > 1 as skipped
    from (select *, regexp_extract(normal_url, '^[a-z]+://([^/?#]*)', 1) as story from (""" + _NORMAL + ")))")
def batch_dup_skip(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", urls.normalized(F.col("url")).alias("normal_url")).withColumn("story", F.regexp_extract("normal_url", "^[a-z]+://([^/?#]*)", 1))
    out = keys.numbered(keys.repeats(pages, ["story"], F.col("page_id")), ["story"], F.col("page_id"), name="n")
    return out.select("page_id", "n", "skipped")
