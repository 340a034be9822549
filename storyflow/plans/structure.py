"""Queries over the block structure of markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyflow.functions import blocks, encodings, html, text
from storyflow.plans.registry import query
from storyflow.shared import table

_SPACES = "[\\s\\p{Z}\\x0B\\x1C-\\x1F\\x85]"
_PLAIN = "regexp_replace(regexp_replace(regexp_replace({0}, '(?i)<!doctype[^>]*>', '', 'g'), '<!--.*?-->', '', 'gs'), '<[^>]+>', '', 'g')"


def _tags_left(name: str):
    """Starts without an end, outside of scripts."""
    markup = F.regexp_replace("balanced", "(?s)<script.*?</script>", "")
    return (F.regexp_count(markup, F.lit(f"<{name}[ >]")) - F.regexp_count(markup, F.lit(f"</{name}>"))).cast("bigint")


@query(f"""select page_id, {_PLAIN.format("html")} as plain, cast(0 as bigint) as bold_left, cast(0 as bigint) as paragraphs_left,
  cast(len(regexp_extract_all(html, '<p[ >]')) as bigint) as paragraphs from pages""")
def markup_balanced(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", blocks.balanced(F.col("html")).alias("balanced"))
    return pages.select("page_id", text.drop_tags(F.col("balanced")).alias("plain"), _tags_left("b").alias("bold_left"), _tags_left("p").alias("paragraphs_left"), F.regexp_count("balanced", F.lit("<p[ >]")).cast("bigint").alias("paragraphs"))


@query(f"""
  with lines as (select doc_id, unnest(range(1, len(x) + 1)) as place, unnest(x) as line
    from (select doc_id, list_filter(list_transform(string_split(replace(text, chr(160), ' '), '. '), lambda l: regexp_replace(regexp_replace(l, '^{_SPACES}+', ''), '{_SPACES}+$', '')), lambda l: l <> '') as x from documents where text is not null))
  select doc_id, place, replace(replace(replace(line, '&', '&amp;'), '>', '&gt;'), '<', '&lt;') as paragraph from lines
""")
def bare_lines_paragraphed(spark, sf):
    lines = F.replace(text.escape_xml(F.col("text")), F.lit(". "), F.lit("<br>\n<br/>"))
    made = table(spark, sf, "documents").select("doc_id", blocks.paragraphed(F.concat(F.lit("<div class='x'>"), lines, F.lit("</div>"))).alias("made"))
    found = made.select("doc_id", F.posexplode(F.regexp_extract_all("made", F.lit(r"(?s)<p>(.*?)</p>\n"), F.lit(1))).alias("place", "paragraph"))
    return found.select("doc_id", (F.col("place") + 1).cast("bigint").alias("place"), "paragraph")


@query("""select page_id, '<p>see <span class="decoded_email">u' || page_id || '@' || split_part(split_part(url, '://', 2), '/', 1) || '</span>, <span title="m" class="decoded_email">u' || page_id || '@' || split_part(split_part(url, '://', 2), '/', 1) || '</span></p>' as shown from pages""")
def emails_in_markup(spark, sf):
    key = F.pmod("page_id", F.lit(256)).cast("int")
    address = F.concat(F.lit("u"), "page_id", F.lit("@"), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)))
    byte = lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")
    # Addresses here are ASCII, so a character is a byte.
    hidden = F.concat(byte(key), F.array_join(F.transform(F.sequence(F.lit(1), F.length(address)), lambda i: byte(F.ascii(F.substring(address, i, F.lit(1))).bitwiseXOR(key))), ""))
    link = F.concat(F.lit('<p>see <a href="/cdn-cgi/l/email-protection" class="__cf_email__" data-cfemail="'), hidden, F.lit('">[email&#160;protected]</a>, <a title="m" href="/cdn-cgi/l/email-protection#ab"><span class="__cf_email__" data-cfemail="'), hidden, F.lit('">x</span></a></p>'))
    shown = blocks.emails_shown(link)
    return table(spark, sf, "pages").select("page_id", F.regexp_replace(shown, ' data-cfemail="[0-9a-f]*"', "").alias("shown"))


@query("""select doc_id, '<div class="' || source || '"><p>' || lang || '</p><b id="x">' || n_chars || '</b></div>' as kept from documents where source is not null and lang is not null
  union all select doc_id, null from documents where source is null or lang is null""")
def class_removed(spark, sf):
    markup = F.concat(F.lit('<div class="chapter '), "source", F.lit('"><p class="chapter">'), "lang", F.lit('</p><b id="x" class="chapter">'), "n_chars", F.lit("</b></div>"))
    return table(spark, sf, "documents").select("doc_id", blocks.without_class("chapter")(markup).alias("kept"))


@query("""select page_id, 'a{b:url("images/' || page_id || '.jpg")} /* ' || url || ' */ c{src:url(' || page_id || '.woff2)} d{e:url(images/' || page_id || '.jpg)} f{g:url(''logo.png'')}' as css from pages""")
def css_targets_replaced(spark, sf):
    css = F.concat(F.lit('a{b:url("'), "url", F.lit('")} /* '), "url", F.lit(" */ c{src:url("), "page_id", F.lit(".woff2)} d{e:url("), "url", F.lit(")} f{g:url('logo.png')}"))
    font = F.concat("page_id", F.lit(".woff2"))
    targets = F.create_map(F.col("url"), F.concat(F.lit("images/"), "page_id", F.lit(".jpg")), font, F.lit("font"), F.lit("logo.png"), F.lit("logo"))
    return table(spark, sf, "pages").select("page_id", html.css_relinked(css, targets, F.array(F.lit("logo.png"))).alias("css"))


@query("""select page_id, replace(url, '&', '&amp;') as source from pages""")
def noscript_images(spark, sf):
    page = F.concat(F.lit("<p><i>a<noscript class=x><img src='"), "url", F.lit("'></noscript>"), "html")
    kept = F.regexp_extract(blocks.balanced(page), '<noscript class="x"><img src="([^"]*)" /></noscript>', 1)
    return table(spark, sf, "pages").select("page_id", kept.alias("source"))


@query("select doc_id, text from documents")
def encodings_told_apart(spark, sf):
    data = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf, "documents").select("doc_id", encodings.decoded(data, ("utf-8", "auto")).alias("text"))
