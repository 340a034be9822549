"""Queries of functions and operators that the other modules of this folder don't use."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyflow.functions import arrays, binary, dates, text, urls
from storyflow.operators import library, listing, lookups, sites
from storyflow.plans.registry import query
from storyflow.shared import table


@query("select p_partkey, regexp_extract_all(regexp_replace(p_name || '\\,x , ' || p_brand || ',, ' || p_type, '\\\\,', chr(1), 'g'), '[^,]+').list_transform(lambda x: trim(replace(x, chr(1), ','))).list_filter(lambda x: x <> '') as parts from part")
def comma_list_escaped(spark, sf):
    joined = F.concat("p_name", F.lit("\\,x , "), "p_brand", F.lit(",, "), "p_type")
    return table(spark, sf, "part").select("p_partkey", text.split_list(joined).alias("parts"))


@query("select p_partkey, replace(replace(replace(p_name || ' <&> ' || p_brand, '&', '&amp;'), '>', '&gt;'), '<', '&lt;') as escaped, upper(p_brand[1:1]) || p_brand[2:] || ': ' || p_name || ' $' as filled from part")
def escape_and_template(spark, sf):
    p = table(spark, sf, "part")
    values = {"brand": F.col("p_brand"), "name": F.col("p_name")}
    return p.select("p_partkey", text.escape_xml(F.concat("p_name", F.lit(" <&> "), "p_brand")).alias("escaped"), text.template("${brand}: ${name} $$", values).alias("filled"))


@query("select doc_id, try_cast(regexp_replace(text, '[^0-9]', '', 'g') as bigint) as number from documents")
def digits_only_number(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.digits(F.col("text")).alias("number"))


@query("select conv_id, turn, replace(replace(text, chr(13), ''), chr(10), chr(13) || chr(10)) as dos, regexp_replace(regexp_replace(text, '\\n\\s*\\n', '<p>', 'g'), '(?i)(?:\\s*<(?:p|br)\\s*/?>\\s*){2,}', '<p>', 'g') as squeezed from conversations")
def line_ends_and_blank_lines(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.line_ends(F.col("text"), dos=True).alias("dos"), text.excess_space(F.col("text")).alias("squeezed"))


@query("select page_id, regexp_replace(url || '?user_name=ann&password=x1&page=2', '(?i)((?:pass(?:word)?|name|login)[^=&?]?=)[^&]*', '\\1XXXXXXXX', 'g') as masked from pages")
def url_secrets_masked(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.mask_url_secrets(F.concat("url", F.lit("?user_name=ann&password=x1&page=2"))).alias("masked"))


@query("select p_partkey, translate(lower(replace(p_name || ', (' || p_type || ')', ' ', '-')), '\"''.,!?:;()[]{}/\\', '') as id from part")
def tag_ids(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.id_of(F.concat("p_name", F.lit(", ("), "p_type", F.lit(")"))).alias("id"))


@query("""select conv_id, turn, case when turn % 3 = 0 then 'Chapter ' || turn || ' On' when turn % 3 = 1 then 'Part ' || turn else 'Story ' || conv_id end as title from conversations""")
def chapter_titles_cleaned(spark, sf):
    c = table(spark, sf, "conversations")
    story, turn = F.concat(F.lit("Story "), F.col("conv_id").cast("string")), F.col("turn").cast("string")
    said = F.when(F.col("turn") % 3 == 0, F.concat(story, F.lit(" - ch. 0"), turn, F.lit(" On"))).when(F.col("turn") % 3 == 1, F.concat(F.lower(story), F.lit(": pt"), turn)).otherwise(story)
    return c.select("conv_id", "turn", text.chapter_title(said, story).alias("title"))


@query("""select o_orderkey, case when o_orderkey % 4 = 3 then null else date_trunc('day', o_orderdate) end as at from orders""")
def dates_by_formats(spark, sf):
    day = F.col("o_orderdate")
    forms = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format(day, "MM/dd/yyyy")).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit(" "), F.date_format(day, "d MMMM yyyy"))).otherwise("soon")
    return table(spark, sf, "orders").select("o_orderkey", dates.parsed(forms, "%Y-%m-%d", "%m/%d/%Y", "%d %B %Y").cast("timestamp_ntz").alias("at"))


@query("select event_id, case when event_id % 3 = 0 then ts when event_id % 3 = 1 then date_trunc('second', ts) else date_trunc('day', ts) end as at from events")
def dates_iso_loaded(spark, sf):
    ts = F.col("ts")
    said = F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")).when(F.col("event_id") % 3 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd"))
    return table(spark, sf, "events").select("event_id", dates.iso_loaded(said).cast("timestamp_ntz").alias("at"))


@query("select doc_id, case doc_id % 4 when 0 then 'image/jpeg' when 1 then 'image/png' when 2 then 'image/gif' end as sniffed, case doc_id % 4 when 0 then 'image/jpeg' when 1 then 'image/png' when 2 then 'image/gif' end as named from documents")
def image_types(spark, sf):
    kind = F.col("doc_id") % 4
    head = F.when(kind == 0, F.unhex(F.lit("FFD8FFE0"))).when(kind == 1, F.unhex(F.lit("89504E470D0A1A0A00"))).when(kind == 2, F.unhex(F.lit("474946383961"))).otherwise(F.unhex(F.lit("00")))
    name = F.concat(F.col("doc_id").cast("string"), F.when(kind == 0, ".JPG?x=1").when(kind == 1, ".png").when(kind == 2, ".gif#a").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", binary.sniffed_type(head).alias("sniffed"), binary.media_type(name).alias("named"))


@query("select c_custkey, case when c_custkey % 5 < 3 then map_from_entries([('a', c_name), ('b', c_mktsegment)]) end as pairs, ([c_name, c_mktsegment, 'S2'])[:case when c_custkey % 2 = 0 then 3 else 1 end] as numbered from customer")
def pairs_and_numbered_keys(spark, sf):
    flat = F.array(F.lit("a"), "c_name", F.lit("b"), "c_mktsegment")
    many = F.create_map(F.lit("series00"), "c_name", F.when(F.col("c_custkey") % 2 == 0, "series01").otherwise("series05"), F.col("c_mktsegment"), F.lit("series02"), F.lit("S2"))
    return table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 < 3, arrays.key_values(flat)).alias("pairs"), arrays.numbered_keys(many, "series").alias("numbered"))


@query("select o_orderkey, case when o_orderkey % 9 = o_orderkey % 7 then 'Completed' else 'In-Progress' end as status, case o_orderstatus when 'F' then 'Completed' when 'O' then 'In-Progress' else 'Other' end as named from orders")
def status_by_counts_and_names(spark, sf):
    said = F.concat((F.col("o_orderkey") % 9).cast("string"), F.lit("/"), (F.col("o_orderkey") % 7).cast("string"))
    named = arrays.first_match(F.col("o_orderstatus"), [("^F$", "Completed"), ("^O$", "In-Progress"), (".", "Other")])
    return table(spark, sf, "orders").select("o_orderkey", arrays.fraction_status(said).alias("status"), named.alias("named"))


@query("select l_orderkey, l_linenumber, [x for x in [case when l_tax > 0.05 then 'Taxed' end, case when l_discount > 0.05 then 'Cheap' end, case when l_quantity > 40 then 'Many' end] if x is not null] as warnings, case when l_quantity > 40 then 'Many' when l_discount > 0.05 then 'Cheap' end as rating from lineitem")
def warnings_and_rating(spark, sf):
    names, last = arrays.escalated({"Taxed": F.col("l_tax") > 0.05, "Cheap": F.col("l_discount") > 0.05, "Many": F.col("l_quantity") > 40}, ["Cheap", "Many"])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", names.alias("warnings"), last.alias("rating"))


@query("select doc_id, list_distinct([lang, source, 'extra']).list_sort() as tags, case when lang = 'en' then ['en', 'flag'] else ['en'] end as flagged from documents where lang is not null and source is not null")
def tags_appended_and_flagged(spark, sf):
    d = table(spark, sf, "documents").where("lang is not null and source is not null")
    several = F.when(F.col("lang") == "en", F.array("lang", "source")).otherwise(F.array("lang"))
    return d.select("doc_id", arrays.finished(arrays.appended(F.array("lang", "source"), ["extra"])).alias("tags"), arrays.flagged(F.array(F.lit("en")), several, "flag").alias("flagged"))


@query("select page_id, 'https' || substring(url, position('://' in url)) || '/a%20b' as conditioned, [left(url, length(url) - k) for k in [0, 1, 2]] as shorter from pages where url like 'http%://%'")
def urls_conditioned_and_shortened(spark, sf):
    p = table(spark, sf, "pages").where("url like 'http%://%'")
    return p.select("page_id", urls.conditioned(F.concat("url", F.lit("/a b"))).alias("conditioned"), urls.shortened(F.col("url"), 2).alias("shorter"))


@query("select doc_id, 'https://x.org/s/' || doc_id || '/1' as canonical, '//x.org/story/' || doc_id as key, 'http://x.org/b/c?id=' || doc_id as cleaned, 'a/c' as folded, 'a/b/' as part from documents")
def urls_canonical(spark, sf):
    said = F.concat(F.lit("http://www.x.org/story/"), F.col("doc_id").cast("string"))
    rules = [("y.org", r"^.*$", "no"), ("x.org", r"^https?://www\.x\.org/story/(\d+)$", r"https://x.org/s/$1/1")]
    link = F.concat(F.lit("http://x.org/a/../b/c?id="), F.col("doc_id").cast("string"), F.lit("&amp;utm_source=m"))
    return table(spark, sf, "documents").select("doc_id", urls.canonical(said, rules).alias("canonical"), urls.without_scheme(F.concat(F.lit("http://x.org/story/"), F.col("doc_id").cast("string"))).alias("key"), urls.cleaned_link(link).alias("cleaned"), urls.folded_path(F.lit("a/b/../c")).alias("folded"), urls.path_part(F.lit("a/b/c")).alias("part"))


@query("select c_custkey, case when c_custkey % 3 = 0 then 'gone' when c_custkey % 2 = 0 then null else null end as error, case when c_custkey % 2 = 0 then c_name else c_mktsegment end as shelf from customer")
def library_error_and_new_columns(spark, sf):
    old = F.when(F.col("c_custkey") % 2 == 0, "late")
    return table(spark, sf, "customer").select("c_custkey", library.error_column(old, F.col("c_custkey") % 3 == 0, F.lit("gone")).alias("error"), library.new_only(F.col("c_custkey") % 2 == 0, F.col("c_name"), F.col("c_mktsegment")).alias("shelf"))


@query("select c_custkey as book_id, case when c_custkey % 4 = 0 then 'changed' else c_name end as title from customer where c_custkey % 7 <> 0 union all select c_custkey, 'changed' from customer where c_custkey % 28 = 0")
def library_upsert(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("book_id"), F.col("c_name").alias("title"))
    return library.upserted(c.where("book_id % 7 <> 0"), c.where("book_id % 4 = 0").withColumn("title", F.lit("changed")))


@query("select c_custkey as book_id from customer where (c_custkey % 2 = 0 or c_custkey % 3 = 0) and c_custkey % 5 <> 0")
def reading_list_changes(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("book_id"))
    return library.reading_list(c.where("book_id % 2 = 0"), c.where("book_id % 3 = 0"), c.where("book_id % 5 = 0"))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then 'add' when o_orderkey % 3 = 1 then 'update' else 'skip' end as updating, case when o_orderkey % 3 = 0 then 'skip' else 'metadata' end as showing from orders""")
def collision_modes(spark, sf):
    exists, newer = F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 3 == 1
    return table(spark, sf, "orders").select("o_orderkey", listing.collision("update", exists, newer).alias("updating"), listing.collision("metadata_only", exists, newer).alias("showing"))


@query("""select conv_id as story, turn + 1 as number, case when conv_id % 2 = 0 then text end as old_html, conv_id % 4 <> 1 and conv_id % 2 = 1 and conv_id % 3 = 0 as is_new
  from (select distinct on (conv_id, turn) * from conversations where conv_id % 2 = 1) union all select conv_id, turn + 1, min(text), false from conversations where conv_id % 2 = 0 group by conv_id, turn""")
def chapters_by_place(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("story"), (F.col("turn") + 1).alias("number"), F.col("text").alias("html"))
    other = rows.where("story % 2 = 1 and story % 4 <> 1 and story % 3 = 0").select("story", F.lit(-1).cast("bigint").alias("number"), F.lit("x").alias("html")).distinct()
    return listing.merged_by_place(rows.select("story", "number").distinct(), rows.where("story % 2 = 0").unionByName(other))


@query("select c_custkey, case when c_custkey % 3 = 0 then 'r0' when c_custkey % 3 = 1 then 'r1' end as route from customer")
def choice_routes(spark, sf):
    routes = F.create_map(F.lit("0"), F.lit("r0"), F.lit("1"), F.lit("r1"))
    return table(spark, sf, "customer").select("c_custkey", sites.route(F.col("c_custkey") % 3, routes).alias("route"))


@query("""select conv_id, turn, case when turn % 3 = 0 then text when turn % 3 = 1 then '<ul><li>a</li><li>b</li></ul>' else '<blockquote>' || text || '</blockquote>' end as html from conversations where turn % 5 <> 4""")
def parts_by_kind(spark, sf):
    kind = F.element_at(F.array(F.lit("chapter"), F.lit("choice"), F.lit("post")), (F.col("turn") % 3 + 1).cast("int"))
    title = F.when(F.col("turn") % 5 == 4, "#special x").otherwise("t")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", kind.alias("nt"), title.alias("title"), F.coalesce("text", F.lit("")).alias("body"), F.array(F.lit("a"), F.lit("b")).alias("choices"))
    return sites.rendered_parts(rows).select("conv_id", "turn", "html")


@query("select c_custkey, c_nationkey + 20 as id, coalesce(n_name, 'unknown achievement') as title from customer left join nation on n_nationkey = c_nationkey + 20")
def achievement_names(spark, sf):
    ids = table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") + 20).alias("id"))
    return sites.achievements(ids, table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title")), "c_custkey")


@query("select a.n_nationkey as key, b.n_name as target from nation a left join nation b on b.n_nationkey = a.n_nationkey + 3")
def references_followed(spark, sf):
    objects = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), (F.col("n_nationkey") + 3).alias("ref"), F.col("n_name").alias("body"))
    return lookups.dereferenced(objects, "ref").select("key", "target")


@query("select doc_id, regexp_extract_all(text, '\\[(.*?)\\]', 1) as bracketed from documents")
def bracketed_parts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.bracketed(F.col("text")).alias("bracketed"))


@query("select n.n_nationkey, count(c_custkey) as stories, coalesce(sum(c_custkey % 3), 0)::bigint as new_chapters from nation n left join customer on c_nationkey = n_nationkey group by n_nationkey")
def counts_per_site(spark, sf):
    stories = table(spark, sf, "customer").select(F.col("c_nationkey").alias("site"), (F.col("c_custkey") % 3).alias("new"))
    counted = library.site_counts(stories, "site", "new")
    return table(spark, sf, "nation").join(counted, F.col("n_nationkey") == F.col("site"), "left").select("n_nationkey", F.coalesce("stories", F.lit(0)).alias("stories"), F.coalesce("new_chapters", F.lit(0)).alias("new_chapters"))


@query("select o_orderkey, o_orderstatus <> 'P' and o_totalprice > 0 as good, case when o_orderstatus = 'P' then 'no title' when o_totalprice <= 0 then 'no chapters' end as why from orders")
def metadata_gate(spark, sf):
    good, why = library.valid_metadata(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.when(F.col("o_totalprice") > 0, 1).otherwise(0))
    return table(spark, sf, "orders").select("o_orderkey", good.alias("good"), why.alias("why"))


@query("select c_custkey as book_id, row_number() over (order by c_custkey desc) - 1 as listorder from customer")
def reading_order(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("book_id"), (-F.col("c_custkey")).alias("rank"))
    return library.list_order(c, "rank").select("book_id", "listorder")


@query("select p_partkey, case when p_partkey % 4 = 0 then '' when p_partkey % 4 = 1 then 'Unknown' else p_brand end as brand from part")
def entry_defaults(spark, sf):
    said = F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, None).otherwise(F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", arrays.default_value(said, "Unknown").alias("brand"))


@query("select story, list_reverse(list(turn order by turn)) as backwards, ['#start'] || list(turn::varchar order by turn) || ['#end'] as framed from (select conv_id as story, turn from conversations) group by story")
def lists_reversed_and_framed(spark, sf):
    turns = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("story")).agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return turns.select("story", F.reverse("turns").alias("backwards"), arrays.framed(F.col("turns").cast("array<string>"), "#start", "#end").alias("framed"))

