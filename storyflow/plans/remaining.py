"""Queries of site rules, dates of several forms, series, marks and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyflow.functions import binary, dates
from storyflow.operators import library, positions, siterules
from storyflow.operators.siterules import SiteRule
from storyflow.plans.registry import query
from storyflow.shared import table

RULES = [
    SiteRule("example.com", r"https?://(?:[a-z0-9-]+\.)*example\.com/([a-z]{2})/(\d+)/?", "https://example.com/$1/$2", "https://example.com/$1"),
    SiteRule("example.com", r"https?://(?:[a-z0-9-]+\.)*example\.com/", "https://example.com/"),
    SiteRule("www.example.net", r"https?://(?:[a-z0-9-]+\.)*example\.net/(?:[a-z]{2})/(\d+)/?$", "https://example.net/s/$1"),
    *[SiteRule(f"site{i}.org", rf"https?://site{i}\.org/(\d+)", f"https://site{i}.org/$1") for i in range(100)],
]

_SITE = "regexp_extract(lower(regexp_extract(url, '^[a-z]+://(?:[^/@]*@)?([^/:?#]*)', 1)), '(?:^|\\.)(example\\.com|example\\.net)$', 1)"


@query(f"""
  with s as (select page_id, url, nullif({_SITE}, '') as site, regexp_replace(lower(regexp_extract(url, '^[a-z]+://(?:[^/@]*@)?([^/:?#]*)', 1)), '^www\\.', '') as host from pages),
  m as (select *, case when site = 'example.com' and regexp_matches(url, '^https?://([a-z0-9-]+\\.)*example\\.com/[a-z]{{2}}/\\d+') then 1
    when site = 'example.com' and regexp_matches(url, '^https?://([a-z0-9-]+\\.)*example\\.com/') then 2
    when site = 'example.net' and regexp_matches(url, '^https?://([a-z0-9-]+\\.)*example\\.net/[a-z]{{2}}/\\d+/?$') then 3 end as rule from s),
  c as (select *, case rule when 1 then 'https://example.com/' || regexp_extract(url, 'example\\.com/([a-z]{{2}})/', 1) when 2 then 'https://example.com/' when 3 then 'https://example.net/s/' || regexp_extract(url, '/[a-z]{{2}}/(\\d+)/?$', 1) end as section_url from m)
  select page_id, site, rule is not null as valid, case rule when 1 then section_url || '/' || regexp_extract(url, 'example\\.com/[a-z]{{2}}/(\\d+)', 1) else section_url end as canonical, section_url, coalesce(section_url, site, nullif(host, '')) as section from c""")
def urls_by_site_rules(spark, sf):
    return siterules.matched(table(spark, sf, "pages").select("page_id", "url"), RULES).drop("url")


@query("""select page_id, 'k' as key, case when regexp_matches(url, '^https?://([a-z0-9-]+\\.)*example\\.com/[a-z]{2}/\\d+') then 'https://example.com/' || regexp_extract(url, 'example\\.com/([a-z]{2})/', 1)
    when regexp_matches(url, '^https?://([a-z0-9-]+\\.)*example\\.com/') then 'https://example.com/'
    when regexp_matches(url, '^https?://([a-z0-9-]+\\.)*example\\.net/[a-z]{2}/\\d+/?$') then 'https://example.net/s/' || regexp_extract(url, '/[a-z]{2}/(\\d+)/?$', 1) else url end as section from pages""")
def sections_renamed(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.lit("k").alias("key"), F.col("url").alias("section"))
    return siterules.renamed_sections(rows, RULES)


@query("""select event_id, date_trunc('minute', ts) as twelve, case when hour(ts) = 0 then date_trunc('minute', ts) + interval 12 hours when hour(ts) = 12 then date_trunc('minute', ts) + interval 12 hours else date_trunc('minute', ts) end as odd,
  date_trunc('minute', ts) as plain from events""")
def clock_halves(spark, sf):
    ts = F.col("ts").cast("timestamp")
    pm = F.when(F.hour(ts) >= 12, "pm").otherwise("am")
    shown = F.concat(F.date_format(ts, "yyyy-MM-dd hh:mm"), pm)
    return table(spark, sf, "events").select("event_id", dates.clock_parsed(shown, "%Y-%m-%d %I:%M%p").alias("twelve"), dates.clock_parsed(shown, "%Y-%m-%d %H:%M%p").alias("odd"), dates.clock_parsed(F.date_format(ts, "yyyy-MM-dd HH:mm"), "%Y-%m-%d %H:%M%p").alias("plain"))


@query("""select event_id, case when event_id % 3 = 0 then date_trunc('second', ts) else date_trunc('day', ts) end as at from events""")
def script_times(spark, sf):
    ts = F.col("ts").cast("timestamp")
    script = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("document.write(new Date("), F.unix_millis(ts).cast("string"), F.lit(").toLocaleString())"))).when(F.col("event_id") % 3 == 1, "no date")
    return table(spark, sf, "events").select("event_id", dates.script_time(script, F.date_format(ts, "MMM dd, yyyy"), "%Y", "%b %d, %Y").alias("at"))


@query("""
  with d as (select user_id, case when event_id % 4 = 0 then timestamp '2030-01-01' - to_hours(event_id % 900 + 1) when event_id % 4 = 3 then null else date_trunc('day', ts) end as seen,
    case event_id % 4 when 0 then 'relative' when 1 then '%b %d, %Y' when 2 then '%Y/%m/%d' end as form from events)
  select user_id, min(seen) as published, max(seen) as updated, cast(count(*) filter (where form = 'relative') as bigint) as relative, cast(count(*) filter (where form is null) as bigint) as unread from d group by user_id""")
def mixed_dates_span(spark, sf):
    ts, kind = F.col("ts").cast("timestamp"), F.col("event_id") % 4
    said = F.when(kind == 0, F.concat((F.col("event_id") % 900 + 1).cast("string"), F.lit(" hours ago"))).when(kind == 1, F.date_format(ts, "MMM dd, yyyy")).when(kind == 2, F.date_format(ts, "yyyy/MM/dd")).otherwise("some day")
    read = table(spark, sf, "events").select("user_id", dates.mixed(said, F.to_timestamp(F.lit("2030-01-01")), "%b %d, %Y", "%Y/%m/%d").alias("d"))
    return read.groupBy("user_id").agg(F.min("d.at").alias("published"), F.max("d.at").alias("updated"), F.count_if(F.col("d.form") == "relative").alias("relative"), F.count_if(F.col("d.form").isNull()).alias("unread"))


@query("""
  with l as (select l_suppkey as series, l_partkey as story, row_number() over (partition by l_suppkey order by l_orderkey % 5, l_orderkey, l_linenumber, l_partkey) as place from lineitem),
  f as (select story, min({'p': place, 's': series}) as f from l group by story)
  select p_partkey as story_id, f.s as series, cast(f.p as bigint) as series_index from part left join f on story = p_partkey""")
def series_positions(spark, sf):
    listed = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("shelf"), (F.col("l_orderkey") % 5).alias("page"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("place"), F.concat(F.lit("/s/"), "l_partkey", F.lit("/title")).alias("link"))
    stories = table(spark, sf, "part").select(F.col("p_partkey").alias("story_id"))
    return positions.series_places(listed, stories, "shelf", "page", "place", "link", r"^/s/(\d+)/")


@query("""
  with m as (select o_orderkey, o_orderstatus, row_number() over (order by o_orderkey) - 1 as a, row_number() over (partition by o_orderstatus order by o_orderkey) - 1 as b from orders)
  select o_orderkey, case o_orderstatus when 'P' then 'fff_chapter_error_' || lpad(cast(b as varchar), cast(greatest(4, length(cast(b as varchar))) as int), '0') when 'F' then 'fff_failed_' || lpad(cast(b as varchar), cast(greatest(4, length(cast(b as varchar))) as int), '0')
    else 'fff_success_' || lpad(cast(a as varchar), cast(greatest(4, length(cast(a as varchar))) as int), '0') end as mark from m""")
def result_marks(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("failed"), (F.col("o_orderstatus") == "P").alias("broken"))
    return library.result_marks(orders, "o_orderkey", "failed", "broken").select("o_orderkey", "mark")


@query("""select 0 as launched, s_suppkey as key, s_name as name, cast(s_acctbal as varchar) is null as odd from supplier union all select 1, c_custkey, c_name, null from customer union all select 2, n_nationkey, n_name, null from nation""")
def results_in_launch_order(spark, sf):
    parts = [table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").isNull().alias("odd"))]
    parts += [table(spark, sf, t).select(F.col(k).cast("bigint").alias("key"), F.col(n).alias("name")) for t, k, n in (("customer", "c_custkey", "c_name"), ("nation", "n_nationkey", "n_name"))]
    return library.in_launch_order(parts)


@query("""select conv_id, turn, role as book, case when text <> '' then '(was set, removed for security)' else text end as password, case when role <> '' then '(was set, removed for security)' else role end as username from conversations""")
def secrets_blanked(spark, sf):
    return library.blanked(table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("book"), F.col("text").alias("password"), F.col("role").alias("username")))


@query("select l_orderkey, l_linenumber, cast(l_partkey + l_suppkey as bigint) as events from lineitem")
def counters_summed(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", library.counters_summed(F.col("l_partkey"), F.col("l_suppkey")).alias("events"))


@query("""
  with o as (select conv_id, turn, role || ' ' || (conv_id % 3) as title from conversations),
  n as (select conv_id, turn, case when text like '%a%' then role || ' ' || (conv_id % 3) else role || ' 1' end as title from conversations)
  select n.conv_id || '/' || n.turn as url, o.title as old_title, n.title as new_title from n join o on o.conv_id = n.conv_id and o.turn = n.turn where n.title <> o.title""")
def titles_changed(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("url", F.concat("conv_id", F.lit("/"), "turn"))
    own = F.concat("role", F.lit(" "), F.col("conv_id") % 3)
    return library.title_changes(turns.select("url", F.when(F.col("text").like("%a%"), own).otherwise(F.concat("role", F.lit(" 1"))).alias("title")), turns.select("url", own.alias("origtitle")))


@query("""select page_id, (select string_agg(substr(h, cast(15 - 2 * i as bigint), 2), '' order by i) from range(8) t(i)) as simple, upper(h) as firefox from (select page_id, sha1(url) as h from pages)""")
def cache_file_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", binary.simple_cache_name(F.col("url")).alias("simple"), binary.firefox_cache_name(F.col("url")).alias("firefox"))
