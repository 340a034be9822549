"""Queries of forum and site steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyflow.operators import covers, positions, sites
from storyflow.plans.registry import query
from storyflow.shared import table


@query("""select o_custkey as story, arg_min(value, pos) filter (where label = '1-URGENT') as urgent, arg_min(value, pos) filter (where label = '5-LOW') as low,
  coalesce(arg_min(value, pos) filter (where label = '2-HIGH'), '-') as extra_high
  from (select o_custkey, o_orderpriority as label, o_orderkey as pos, o_orderstatus || o_orderkey as value from orders) group by o_custkey""")
def labels_pivoted(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("story"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("pos"), F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("value"))
    out = sites.pivoted(rows, "story", {"1-URGENT": "urgent", "5-LOW": "low"})
    return out.select("story", "urgent", "low", F.coalesce(F.try_element_at("extra", F.lit("2-high")), F.lit("-")).alias("extra_high"))


@query("""select c.conv_id as story, c.turn as pos, 'post ' || c.turn as html from conversations c where exists (select 1 from conversations p where p.conv_id = c.conv_id and p.turn = c.turn)""")
def reader_page_search(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn")
    url = F.concat(F.col("conv_id").cast("string"), F.lit("#"), F.col("turn").cast("string"))
    marks = rows.select(url.alias("url"), F.col("conv_id").alias("category"), F.col("turn").alias("index"))
    page = F.floor((F.col("turn") + 3) / 3).cast("int") + (F.col("conv_id") % 2).cast("int")
    posts = rows.select(url.alias("url"), F.col("conv_id").alias("category"), page.alias("page"), F.concat(F.lit("post "), F.col("turn").cast("string")).alias("html"))
    return sites.reader_pages(marks, posts, 3).select(F.col("category").alias("story"), F.col("index").alias("pos"), "html")


@query("select conv_id as story, turn as pos from conversations where conv_id in (select conv_id from conversations group by conv_id having count(*) >= 4)")
def minimum_marks(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("story"), F.col("turn").alias("pos"))
    return sites.enough_marks(rows, "story", 4)


@query("""select conv_id as thread, arg_min(role, case when turn <= 3 and turn % 2 = 1 then turn else 1000 + turn end) as first_role from conversations group by conv_id""")
def first_unpinned_post(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("place"), (F.col("turn") % 2 == 0).alias("sticky"), F.col("role").alias("html"))
    return sites.first_posts(rows, "thread", "place").select("thread", F.col("html").alias("first_role"))


@query("""with s as (select conv_id, turn, turn % 3 as level, role || turn as title from conversations),
  l as (select *, max(case when level = 1 then turn end) over w as p1, max(case when level = 2 then turn end) over w as p2 from s window w as (partition by conv_id order by turn rows unbounded preceding))
  select l.conv_id as story, l.turn as pos, coalesce(a.title, '') || case when a.title is not null and b.title is not null and p2 > p1 then ' / ' else '' end || case when b.title is not null and (p1 is null or p2 > p1) then b.title else '' end as path
  from l left join s a on a.conv_id = l.conv_id and a.turn = p1 left join s b on b.conv_id = l.conv_id and b.turn = p2""")
def section_paths(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("story"), F.col("turn").alias("pos"), (F.col("turn") % 3).alias("level"), F.concat("role", F.col("turn").cast("string")).alias("title"))
    return positions.sections(rows, "story", "pos", "level", "title", 2).select("story", "pos", "path")


@query("""select page_id % 50 as story, arg_min(url, (case when page_id % 3 = 0 then 0 else 1 end, page_id)) as cover from pages where page_id % 3 <> 2 and length(url) >= 30 group by 1""")
def cover_choice(spark, sf):
    kind = F.when(F.col("page_id") % 3 == 0, "specific").when(F.col("page_id") % 3 == 1, "first").otherwise("none")
    images = table(spark, sf, "pages").select((F.col("page_id") % 50).alias("story"), F.col("page_id").alias("seq"), "url", kind.alias("kind"), F.length("url").alias("width"), F.lit(10).alias("height"))
    return covers.covers(covers.candidates(images, (30, 1), r"^ftp:"), "story")


@query("""select user_id, 'api/' || epoch_ms(ts) || '/' || (epoch_ms(until) - 1) as address from (select user_id, make_timestamp(epoch_us(ts) // 1000 * 1000) as ts, make_timestamp(epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) // 1000 * 1000) as until from events) where until is not null""")
def chapter_addresses(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("start"), "event_id", F.col("ts"))
    bounds = positions.pairs(rows, "user_id", F.col("ts"), F.col("event_id"), value="start")
    return sites.chapter_addresses(bounds, "api/").select("user_id", "address")
