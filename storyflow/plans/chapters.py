"""Queries over conversations as stories: a conversation is a story, a turn a chapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyflow.functions import text
from storyflow.operators import keys, library, listing
from storyflow.plans.registry import query
from storyflow.shared import table
from storyflow.sinks import render


def _chapters(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("story"), F.col("turn").alias("pos"), "role", "text")


_NUMBERED = "select conv_id as story, turn as pos, role, text, row_number() over (partition by conv_id order by turn) as number, count(*) over (partition by conv_id) as chapters from conversations"


@query(f"""select story, number, lpad(number::varchar, 4, '0') as index04,
  case when pos % 2 = 1 then '(new) ' else '' end || case when chapters > 1 then number || '. ' else '' end || role as title from ({_NUMBERED})""")
def chapter_numbering(spark, sf):
    numbered = listing.numbered_chapters(_chapters(spark, sf), "story", "pos")
    sizes = numbered.groupBy("story").agg(F.count("*").alias("chapters"))
    title = text.decorated(F.col("role"), F.col("number"), F.col("chapters"), F.col("pos") % 2 == 1)
    return numbered.join(sizes, "story").select("story", "number", "index04", title.alias("title"))


@query(f"select story, number, case when number between 2 and 4 then length(text) else 0 end::bigint as chars, greatest(least(chapters, 4) - 1, 0)::bigint as counted from ({_NUMBERED})")
def chapter_range(spark, sf):
    numbered = listing.numbered_chapters(_chapters(spark, sf), "story", "pos")
    sizes = numbered.groupBy("story").agg(F.count("*").alias("chapters"))
    ranged = listing.in_range(numbered.join(sizes, "story"), 2, 4, "text")
    return ranged.select("story", "number", F.length("text").cast("bigint").alias("chars"), listing.chapters_counted(F.col("chapters"), 2, 4).cast("bigint").alias("counted"))


@query("""select conv_id as story, turn as pos, case when turn % 3 = 0 then role || ' ' || turn when turn % 3 = 1 then turn || '.1' else '' end as stripped
  from conversations""")
def chapter_title_strip(spark, sf):
    pos = F.col("pos").cast("string")
    title = F.when(F.col("pos") % 3 == 0, F.concat(pos, F.lit(". "), "role", F.lit(" "), pos)).when(F.col("pos") % 3 == 1, F.concat(pos, F.lit(".1"))).otherwise(F.concat(pos, F.lit("-")))
    return _chapters(spark, sf).select("story", "pos", text.without_number(title).alias("stripped"))


@query("select story, url, pos from (select conv_id as story, role || (turn // 3) as url, turn as pos, row_number() over (partition by conv_id, role || (turn // 3) order by turn) as n from conversations) where n = 1")
def chapter_dedup(spark, sf):
    rows = _chapters(spark, sf).select("story", F.concat("role", F.floor(F.col("pos") / 3).cast("string")).alias("url"), "pos")
    return keys.first_by(rows, ["story", "url"], F.col("pos"))


@query("select doc_id, source from documents where not exists (select 1 from labels where labels.doc_id = documents.doc_id and toxic = 1)")
def ignore_list(spark, sf):
    ignored = table(spark, sf, "labels").where("toxic = 1")
    return keys.drop(table(spark, sf, "documents").select("doc_id", "source"), ignored, ["doc_id"])


_OLD = "select conv_id as story, turn as pos, conv_id || '/' || turn as url, text as html, role as origtitle, case when turn % 4 = 3 then '(new) ' || role else role end as title from conversations where (conv_id + turn) % 3 <> 0 and conv_id % 5 <> 2"


@query(f"""
  select c.conv_id as story, c.turn as pos, o.html is null as fetch, (o.html is null and c.conv_id in (select story from ({_OLD}))) or coalesce(o.origtitle <> o.title, false) as is_new, coalesce(length(o.html), 0)::bigint as reused_chars
  from conversations c left join ({_OLD}) o on o.url = c.conv_id || '/' || c.turn""")
def old_new_chapter_join(spark, sf):
    rows = _chapters(spark, sf)
    url = F.concat(F.col("story").cast("string"), F.lit("/"), F.col("pos").cast("string")).alias("url")
    old = rows.where((F.col("story") + F.col("pos")) % 3 != 0).where("story % 5 <> 2").select("story", url, "pos", F.col("text").alias("html"), F.col("role").alias("origtitle"), F.when(F.col("pos") % 4 == 3, F.concat(F.lit("(new) "), "role")).otherwise(F.col("role")).alias("title"))
    out = listing.merged(rows.select("story", "pos", url), old, story="story")
    return out.select("story", "pos", "fetch", "is_new", F.coalesce(F.length("old_html"), F.lit(0)).cast("bigint").alias("reused_chars"))


@query("""
  select n.story, old_count, new_count, case when old_count = new_count then 'skip' when old_count > new_count then 'warn' when old_count = 0 then 'refuse' else 'update' end as decision
  from (select conv_id as story, count(*) as new_count, (count(*) filter (where turn % 2 = 0 or conv_id % 3 = 0) + case when conv_id % 11 = 0 then 5 else 0 end) * case when conv_id % 7 = 0 then 0 else 1 end as old_count from conversations group by conv_id) n""")
def update_decision(spark, sf):
    rows = _chapters(spark, sf)
    kept = F.count_if((F.col("pos") % 2 == 0) | (F.col("story") % 3 == 0)) + F.when(F.col("story") % 11 == 0, 5).otherwise(0)
    counts = rows.groupBy("story").agg(F.count("*").alias("new_count"), (kept * F.when(F.col("story") % 7 == 0, 0).otherwise(1)).alias("old_count"))
    return counts.select("story", "old_count", "new_count", listing.decision(F.col("old_count"), F.col("new_count")).alias("decision"))


@query("""
  with n as (select distinct conv_id as story from conversations where conv_id % 3 <> 0), o as (select distinct conv_id as story from conversations where conv_id % 2 = 0)
  select coalesce(n.story, o.story) as story, case when n.story is null then 'removed' when o.story is null then 'added' else 'kept' end as state from n full join o on n.story = o.story""")
def anthology_fullouter(spark, sf):
    rows = _chapters(spark, sf).select("story")
    return library.anthology(rows.where("story % 3 <> 0"), rows.where("story % 2 = 0"), "story")


_DATED = "select conv_id as story, turn as pos, (turn * 7 + conv_id) % 5 as day from conversations"


@query(f"select story, arg_min(pos, pos) filter (where day = top) as newest from (select *, max(day) over (partition by story) as top from ({_DATED})) group by story")
def newest_position(spark, sf):
    rows = _chapters(spark, sf).withColumn("day", (F.col("pos") * 7 + F.col("story")) % 5)
    return listing.from_newest(rows, "story", "day", "pos").select("story", "newest").distinct()


@query(f"""select d.story, d.pos from ({_DATED}) d join (select story, min(pos) filter (where day = top) as newest from (select *, max(day) over (partition by story) as top from ({_DATED})) group by story) n on d.story = n.story where d.pos < n.newest""")
def truncate_from_newest(spark, sf):
    rows = _chapters(spark, sf).withColumn("day", (F.col("pos") * 7 + F.col("story")) % 5)
    return listing.before_newest(rows, "story", "day", "pos").select("story", "pos")


@query("""select conv_id as story, turn as pos, coalesce(sum(case when (turn + conv_id) % 3 = 0 then 1 else 0 end) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) < 2 as tried from conversations""")
def chapter_error_limit(spark, sf):
    rows = _chapters(spark, sf).withColumn("failed", (F.col("pos") + F.col("story")) % 3 == 0)
    return listing.with_error_limit(rows, "story", "pos", "failed", 2).select("story", "pos", "tried")


@query("""select conv_id as story, string_agg('<b>' || entry || ':</b> ' || value || '<br />', chr(10) order by ord) as page
  from (select conv_id, 0 as ord, 'Speaker' as entry, min(role) as value from conversations group by conv_id
    union all select conv_id, 1, 'Chapters', count(*)::varchar from conversations group by conv_id
    union all select conv_id, 2, 'Words', sum(len(string_split(text, ' ')))::varchar from conversations group by conv_id) group by conv_id""")
def eav_title_page(spark, sf):
    rows = _chapters(spark, sf)
    facts = rows.groupBy("story").agg(F.min("role").alias("role"), F.count("*").alias("chapters"), F.sum(F.size(F.split("text", " "))).alias("words"), F.lit("").alias("empty"))
    return render.title_page(facts, "story", [("role", "Speaker"), ("chapters", "Chapters"), ("empty", "Nothing"), ("words", "Words")])


@query(f"""select story, string_agg('<a href="file' || lpad(number::varchar, 4, '0') || '.xhtml">' || role || '</a><br />', chr(10) order by number) as toc from ({_NUMBERED}) where chapters > 1 group by story""")
def toc(spark, sf):
    return render.contents(listing.numbered_chapters(_chapters(spark, sf), "story", "pos"), "story", "number", "role", "text")


@query("""select conv_id as story, string_agg('<p><b>' || entry || ':</b><span class="' || kind || '" id="' || entry || '">' || value || '</span></p>', chr(10) order by entry) as dump
  from (select conv_id, 'numChapters' as entry, 'int' as kind, count(*)::varchar as value from conversations group by conv_id
    union all select conv_id, 'speaker', 'string', min(role) from conversations group by conv_id
    union all select conv_id, 'category', 'list', 'A, B' from conversations group by conv_id) group by conv_id""")
def metadata_dump(spark, sf):
    facts = _chapters(spark, sf).groupBy("story").agg(F.count("*").alias("numChapters"), F.min("role").alias("speaker"), F.array(F.lit("A"), F.lit(None).cast("string"), F.lit(""), F.lit("B")).alias("category"))
    return render.metadata_dump(facts, "story")


@query("""select conv_id as story, string_agg('<h3>' || role || '</h3>' || chr(10) || text, chr(10) order by turn) as body, count(*) as n from conversations group by conv_id""")
def html_files(spark, sf):
    return render.html_bodies(_chapters(spark, sf), "story", "pos", "role", "text")
