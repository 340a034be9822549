"""Queries over orders, parts, events and labels as library rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyflow.functions import text
from storyflow.operators import keys, library, lookups, positions
from storyflow.plans.registry import query
from storyflow.shared import table
from storyflow.sinks import render


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels where quality = 0)")
def reject_anti(spark, sf):
    rejects = table(spark, sf, "labels").where("quality = 0")
    return library.wanted(table(spark, sf, "documents").select("doc_id", "source"), rejects, "doc_id")


@query("select page_id, url from pages where page_id in (select doc_id from labels)")
def only_existing_semi(spark, sf):
    existing = table(spark, sf, "labels").withColumnRenamed("doc_id", "page_id")
    return keys.keep(table(spark, sf, "pages").select("page_id", "url"), existing, ["page_id"])


@query("""
  with b as (select c_custkey, 'https://x/' || c_custkey as url, c_name as title, c_mktsegment as author from customer),
  l as (select c_custkey as book_id, case when c_custkey % 2 = 0 then 'http://x/' || c_custkey else 'http://y/' || c_custkey end as url, case when c_custkey % 3 = 0 then upper(c_name) else 'none' end as title, c_mktsegment as author from customer)
  select c_custkey, coalesce(u.book_id, n.book_id) as book_id, case when u.book_id is not null then 'url' when n.book_id is not null then 'title' else 'none' end as matched_by
  from b left join (select regexp_replace(url, '^https?:', '') as key, min(book_id) as book_id from l group by 1) u on u.key = regexp_replace(b.url, '^https?:', '')
  left join (select lower(title) as t, lower(author) as a, min(book_id) as book_id from l group by 1, 2) n on n.t = lower(b.title) and n.a = lower(b.author)""")
def library_match_two_step(spark, sf):
    c = table(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    books = c.select("c_custkey", F.concat(F.lit("https://x/"), key).alias("url"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("author"))
    owned = c.select(F.col("c_custkey").alias("book_id"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "http://x/").otherwise("http://y/"), key).alias("url"), F.when(F.col("c_custkey") % 3 == 0, F.upper("c_name")).otherwise("none").alias("title"), F.col("c_mktsegment").alias("author"))
    return library.matched(books, owned).select("c_custkey", "book_id", "matched_by")


@query("""select c_custkey, string_agg(coalesce(n_name, '?'), ', ' order by place) as names from (select c_custkey, unnest([0, 1]) as place, unnest([c_nationkey, c_nationkey + 100]) as id from customer) left join nation on n_nationkey = id group by c_custkey""")
def id_to_name_lookup(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.array("c_nationkey", F.col("c_nationkey") + 100).alias("ids"))
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    rows = lookups.names_of(c, "ids", names).groupBy("c_custkey").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("name", F.lit("?")).alias("name")))).alias("r"))
    return rows.select("c_custkey", F.array_join(F.transform("r", lambda r: r["name"]), ", ").alias("names"))


@query("select doc_id as url, case when doc_id % 1000 = 999 then null else doc_id - doc_id % 1000 % 60 end as final_url from documents")
def redirect_chase(spark, sf):
    urls = table(spark, sf, "documents").select(F.col("doc_id").alias("url"))
    back = urls.where("url % 1000 % 60 <> 0 and url % 1000 <> 999").select("url", (F.col("url") - 1).alias("location"))
    moves = back.unionByName(urls.where("url % 1000 = 999").select("url", F.col("url").alias("location")))
    return lookups.redirects(spark, urls, moves)


@query("""select source, sum(case when lang = 'en' then words else 0 end)::bigint as words, min(doc_id) as first_doc, max(doc_id) as last_doc, printf('%4.2f', avg(words)) as mean, count(*) filter (where words < 50) as errors
  from (select doc_id, lang, source, len(string_split(text, ' ')) as words from documents) group by source""")
def sum_words_if_added(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", F.size(F.split("text", " ")).alias("words"))
    return docs.groupBy("source").agg(F.sum(F.when(F.col("lang") == "en", F.col("words")).otherwise(0)).alias("words"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.format_string("%4.2f", F.avg("words")).alias("mean"), F.count_if(F.col("words") < 50).alias("errors"))


@query("""select p.event_type as poll, c.choice, coalesce(v.votes, 0) as votes, coalesce(v.verified_votes, 0) as verified_votes
  from (select distinct event_type from events) p cross join (select unnest(range(0, 5)) as choice) c
  left join (select event_type, (props->>'k')::bigint % 8 as choice, count(*) as votes, count(*) filter (where user_id % 2 = 0) as verified_votes from events group by 1, 2) v on v.event_type = p.event_type and v.choice = c.choice""")
def vote_histogram(spark, sf):
    events = table(spark, sf, "events")
    polls = events.select(F.col("event_type").alias("poll"), F.array(F.from_json("props", "k bigint")["k"] % 8).alias("votes"), (F.col("user_id") % 2 == 0).alias("verified"))
    choices = events.select(F.col("event_type").alias("poll")).distinct().select("poll", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("choice"))
    return lookups.votes(polls, choices)


@query("""
  with o as (select o_custkey as series, o_orderkey as pos, 'a' || (o_orderkey % 5) as author, o_orderstatus as publisher, o_orderpriority as tag, o_orderdate as published, o_orderdate as updated, 1::bigint as chapters, (o_orderkey % 1000)::bigint as words, o_orderpriority as description from orders)
  select b.series, published, updated, chapters, words, publisher, tags, description, authors from (
    select series, min(published) as published, max(updated) as updated, sum(chapters)::bigint as chapters, sum(words)::bigint as words, case when count(distinct publisher) = 1 then min(publisher) end as publisher,
      array_to_string(list_sort(list(distinct tag)), ', ') as tags, string_agg(description, chr(10) || chr(10) order by pos, description) as description from o group by series) b
  join (select series, string_agg(author, ', ' order by p) as authors from (select series, author, min(pos) as p from o group by series, author) group by series) a on a.series = b.series""")
def anthology_merge(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("a"), (F.col("o_orderkey") % 5).cast("string")).alias("author"), F.col("o_orderstatus").alias("publisher"), F.col("o_orderpriority").alias("tag"), F.col("o_orderdate").alias("published"), F.col("o_orderdate").alias("updated"), F.lit(1).cast("bigint").alias("chapters"), (F.col("o_orderkey") % 1000).alias("words"), F.col("o_orderpriority").alias("description"))
    out = library.merged_books(rows, "series", "pos")
    return out.withColumns({"tags": F.array_join("tags", ", "), "authors": F.array_join("authors", ", ")})


@query("""with own as (select distinct l_suppkey % 10 as grp, l_suppkey % 3 as owner, p_brand as member from lineitem join part on p_partkey = l_partkey)
  select grp, member from own group by grp, member having count(*) = (select count(distinct owner) from own o where o.grp = own.grp)""")
def common_series(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).select((F.col("l_suppkey") % 10).alias("grp"), (F.col("l_suppkey") % 3).alias("owner"), F.col("p_brand").alias("member"))
    return library.common_members(rows, "grp", "owner", "member")


@query("""select o_orderkey, (case when good then 0 else 8 end + coalesce(list_position(['Add', 'Update', 'Meta', 'Different URL', 'Skipped', 'Bad', 'Error'], status) - 1, 7))::bigint * 10000 + place as report_order
  from (select o_orderkey, o_orderstatus <> 'P' as good, case o_orderstatus when 'F' then 'Update' when 'O' then 'Add' else 'Odd' end as status, o_orderkey % 10000 as place from orders)""")
def status_report_order(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "Update").when(F.col("o_orderstatus") == "O", "Add").otherwise("Odd")
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") != "P").alias("good"), status.alias("status"), (F.col("o_orderkey") % 10000).alias("place"))
    return library.report(rows, "status", "good", "place").select("o_orderkey", "report_order")


@query("""with recursive names as (select p_brand, min(p_name) as a, max(p_name) as b from (select p_brand, lower(p_name) as p_name from part) group by p_brand),
  n as (select p_brand, (select coalesce(max(i), 0) from range(0, 100) t(i) where i <= length(a) and i <= length(b) and substr(a, 1, i) = substr(b, 1, i)) as n, a from names)
  select p_brand, substr(a, 1, n) as prefix from n""")
def longest_common_prefix(spark, sf):
    # the least and the greatest text of a group have the group's common prefix
    ends = table(spark, sf, "part").groupBy("p_brand").agg(F.array(F.min(F.lower("p_name")), F.max(F.lower("p_name"))).alias("names"))
    return ends.select("p_brand", text.common_prefix(F.col("names")).alias("prefix"))


@query("""select user_id, arg_min(event_type, event_id) filter (where value > 20) as first_value, arg_max(event_type, event_id) filter (where value > 20) as last_value from events group by user_id""")
def first_last_nonnull(spark, sf):
    rows = table(spark, sf, "events").withColumn("kind", F.when(F.col("value") > 20, F.col("event_type")))
    return positions.first_and_last(rows, "user_id", "kind", F.col("event_id"))


@query("select source, bool_or(toxic = 1) as adult, count(*) as n from documents join labels using (doc_id) group by source")
def any_adult(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.bool_or(F.col("toxic") == 1).alias("adult"), F.count("*").alias("n"))


@query("select * from (select user_id, event_id, ts, lead(ts) over (partition by user_id order by ts, event_id) as until from events) where until is not null")
def adjacent_pairs(spark, sf):
    return positions.pairs(table(spark, sf, "events").select("user_id", "event_id", "ts"), "user_id", F.col("ts"), F.col("event_id"))


@query("select user_id, event_id, round(value, 6) as value, round(value - lag(value) over (partition by user_id order by event_id), 6) as added from events")
def words_added_delta(spark, sf):
    out = positions.delta(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "value", F.col("event_id"))
    return out.withColumns({"value": F.round("value", 6), "added": F.round("added", 6)})


@query("""select user_id, event_id, event_type, previous from (select user_id, event_id, event_type, lag(event_type) over w as previous, row_number() over w as n from events window w as (partition by user_id order by event_id)) where n = 1 or previous is distinct from event_type""")
def log_changed_entries(spark, sf):
    return positions.changes(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_type", F.col("event_id"))


@query("select user_id, event_type, round(arg_max(value, event_id), 6) as value from events where value is not null group by user_id, event_type")
def last_log_value(spark, sf):
    out = positions.last_values(table(spark, sf, "events").where("value is not null"), ["user_id", "event_type"], "value", F.col("event_id"))
    return out.withColumn("value", F.round("value", 6))


@query("""select o_orderkey, category, row_number() over (order by case when category = '1-URGENT' then 0 else 1 end, case category when '5-LOW' then 1 when '2-HIGH' then 2 else 3 end, category, case when category = '1-URGENT' then o_orderdate end, o_orderkey) as place
  from (select o_orderkey, o_orderdate, case when o_orderpriority = '3-MEDIUM' then '2-HIGH' else o_orderpriority end as category from orders where o_orderpriority not like '4%')""")
def category_order(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("category"))
    ranked = positions.category_order(rows, "category", ["5-LOW", "2-HIGH"], "o_orderdate", "o_orderkey", by_date=["1-URGENT"], skip=["4-NOT SPECIFIED"], renamed={"3-MEDIUM": "2-HIGH"})
    return positions.placed(ranked, "rank").select("o_orderkey", "category", "place")


@query("""select doc_id, min(doc_id) over (partition by strlen(text), md5(text)) as file from documents""")
def image_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("data"))
    return keys.shared_file(docs, "data", "doc_id", "doc_id").select("doc_id", "file")


@query("""select user_id as cache_key, arg_min(event_id, k) as entry_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id) as k from events where ts > (select max(ts) from events) - interval 100 hour) group by user_id""")
def cache_latest_ttl(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("cache_key"), F.col("event_id").alias("entry_id"), F.col("ts").cast("timestamp").alias("ts"))
    now = events.agg(F.max("ts")).first()[0]
    return lookups.latest_cached(events, F.lit(now), 100).select("cache_key", "entry_id")


@query("""select s_suppkey, s_name, url from (select s_suppkey, s_name, 'u' || s_suppkey as url, case when s_suppkey % 4 = 0 then null when s_suppkey % 4 = 1 then 'x' else 'u' || s_suppkey end as old from supplier) where old is distinct from url""")
def author_url_diff(spark, sf):
    s = table(spark, sf, "supplier")
    url = F.concat(F.lit("u"), F.col("s_suppkey").cast("string"))
    new = s.select("s_suppkey", "s_name", url.alias("url"))
    old = s.where("s_suppkey % 4 <> 0").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 1, "x").otherwise(url).alias("old"))
    return new.join(old, "s_suppkey", "left").where(~F.col("old").eqNullSafe(F.col("url"))).drop("old")


@query("""select o_custkey % 20 as section_url, arg_min(o_orderkey, n) as kept from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey % 20 order by length(o_orderpriority) desc, o_orderkey) as n from orders) group by 1""")
def reject_list_longest(spark, sf):
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("section_url"), F.col("o_orderpriority").alias("url"), F.col("o_orderkey").alias("pos"))
    return library.reject_list(rows).select("section_url", F.col("pos").alias("kept"))


@query("""with c as (select user_id % 50 as story, event_id // 2000 as version, event_type as entry, count(*) as value from events group by 1, 2, 3),
  b as (select story, version, '<div class="log" id="' || version || '">' || chr(10) || string_agg('<b>' || entry || ':</b> ' || value || '<br />', chr(10) order by entry) || chr(10) || '</div>' as block from (select *, lag(value) over (partition by story, entry order by version) as old from c) where old is distinct from value group by story, version)
  select story, string_agg(block, chr(10) order by version desc) as log from b group by story""")
def change_log(spark, sf):
    rows = table(spark, sf, "events").groupBy((F.col("user_id") % 50).alias("story"), F.floor(F.col("event_id") / 2000).cast("bigint").alias("version"), F.col("event_type").alias("entry")).agg(F.count("*").alias("value"))
    changed = positions.changes(rows, ["story", "entry"], "value", F.col("version"))
    return render.log_page(changed, "story", "version", "entry", "value")
