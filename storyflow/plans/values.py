"""Queries of scalar functions: numbers, dates, codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyflow.functions import arrays, binary, dates, text, urls
from storyflow.operators import library
from storyflow.plans.registry import query
from storyflow.shared import table


@query("select o_orderkey, format('{:,}', (o_totalprice * 1000)::bigint) as total from orders")
def comma_groups(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.comma_groups(F.round(F.col("o_totalprice") * 1000).cast("bigint")).alias("total"))


@query("select p_partkey, regexp_replace(p_name || '/' || p_brand || '?.', '(^\\.|/\\.|[^a-zA-Z0-9_\\. \\[\\]\\(\\)&''-]+)', '_', 'g') as file_name from part")
def filename_safe(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.file_name(F.concat("p_name", F.lit("/"), "p_brand", F.lit("?."))).alias("file_name"))


@query("select o_orderkey, coalesce(case when o_orderkey % 3 = 0 then o_orderdate end, case when o_orderkey % 2 = 0 then o_orderdate - interval 1 day end, o_orderdate - interval 7 day) as date_updated from orders")
def date_defaulting(spark, sf):
    date = F.col("o_orderdate")
    updated = dates.defaulted(F.when(F.col("o_orderkey") % 3 == 0, date), F.when(F.col("o_orderkey") % 2 == 0, date - F.expr("interval 1 day")), date - F.expr("interval 7 days"))
    return table(spark, sf, "orders").select("o_orderkey", updated.alias("date_updated"))


_AGO = "('3 days ago', 259200), ('2 years ago', 63072000), ('1 month', 2678400), ('5 mins ago', 300), ('Yesterday', 86400), ('just now', 0), ('10 h', 36000), ('1 week ago', 604800), ('2 yr', 63072000), ('3 mth ago', 8035200), ('4 fortnights', null), ('whenever', null)"


@query(f"select said, coalesce(timestamp '2024-05-01 12:00:00' - to_seconds(ago), timestamp '1970-01-02 00:00:00') as at from (values {_AGO}) as t(said, ago)")
def relative_date(spark, sf):
    said = spark.sql(f"select * from values {_AGO} as t(said, ago)")
    return said.select("said", dates.relative(F.col("said"), F.lit("2024-05-01 12:00:00").cast("timestamp")).alias("at"))


@query("select event_id, make_timestamp(epoch_us(ts) // 1000 * 1000) as at from events")
def epoch_ms(spark, sf):
    return table(spark, sf, "events").select("event_id", dates.from_milliseconds(F.unix_millis(F.col("ts").cast("timestamp"))).cast("timestamp_ntz").alias("at"))


@query("select event_id, (epoch_us(ts) + 11644473600000000) / 1000000 - 11644473600 as seconds from events")
def webkit_epoch(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp")) + 11644473600000000
    return table(spark, sf, "events").select("event_id", dates.from_webkit(us).alias("seconds"))


@query("select n_nationkey, n_name || case when n_nationkey % 3 = 0 then '' when n_nationkey % 3 = 1 then ' [' || n_nationkey || ']' else ' [' || n_nationkey || '.5]' end as series from nation")
def series_names(spark, sf):
    key = F.col("n_nationkey")
    number = F.when(key % 3 == 0, None).when(key % 3 == 1, key.cast("double")).otherwise(key + 0.5)
    return table(spark, sf, "nation").select("n_nationkey", binary.series(F.col("n_name"), number).alias("series"))


@query("""
  with a as (select p_partkey, p_size * 40 as w0, (p_partkey % 50 + 1) * 30 as h0 from part),
  b as (select *, case when h0 > 725 then floor(725 / h0::double * w0) else w0 end as w1, least(h0, 725) as h1 from a),
  c as (select *, least(w1, 580) as w2, case when w1 > 580 then floor(580 / w1::double * h1) else h1 end as h2 from b)
  select p_partkey, h0 > 725 or w0 > 580 as scaled, w2::bigint as width, h2::bigint as height from c""")
def fit_box(spark, sf):
    boxes = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 40).cast("bigint").alias("w"), ((F.col("p_partkey") % 50 + 1) * 30).cast("bigint").alias("h"))
    scaled, width, height = binary.fitted(F.col("w"), F.col("h"), 580, 725)
    return boxes.select("p_partkey", scaled.alias("scaled"), width.alias("width"), height.alias("height"))


@query("select c_custkey, replace(lower(c_name), '#', '+&amp;') || '@mail.' || c_nationkey as plain from customer")
def email_decode(spark, sf):
    key = (F.col("c_custkey") % 256).cast("int")
    address = F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit("+&")), F.lit("@mail."), F.col("c_nationkey").cast("string"))
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    # A variable of a lambda holds the address, which is computed once a row.
    hidden = F.transform(F.array(address), lambda a: F.array_join(F.transform(F.split(a, ""), lambda c: byte(F.ascii(c).bitwiseXOR(key))), ""))[0]
    code = F.concat(byte(key), hidden)
    return table(spark, sf, "customer").select("c_custkey", text.decode_email(code).alias("plain"))


@query("""select o_orderkey, case when o_orderstatus = 'F' then true when o_orderstatus = 'O' then false end as flag,
  contains(lower(status), 'complete') as complete, contains(lower(status), 'progress') as in_progress, (o_orderkey * 1000)::bigint as number
  from (select *, case o_orderstatus when 'F' then 'Completed' when 'O' then 'In-Progress' else 'Hiatus' end as status from orders)""")
def custom_column_casts(spark, sf):
    orders = table(spark, sf, "orders")
    word = F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "O", " n ").otherwise("maybe")
    status = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "In-Progress").otherwise("Hiatus")
    complete, progress = library.status_flags(status)
    grouped = text.comma_groups(F.col("o_orderkey") * 1000)
    return orders.select("o_orderkey", arrays.bool_words(word).alias("flag"), complete.alias("complete"), progress.alias("in_progress"), library.casts(grouped)["int"].alias("number"))


@query("select event_id, (props->>'k')::bigint as k, case when (props->>'k')::bigint % 3 = 0 then 'route-' || ((props->>'k')::bigint) end as route from events")
def json_choice_extract(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events").select("event_id", k.alias("k"), F.when(k % 3 == 0, F.concat(F.lit("route-"), k.cast("string"))).alias("route"))


@query("select doc_id, floor((doc_id + 10) / 10.0)::bigint as page, lpad((doc_id % 10)::varchar, 2, '0') as post from documents")
def page_sequence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", urls.page_of(F.col("doc_id"), 10).alias("page"), F.lpad((F.col("doc_id") % 10).cast("string"), 2, "0").alias("post"))


@query("""with f as (select *, o_orderdate + to_hours(o_orderkey % 49 - 24) as changed, o_orderdate + to_minutes(case when o_orderkey % 2 = 0 then 0 else 61 end) as source from orders)
  select o_orderkey, (o_orderkey // 86400)::bigint as days, case when date_trunc('day', source) = source then changed::date > source::date else changed > source end as newer from f""")
def file_date_gate(spark, sf):
    date = F.col("o_orderdate").cast("timestamp")
    changed = date + F.make_dt_interval(hours=(F.col("o_orderkey") % 49 - 24).cast("int"))
    source = date + F.make_dt_interval(mins=F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(61))
    return table(spark, sf, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 86400).cast("bigint").alias("days"), dates.newer_file(changed, source).alias("newer"))


@query("""with s as (select o_orderkey, (case o_orderkey % 4 when 0 then o_orderkey % 61 when 1 then o_orderkey * 7 % 3700 when 2 then o_orderkey * 61 % 90000 else o_orderkey * 3607 % 2000000 end)::bigint as said from orders),
  u as (select *, [[said // 86400], [said % 86400 // 3600], [said % 3600 // 60], [said % 60]] as n from s),
  p as (select *, list_filter(list_transform(n, lambda x, i: case when x[1] = 0 then '' else x[1] || ' ' || ['day', 'hour', 'minute', 'second'][i] || case when x[1] = 1 then '' else 's' end end), lambda x: x <> '') as parts from u)
  select o_orderkey, said, array_to_string(parts[1:2], ', ') as shown from p""")
def durations(spark, sf):
    k = F.col("o_orderkey")
    said = F.when(k % 4 == 0, k % 61).when(k % 4 == 1, k * 7 % 3700).when(k % 4 == 2, k * 61 % 90000).otherwise(k * 3607 % 2000000)
    return table(spark, sf, "orders").select("o_orderkey", said.cast("bigint").alias("said"), dates.two_units(said.cast("int")).alias("shown"))


@query("""select l_orderkey, round(sum(l_quantity), 4) as total, round(avg(l_quantity), 4) as mean, max(l_quantity) as most from lineitem group by l_orderkey""")
def comma_list_numbers(spark, sf):
    lists = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.collect_list("l_quantity"), lambda x: x.cast("string")), ", ").alias("q"))
    q = F.col("q")
    return lists.select("l_orderkey", F.round(arrays.list_sum(q), 4).alias("total"), F.round(arrays.list_mean(q), 4).alias("mean"), arrays.list_max(q).alias("most"))
