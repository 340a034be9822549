"""Queries of the rule language and of lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyflow.functions import arrays, dates
from storyflow.operators import lookups
from storyflow.plans.registry import query
from storyflow.rules import engine, language
from storyflow.shared import table


def _presented(df, key, names=None, **program):
    return engine.present(df, language.parse(**program), names or [key])


@query("""select p_partkey, regexp_replace(regexp_replace(p_type, '^STANDARD', 'PLAIN', 'g'), '(\\w+) (\\w+)$', '\\2 \\1', 'g') as p_type,
  regexp_replace(p_brand, '#', ' no. ', 'g') as p_brand from part""")
def rule_replace_fold(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    rules = "p_type=>^STANDARD=>PLAIN\np_type=>(\\w+) (\\w+)$=>\\2 \\1\np_brand=>#=>\\sno.\\s"
    return _presented(parts, "p_type", ["p_type", "p_brand"], replace=rules)


@query("""select p_partkey, p_brand, case when regexp_matches(p_type, 'BRASS|STEEL') then regexp_replace(p_name, '^(\\w+)', 'metal \\1', 'g') else p_name end as p_name,
  p_type from part""")
def rule_conditional_replace(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    return _presented(parts, "p_name", ["p_name", "p_type"], replace="p_name=>^(\\w+)=>metal \\1&&p_type=~BRASS|STEEL")


@query("""select o_orderkey, case when o_orderpriority = '1-URGENT' or regexp_matches(o_orderpriority, '^[23]') then o_orderpriority else '' end as o_orderpriority from orders""")
def rule_include_pre(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return _presented(orders, "o_orderpriority", include_pre="o_orderpriority==1-URGENT\no_orderpriority=~^[23]\nother==x")


@query("""select c_custkey, case when c_mktsegment = 'BUILDING' or (regexp_matches(c_mktsegment, '^MACH') and contains(c_name, '7')) then '' else c_mktsegment end as c_mktsegment, c_name from customer""")
def rule_exclude_pre(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_name")
    return _presented(customers, "c_mktsegment", ["c_mktsegment", "c_name"], exclude_pre="c_mktsegment==BUILDING\nc_mktsegment=~^MACH&&c_name=~7")


@query("""select p_partkey, array_to_string(list_sort(list_distinct(list_filter([regexp_extract(p_type, '^(\\w+)', 1), regexp_extract(p_type, '(\\w+)$', 1)], lambda x: x <> ''))), ', ') as kinds from part""")
def rule_split_to_list(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.array("p_type").alias("kinds"))
    out = _presented(parts, "kinds", replace="kinds=>^(\\w+).* (\\w+)$=>\\1\\,\\2")
    return out.select("p_partkey", arrays.joined(F.col("kinds")).alias("kinds"))


@query()
def rule_split_recursive(spark, sf):
    """Splits that run the whole program again on each part."""
    parts = table(spark, sf, "part").select("p_partkey", F.array("p_type").alias("kinds"), F.array("p_brand").alias("brand"))
    rules = "kinds=>^(\\w+) (.*)$=>\\1\\,\\2\nkinds=>^(\\w+) (\\w+)$=>\\1\\,\\2&&brand=~[123]$\nkinds=>STEEL=>IRON"
    out = _presented(parts, "kinds", ["kinds", "brand"], replace=rules, exclude_post="kinds==TIN")
    return out.select("p_partkey", arrays.joined(F.col("kinds")).alias("kinds"))


_BRANDS = """select l_orderkey, list(p_brand order by l_linenumber, p_brand, mode) as brands, list(mode order by l_linenumber, p_brand, mode) as modes
  from (select l_orderkey, l_linenumber, p_brand, l_returnflag || l_linestatus as mode from lineitem join part on p_partkey = l_partkey) group by l_orderkey"""


def _brands(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("mode"))
    joined = lines.join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    rows = joined.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_brand", "mode"))).alias("r"))
    return rows.select("l_orderkey", F.transform("r", lambda x: x["p_brand"]).alias("brands"), F.transform("r", lambda x: x["mode"]).alias("modes"))


@query(f"select l_orderkey, len(list_filter(brands, lambda x: x = 'Brand#11' or regexp_matches(x, '3$'))) = 0 as none_matches from ({_BRANDS})")
def rule_list_predicate_negated(spark, sf):
    orders = _brands(spark, sf)
    first = engine.test_column(language.parse_test("brands!=Brand#11"), F.col("brands"), True)
    second = engine.test_column(language.parse_test("brands!~3$"), F.col("brands"), True)
    return orders.select("l_orderkey", (first & second).alias("none_matches"))


@query(f"select l_orderkey, array_to_string(list_sort(list_distinct(brands)), ', ') as brands from ({_BRANDS})")
def list_finalize_sorted(spark, sf):
    return _brands(spark, sf).select("l_orderkey", arrays.joined(arrays.finished(F.col("brands"))).alias("brands"))


@query("""select l_orderkey, string_agg(p_brand, ', ' order by first, p_brand) as brands from (
  select l_orderkey, p_brand, min(l_linenumber) as first from lineitem join part on p_partkey = l_partkey group by l_orderkey, p_brand) group by l_orderkey""")
def list_finalize_keep_order(spark, sf):
    return _brands(spark, sf).select("l_orderkey", arrays.joined(arrays.finished(F.col("brands"), True)).alias("brands"))


@query(f"select l_orderkey, array_to_string(brands, ' & ') as brands, array_to_string(modes, ', ') as modes from ({_BRANDS})")
def list_join_string(spark, sf):
    return _brands(spark, sf).select("l_orderkey", arrays.joined(F.col("brands"), " & ").alias("brands"), arrays.joined(F.col("modes")).alias("modes"))


@query(f"select l_orderkey, array_to_string(list_sort(list_distinct(list_concat(list_concat(brands, ['Fiction']), modes))), ', ') as tags from ({_BRANDS})")
def include_in_union(spark, sf):
    shown = engine.present(_brands(spark, sf), language.parse(), [], unions={"tags": ["brands", '"Fiction"', "modes"]})
    return shown.select("l_orderkey", arrays.joined(F.col("tags")).alias("tags"))


@query(f"select l_orderkey, array_to_string(case when len(list_distinct(modes)) > 1 then list_append(list_sort(list_distinct(brands)), 'Crossover') else list_sort(list_distinct(brands)) end, ', ') as genre from ({_BRANDS})")
def multi_category_flag(spark, sf):
    flagged = arrays.flagged(arrays.finished(F.col("brands")), arrays.finished(F.col("modes")), "Crossover")
    return _brands(spark, sf).select("l_orderkey", arrays.joined(flagged).alias("genre"))


@query("""select p_partkey, array_to_string(list_sort(string_split(replace(p_type, ' ', '/'), '/')), '/') as ship from part""")
def ships_sorted(spark, sf):
    ships = arrays.ships(F.array(F.replace("p_type", F.lit(" "), F.lit("/"))))
    return table(spark, sf, "part").select("p_partkey", F.element_at(ships, 1).alias("ship"))


@query("""with t as (select p_partkey, list_filter(list_transform(list_concat([p_brand], string_split(p_name, ' '), [p_type], ['Book', 'Book']), lambda x: trim(x)), lambda x: x <> '') as x from part)
  select p_partkey, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), '; ') as tags from t""")
def subject_tags(spark, sf):
    entries = {"brand": F.array("p_brand"), "names": F.array(F.replace("p_name", F.lit(" "), F.lit(", "))), "type": F.array("p_type", F.lit(None).cast("string"))}
    tags = arrays.subject_tags(entries, ["brand", "names.SPLIT", "type_LIST"], ["Book", "Book"])
    return table(spark, sf, "part").select("p_partkey", arrays.joined(tags, "; ").alias("tags"))


@query("""select doc_id, case lang when 'en' then 'en' when 'de' then 'de' when 'fr' then 'fr' when 'es' then 'es' else 'en' end as code from documents""")
def langcode_lookup(spark, sf):
    names = F.create_map(*map(F.lit, ("en", "English", "de", "Deutsch", "fr", "Français", "es", "Español")))
    return table(spark, sf, "documents").select("doc_id", lookups.language_code(F.element_at(names, F.col("lang"))).alias("code"))


@query("""select o_orderkey, 'Last Update Year/Month: ' || strftime(o_orderdate, '%Y/%m') || ', Last Update: ' || strftime(o_orderdate, '%Y/%m/%d') as tags from orders""")
def lastupdate_tags(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", arrays.joined(dates.last_update_tags(F.col("o_orderdate"))).alias("tags"))


_ZIP = "select l_orderkey, array_to_string(list_transform(range(1, len(brands) + 1), lambda i: '<a href=\"' || coalesce(case when i < len(brands) then modes[i] end, 'None') || '\">' || brands[i] || '</a>'), ', ') as links, len(modes) = len(brands) as same_size from ("


@query(_ZIP + _BRANDS + ")")
def zip_links_html(spark, sf):
    orders = _brands(spark, sf)
    fewer = F.slice("modes", F.lit(1), F.size("modes") - 1)
    same = arrays.if_same_size(F.col("modes"), F.col("brands"), F.lit(True))
    return orders.select("l_orderkey", arrays.joined(arrays.links(F.col("brands"), fewer)).alias("links"), F.coalesce(same, F.lit(False)).alias("same_size"))


@query("""with p as (select p_partkey, p_brand, string_split(p_name, ' ') as ws from part)
  select p_partkey, array_to_string(list_concat(case when list_contains(list_transform(ws, lambda w: lower(w)), lower(p_brand)) then cast([] as varchar[]) else [p_brand] end,
    list_transform(ws, lambda w: case when lower(w) = lower(p_brand) then p_brand when lower(w) = lower(ws[1]) then upper(ws[1]) else w end)), ', ') as tags from p""")
def case_insensitive_tag_union(spark, sf):
    words = F.split("p_name", " ")
    parts = table(spark, sf, "part")
    old, new = F.array("p_brand", F.upper(words[0])), words
    return parts.select("p_partkey", arrays.joined(arrays.case_insensitive_union(old, new)).alias("tags"))


@query()
def rule_language_interpreter(spark, sf):
    """Patterns that Java lacks run in the interpreter."""
    parts = table(spark, sf, "part").select("p_partkey", "p_type")
    return _presented(parts, "p_type", replace="p_type=>^(STANDARD )?(.*)(?(1) TIN| BRASS)$=>\\2")
