import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyflow.rules import engine, language


def shown(spark, row, kinds, names=None, unions=None, **lines):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[k]}" for k in row))
    return engine.present(df, language.parse(**lines), names or list(row), unions=unions).first().asDict()


CASES = [
    ({"genre": ["Sci-Fi", "SciFi"]}, {"replace": "genre=>^Sci-?Fi$=>Science Fiction"}, ["Science Fiction"]),
    ({"genre": ["a"]}, {"replace": "a=>b\nb=>c"}, ["c"]),
    ({"genre": ["Drama and Angst"]}, {"replace": "genre=>^(\\w+) and (\\w+)$=>\\1\\,\\2"}, ["Angst", "Drama"]),
    ({"genre": ["Drama", "Angst"]}, {"include_pre": "genre==Drama"}, ["Drama"]),
    ({"genre": ["Angst"]}, {"include_pre": "category==A"}, ["Angst"]),
    ({"genre": ["Drama", "Angst"]}, {"exclude_post": "genre=~^Ang"}, ["Drama"]),
    ({"genre": ["b", "a", "b", "", None]}, {}, ["a", "b"]),
    ({"author": ["b", "a", "b"]}, {}, ["b", "a"]),
    ({"genre": ["x y"]}, {"replace": "genre=>x\\sy=>p\\sq"}, ["p q"]),
    ({"genre": ["5$", "a1"]}, {"replace": "genre=>(\\d)=>$\\1"}, ["$5$", "a$1"]),
]


@pytest.mark.parametrize("row, lines, want", CASES)
def test_lists(spark, row, lines, want):
    key = next(iter(row))
    assert shown(spark, row, {key: "array<string>"}, **lines)[key] == want


def test_conditions_see_presented_values(spark):
    kinds = {"title": "string", "status": "string", "genre": "array<string>"}
    row = {"title": "x", "status": "WIP", "genre": ["a", "b"]}
    lines = "title=>x=>y&&status==In-Progress\nstatus=>^WIP$=>In-Progress"
    assert shown(spark, row, kinds, replace=lines)["title"] == "y"
    assert shown(spark, row, kinds, replace="title=>x=>y&&status==Completed")["title"] == "x"
    assert shown(spark, row, kinds, replace="title=>x=>y&&title==never")["title"] == "y"
    assert shown(spark, row, kinds, replace="title=>x=>y&&genre!~^a")["title"] == "x"
    assert shown(spark, row, kinds, exclude_pre="title==x")["title"] == ""


def test_unions_and_joined_lists(spark):
    df = spark.createDataFrame([(["b"], ["a"])], "one array<string>, two array<string>")
    out = engine.present(df, language.parse(), ["one", "two"], unions={"all": ["one", '"c"', "two"]})
    assert out.first()["all"] == ["a", "b", "c"]
    joined = engine.joined_list(out, language.parse(replace="all_LIST=>,\\s=>;"), "all")
    assert out.select(joined.alias("x")).first().x == "a;b;c"


def test_patterns_without_java_form_are_interpreted(spark):
    rule = "title=>^(a)?b(?(1)c|d)$=>hit"
    assert not engine.is_columnar(language.parse(replace=rule), "title")
    for text, want in (("abc", "hit"), ("bd", "hit"), ("abd", "abd")):
        assert shown(spark, {"title": text}, {"title": "string"}, replace=rule)["title"] == want


def test_split_parts_run_the_program_again():
    program = language.parse(replace="a=>b\nk=>^(\\w)-(.*)$=>\\1\\,\\2\nb=>c")
    assert engine.interpret(program, "k", "a-a-x", {}) == ["c", "c-x"]


def test_chapter_text_rules(spark):
    df = spark.createDataFrame([("One  two",)], "t string")
    assert df.select(engine.chapter_text(F.col("t"), "\\s+=>\\s\ntwo=>2").alias("t")).first().t == "One 2"


@pytest.mark.parametrize("line", ["no operator here", "=>"])
def test_bad_lines_are_errors(line):
    with pytest.raises(ValueError):
        language.parse_filters("no operator here")
    with pytest.raises(ValueError):
        language.parse_replacements("only a regex")


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="abc $\\1", max_size=6), min_size=1, max_size=8), st.sampled_from(["(a)=>\\1\\1", "b+=>$", "k=>c=>a\na=>b", "k=>^a=>z&&other==on", "k=>(?P<x>b)=>\\g<x>\\g<x>"]))
def test_columns_equal_the_interpreter(spark, values, lines):
    program = language.parse(replace=lines, exclude_post="k==z")
    assert engine.is_columnar(program, "k")
    df = spark.createDataFrame([(values, "on")], "k array<string>, other string")
    got = engine.present(df, program, ["k", "other"]).first().k
    want = {y for x in values for y in engine.interpret(program, "k", x, {"other": ["on"]}) if y}
    assert got == sorted(want)


def both_ways(spark, line, texts, more=0):
    """What a rule makes of texts as a Column, and by Python's own ``re``."""
    rule = language.parse_replacements(line)[0]
    found = language.java(rule)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.t for r in df.select("i", F.regexp_replace("t", *found).alias("t")).orderBy("i").collect()]
    return got, [re.sub(rule.regex, rule.parts[0], t, flags=re.S) for t in texts]


TEXTS = ["ab", "a[b", "a&b", "x12y", "aa bb", "]", "^", "$1", "tail\n", "é a\\b"]


def test_replacements_mean_the_same_in_both_languages(spark):
    lines = [r"(\w)(\w)=>\g<2>\g<1>", r"(?P<head>a)b?=>[\g<head>]", r"a=>x\ny", r"a=>\\1", r"[a&b]+=>-", r"[^[]+=>-", r"[]a]=>-", r"(a)=>\g<1>2", r"(x)1=>\g<1>1$0", r"l$=>L", r"b{,1}=>.", r"[\[&]=>\t"]
    for line in lines:
        got, want = both_ways(spark, line, TEXTS)
        assert got == want, line


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["a", "[ab]", "[^&]", "(b|[[x])", "(\\w)", "\\.", "a*", "[a&x]"]), min_size=1, max_size=3), st.lists(st.sampled_from(["x", "\\n", "\\\\", "$", "1", "\\g<0>"]), min_size=1, max_size=3))
def test_generated_replacements_mean_the_same(spark, regex, to):
    got, want = both_ways(spark, "".join(regex) + "=>" + "".join(to), TEXTS)
    assert got == want


def test_long_programs_give_what_short_ones_do(spark):
    df = spark.createDataFrame([(["a&b", "ab", "x[y"], "t")], "genre array<string>, title string")
    shown = []
    for lines in (99, 101):
        more = "".join(f"genre=>none{i}=>n\n" for i in range(lines - 3))
        program = language.parse(replace=more + "genre=>a=>x\\ny\ngenre=>[a&b]+=>-\ngenre=>(b)=>\\g<1>2\n")
        shown.append(engine.present(df, program, ["genre", "title"]).first())
    assert shown[0] == shown[1]


def test_chapter_rules_without_a_java_form(spark):
    df = spark.createDataFrame([("aa b",)], "t string")
    assert df.select(engine.chapter_text(F.col("t"), r"(?P<c>a)(?P=c)=>x")).first()[0] == "x b"
