import datetime

import pytest
from pyspark.sql import functions as F

from storyflow import config
from storyflow.functions import binary, dates, text
from storyflow.operators import library, positions, siterules
from storyflow.operators.siterules import SiteRule

RULES = [
    SiteRule("www.a.org", r"https?://(?:www\.)?a\.org/s/(\d+)/([a-z]+)", "https://a.org/s/$1/$2", "https://a.org/s/$1"),
    SiteRule("a.org", r"https?://(?:www\.)?a\.org/t/(\d+)", "https://a.org/t/$1"),
    SiteRule("deep.a.org", r"http://deep\.a\.org/x", "http://deep.a.org/x"),
]


def test_site_rules(spark):
    urls = ["http://www.a.org/s/12/title?x=1", "https://a.org/t/9#p", "https://a.org/other", "http://deep.a.org/xyz", "http://deep.a.org/s/1/a", "http://b.org/", "no url", "", None]
    got = {r.url: (r.site, r.valid, r.canonical, r.section_url, r.section) for r in siterules.matched(spark.createDataFrame([(u,) for u in urls], "url string"), RULES).collect()}
    assert got == {
        "http://www.a.org/s/12/title?x=1": ("a.org", True, "https://a.org/s/12/title", "https://a.org/s/12", "https://a.org/s/12"),
        "https://a.org/t/9#p": ("a.org", True, "https://a.org/t/9", "https://a.org/t/9", "https://a.org/t/9"),
        "https://a.org/other": ("a.org", False, None, None, "a.org"),
        "http://deep.a.org/xyz": ("deep.a.org", True, "http://deep.a.org/x", "http://deep.a.org/x", "http://deep.a.org/x"),
        "http://deep.a.org/s/1/a": ("deep.a.org", False, None, None, "deep.a.org"),
        "http://b.org/": (None, False, None, None, "b.org"),
        "no url": (None, False, None, None, None),
        "": (None, False, None, None, None),
        None: (None, False, None, None, None),
    }


def test_one_row_per_url_for_many_sites(spark):
    rules = [SiteRule(f"s{i}.com", rf"http://s{i}\.com/{k}/(\d+)", f"http://s{i}.com/{k}/$1") for i in range(150) for k in "abc"]
    urls = spark.range(600).select("id", F.concat(F.lit("http://s"), F.col("id") % 200, F.lit(".com/b/"), F.col("id"), F.lit("/t")).alias("url"))
    found = siterules.matched(urls, rules)
    assert found.count() == 600 and found.where("valid").count() == 450
    assert "BroadcastHashJoin" in found._jdf.queryExecution().toString()
    assert found.where("id = 149").first().canonical == "http://s149.com/b/149"


def test_sections_of_a_configuration_are_renamed(spark):
    rows = config.as_rows(spark, "[http://www.a.org/s/12/old-title]\nk: 1\n[a.org]\nk: 2\n[https://b.org/1]\nk: 3\n")
    assert sorted((r.section, r.value) for r in siterules.renamed_sections(rows, RULES).collect()) == [("a.org", "2"), ("https://a.org/s/12", "1"), ("https://b.org/1", "3")]


@pytest.mark.parametrize(
    "text, form, want",
    [
        ("3 Jan 2020 12:05 pm", "%d %b %Y %I:%M %p", (12, 5, 3)),
        ("3 Jan 2020 12:05 am", "%d %b %Y %I:%M %p", (0, 5, 3)),
        ("3 Jan 2020 03:05PM", "%d %b %Y %I:%M%p", (15, 5, 3)),
        ("3 Jan 2020 15:05 pm", "%d %b %Y %I:%M %p", (15, 5, 3)),
        ("3 Jan 2020 12:05 pm", "%d %b %Y %H:%M %p", (0, 5, 4)),
        ("3 Jan 2020 12:05 am", "%d %b %Y %H:%M %p", (12, 5, 3)),
        ("nothing", "%d %b %Y %I:%M %p", None),
        (None, "%d %b %Y %I:%M %p", None),
    ],
)
def test_halves_of_a_day(spark, text, form, want):
    made = spark.createDataFrame([(text,)], "t string").select(dates.clock_parsed(F.col("t"), form).alias("d")).first().d
    assert (made and (made.hour, made.minute, made.day)) == want


def test_dates_of_several_forms(spark):
    now = F.to_timestamp(F.lit("2020-05-05 10:00:00"))
    rows = spark.createDataFrame([("2 days ago", 1), ("Jul 15, 2017", 2), ("2018-01-02", 3), ("soon", 4), (None, 5)], "t string, k int")
    got = [tuple(r.d) for r in rows.select(dates.mixed(F.col("t"), now, "%b %d, %Y", "%Y-%m-%d").alias("d")).collect()]
    assert got == [(datetime.datetime(2020, 5, 3, 10), "relative"), (datetime.datetime(2017, 7, 15), "%b %d, %Y"), (datetime.datetime(2018, 1, 2), "%Y-%m-%d"), (None, None), (None, None)]
    scripts = spark.createDataFrame([("x new Date(1500000000123)", "Jan 01, 2020"), ("none", "Jan 01, 2020"), (None, None)], "s string, t string")
    assert [r.d for r in scripts.select(dates.script_time(F.col("s"), F.col("t"), "%b %d, %Y").alias("d")).collect()] == [datetime.datetime(2017, 7, 14, 2, 40), datetime.datetime(2020, 1, 1), None]


def test_series_places_over_pages(spark):
    listed = spark.createDataFrame([("s", 1, 1, "/s/10/a"), ("s", 1, 2, "/other"), ("s", 2, 1, "/s/30/b"), ("t", 1, 5, "/s/30/b"), ("t", 1, 9, "/s/10/a")], "series string, page int, place int, link string")
    stories = spark.createDataFrame([(10,), (30,), (40,)], "story_id bigint")
    got = {r.story_id: (r.series, r.series_index) for r in positions.series_places(listed, stories, "series", "page", "place", "link", r"^/s/(\d+)/").collect()}
    assert got == {10: ("s", 1), 30: ("t", 1), 40: (None, None)}


def test_library_rows(spark):
    books = spark.createDataFrame([(1, False, False), (2, True, False), (3, False, True), (4, True, True), (5, None, None)], "book int, failed boolean, broken boolean")
    assert {r.book: r.mark for r in library.result_marks(books, "book", "failed", "broken").collect()} == {1: "fff_success_0000", 2: "fff_failed_0000", 3: "fff_chapter_error_0000", 4: "fff_chapter_error_0001", 5: "fff_success_0004"}
    shown = library.blanked(spark.createDataFrame([("u", "", None, "t")], "Username string, password string, totp string, title string")).first()
    assert tuple(shown) == ("(was set, removed for security)", "", None, "t")
    parts = [spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([], "k int, v string"), spark.createDataFrame([(2, 0.5)], "k int, w double")]
    assert [tuple(r) for r in library.in_launch_order(parts).orderBy("launched").collect()] == [(1, "a", 0, None), (2, None, 2, 0.5)]
    sums = spark.createDataFrame([(1, 2), (None, 3)], "a int, b int").select(library.counters_summed(F.col("a"), F.col("b")).alias("s"))
    assert [r.s for r in sums.collect()] == [3, None]


def test_cache_names(spark):
    row = spark.createDataFrame([("1/0/_dk_http://a http://a http://a/b",)], "k string").select(binary.simple_cache_name(F.col("k")).alias("s"), binary.firefox_cache_name(F.col("k")).alias("f")).first()
    import hashlib

    digest = hashlib.sha1(b"1/0/_dk_http://a http://a http://a/b").digest()
    assert row.s == digest[7::-1].hex() and row.f == digest.hex().upper()


def test_letters_and_long_numbers(spark):
    rows = spark.createDataFrame([("Любя, съешь щипцы, — вздохнёт мэр", "12345678901234567890"), ("Юля Йод їжа", "9,223,372,036,854,775,807"), ("", "none"), (None, None)], "t string, d string")
    assert [tuple(r) for r in rows.select(text.romanize(F.col("t")), text.digits(F.col("d"))).collect()] == [("Lyubya, s'iesh' shchiptsy, — vzdohniot mer", None), ("yulya yod yzha", 2**63 - 1), ("", None), (None, None)]


def test_values_of_site_entries_follow_their_sql(spark, tmp_path):
    from storyflow.plans import sites

    html = '<html lang="en"><title> a = &quot;b &amp; c </title><h1>x</h1><h1> </h1></html>'
    spark.createDataFrame([(1, "https://a.example.com/x", html)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sites.site_entries(spark, str(tmp_path)).collect() == [(1, "a = &quot;b & c", "en", 1)]
