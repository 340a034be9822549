import re

from storyflow.llm import urlfilter
from storyflow.shared import table

from . import cases

RULES = [("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "net", "/")]


def plain(url):
    url, host, path = url or "", "", ""
    if "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def check(got, urls):
    for r in got:
        host, path, rule, verdict = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_query_equals_brute_force(spark, small):
    small = small.replace("sf0.001", "sf0.01")
    urls = {r.page_id: r.url for r in table(spark, small, "pages").collect()}
    got = urlfilter.op9_urls(spark, small).collect()
    assert len(got) == len(urls)
    check(got, urls)


URLS = [None, "", "no scheme", "http://", "http://NET/", "HTTP://a.Example.NET/en/x?y", "http://example.net", "https://evilexample.net/en/", "x://h?q://z/a", "http://a.org/fr/#x", "http://a.org/FR/", "http://ÀB.org/\n/fr/", "http://u" + "v" * 30000 + ".net/", "http://NET/", "http://example.com/de/", "http://example.com/fr/"]


def test_edge_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, u, "h", "r", "v", 1.0) for i, u in enumerate(URLS)], "page_id bigint, url string, host string, rule string, verdict string, allowed double")
    got = urlfilter.op9_urls(spark, cases.store(df, tmp_path / "a", "pages")).collect()
    assert len(got) == len(URLS)
    check(got, dict(enumerate(URLS)))
    assert urlfilter.op9_urls(spark, cases.store(df.where("false"), tmp_path / "b", "pages")).count() == 0
    alone = urlfilter.judge(df.where("page_id in (0, 1, 2)")).collect()
    assert {(r.verdict, r.score) for r in alone} == {("allow", 0.0)}


def test_model_separates_what_it_learned(spark):
    good = [(f"http://site{i}.example.org/books/{i}", True) for i in range(300)]
    bad = [(f"http://win-casino{i}.example.org/bets?id={i}", False) for i in range(300)]
    model, threshold = urlfilter.train(spark.createDataFrame(good + bad, "url string, allowed boolean"))
    scores = model.score([b"http://site777.example.org/books/9", b"http://win-casino999.example.org/bets?id=1"])
    assert scores[0] > threshold > scores[1]
    assert model.score([None, b""]).tolist() == [model.score([b""])[0]] * 2


def test_order_zero_counts(spark):
    model, _ = urlfilter.train(spark.createDataFrame([("ab", True)] * 5, "url string, allowed boolean"))
    kept = model.counts[1, 1].sum()
    assert kept in (0, 5 * 3 * (urlfilter.ORDER + 1)) and model.counts[0].sum() == 0
