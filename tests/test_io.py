import struct

import pytest
from pyspark.sql import functions as F

from storyflow import config
from storyflow.sinks import render
from storyflow.sources import readers
from storyflow.streaming import incremental, mail


def test_url_and_reject_lists(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# all\nhttp://a/1 # one\n\n http://b/2\n")
    assert sorted(r.url for r in readers.url_list(spark, f"file://{tmp_path}/urls.txt").collect()) == ["http://a/1", "http://b/2"]
    (tmp_path / "r.txt").write_text("http://a,Title by Auth - a note\nhttp://b,only a note\nhttp://c\nhttp://d,T, x by B\n")
    got = {r.url: (r.title, r.author, r.note) for r in readers.rejects(spark, f"file://{tmp_path}/r.txt").collect()}
    assert got == {"http://a": ("Title", "Auth", "a note"), "http://b": ("", "", "only a note"), "http://c": ("", "", ""), "http://d": ("T, x", "B", "")}


def test_books_round_trip(spark, tmp_path):
    stories = spark.createDataFrame([(1,)], "story bigint")
    chapters = spark.createDataFrame([(1, 1, "One & two", '<p>a</p><a href="http://s/1">l</a>'), (1, 2, "Three", "<p>b</p>")], "story bigint, number int, title string, html string")
    entries = render.epub_entries(stories, chapters, "story", "number", "title", "html")
    assert [r.path for r in entries.orderBy("seq").collect()][:1] == ["mimetype"] and entries.count() == 5
    data = bytes(render.zipped(entries, "story").first().data)
    assert data[30:38] == b"mimetype"
    (tmp_path / "b.epub").write_bytes(data)
    read = readers.books(spark, f"file://{tmp_path}/b.epub")
    got = [(r.number, r.name, r.html) for r in read.orderBy("number").collect()]
    assert got == [(1, "file0001.xhtml", '<p>a</p><a href="http://s/1">l</a>'), (2, "file0002.xhtml", "<p>b</p>")]
    assert readers.book_counts(read).first().chapters == 2
    assert readers.story_urls(read).first().url == "http://s/1"


def test_bodies_and_json(spark):
    chapters = spark.createDataFrame([(1, 2, "B", "<p>two</p>"), (1, 1, "A", "<p>one</p>")], "story bigint, pos int, title string, html string")
    assert render.writer("html")(chapters, "story", "pos", "title", "html").first().body == "<h3>A</h3>\n<p>one</p>\n<h3>B</h3>\n<p>two</p>"
    assert render.writer("txt")(chapters, "story", "pos", "title", "html").first().body == "\n\n\tA\n\none\n\n\n\tB\n\ntwo"
    stories = spark.createDataFrame([(1, "T")], "story bigint, title string")
    made = render.json_metadata(stories, chapters.select("story", "pos", "title"), "story", "pos").first().json
    assert made == '{"title":"T","zchapters":[{"pos":1,"title":"A"},{"pos":2,"title":"B"}]}'
    with pytest.raises(ValueError):
        render.writer("mobi")


def test_metadata_and_replies(spark):
    pages = spark.createDataFrame([(1, '<div class="metadata"><div class="int" id="n">1,200</div><div class="datetime" id="d">2020-01-02</div></div>', '{"a": 1, "b": ["x"]}'), (2, "", "broken")], "s int, html string, body string")
    rows = {r.entry: r for r in readers.metadata(pages, "s", "html").collect()}
    assert rows["n"].as_int == 1200 and rows["d"].as_date.year == 2020 and rows["n"].as_date is None
    assert {r.s: r.a for r in readers.replies(pages, "body", "a int, b array<string>").collect()} == {1: 1, 2: None}
    assert [r.page for r in readers.page_numbers(spark.createDataFrame([(3,)], "last int"), "last").collect()] == [1, 2, 3]
    made = {r.story_id: r for r in readers.test_stories(spark, 18, 21).collect()}
    assert made[19].status == "In-Progress" and made[19].series and not made[20].series and made[20].language == "Russian"


def test_cache_entries(spark, tmp_path):
    key, body, end = b"http://k", b"body bytes", struct.pack("<Q", 0xF4FA6F45970D41D8)
    simple = struct.pack("<QIII", 0xFCFB6D1BA7725C30, 5, len(key), 0) + b"\0" * 4 + key + body + end + b"\0" * 16 + b"HTTP/1.1 200" + end + b"\0" * 16
    (tmp_path / "a_0").write_bytes(simple)
    own = b"a,:http://f"
    fire = body + b"hash" + b"\0\0" + struct.pack(">IIIIIIII", 3, 1, 0, 0, 0, 0, len(own), 0) + own + b"\0" + b"head\0x\0" + struct.pack(">I", len(body))
    (tmp_path / "b_0").write_bytes(fire)
    (tmp_path / "c_0").write_bytes(b"neither")
    got = {r.key: bytes(r.body) for r in readers.cached_pages(spark, f"file://{tmp_path}/*_0").collect()}
    assert got == {"http://k": body, "http://f": body}


def test_mail(spark, tmp_path):
    (tmp_path / "m.eml").write_text('From: a@b\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary="x"\n\n--x\nContent-Type: text/plain\n\nsee http://a/1.\n--x\nContent-Type: text/html\n\n<a href="http://b/2?utm_source=m">b</a> <a href="/rel">c</a>\n--x--\n')
    mails = spark.read.format("binaryFile").load(f"file://{tmp_path}/*.eml")
    assert sorted(r.url for r in mail.urls_of(mails).collect()) == ["http://a/1", "http://b/2"]
    assert mail.mailbox(spark, f"file://{tmp_path}").isStreaming


def test_configuration(spark):
    low = "[defaults]\na: 1 ; note\nlist: x, y\\, z\n  ,w\nempty: \"\"\nflag: false\n# c\nrem x\n"
    high = "[site.com]\na = 2\nadd_to_list: ,site\n[overrides]\nadd_to_list: ,over\n"
    s = config.Settings([low, high], config.sections_for("www.site.com", "epub"), overrides={"b": "3"})
    assert (s.get("a"), s.get("b"), s.get("empty"), s.get("none", "d"), s.flag("flag")) == ("2", "3", "", "d", False)
    assert s.list("list") == ["x", "y, z", "w", "site", "over"]
    files = config.Settings(["[defaults]\nrules_filelist: f1, f2\nrules: inline\n"], ["defaults"], fetch=lambda n: {"f1": "from file"}[n] if n == "f1" else (_ for _ in ()).throw(OSError(n)))
    assert files.get("rules") == "from file"
    assert config.sections_for("s.com", "txt", "http://u", ("base",))[:4] == ["overrides", "http://u", "s.com:txt", "www.s.com:txt"]
    rows = config.as_rows(spark, "[defaults]\nok: yes\nodd: 1\n[nowhere]\nok: maybe\n")
    name = lambda col, *v: spark.createDataFrame([(x,) for x in v], f"{col} string")
    bad = config.problems(rows, name("section", "defaults"), name("key", "ok"), spark.createDataFrame([("ok", "yes")], "key string, value string"))
    assert sorted((r.line, r.error) for r in bad.collect()) == [(3, "unknown keyword: odd"), (5, "bad value: maybe"), (5, "unknown section: nowhere")]
    with pytest.raises(ValueError):
        config.parse("[a]\nnonsense\n")


def test_folds_give_the_same_over_many_batches(spark, tmp_path):
    rows = [(u, i, ("error", "view", "purchase")[(i * (u + 2) // 3) % 3]) for i in range(40) for u in range(3)]
    schema = "user_id bigint, event_id bigint, event_type string"
    for part in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 10 == part], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{part}")

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")

    log = incremental.log_differences(spark, f"file://{tmp_path}/log", "user_id", "event_type", "event_id")
    incremental.run(stream(), log)
    got = sorted((r.user_id, r.event_id) for r in spark.read.parquet(f"{log.path}/rows").collect())
    want = []
    for u in range(3):
        mine = [r for r in sorted(rows) if r[0] == u]
        want += [(u, b[1]) for a, b in zip([(u, -1, None), *mine], mine) if a[2] != b[2]]
    assert got == sorted(want)
    marked = stream().withColumns({"failed": F.col("event_type") == "error", "passed": F.col("event_type") == "purchase"})
    counters = incremental.retry_counters(spark, f"file://{tmp_path}/retry", "user_id", "event_id", "failed", "passed", limit=3)
    incremental.run(marked, counters)
    last = {r.user_id: (r.failures, r.tripped) for r in counters.state(3).collect()}
    for u in range(3):
        n, tripped = 0, False
        for _, _, kind in sorted(r for r in rows if r[0] == u):
            n = 0 if kind == "purchase" else n + (kind == "error")
            tripped |= n >= 3
        assert last[u] == (n, tripped)
