import datetime

from pyspark.sql import functions as F

from storyflow.operators import keys, library, listing, lookups, positions


def test_listing_against_old_output(spark):
    new = spark.createDataFrame([("u1", 1), ("u2", 2), ("u3", 3)], "url string, number int")
    old = spark.createDataFrame([("u1", 1, "first", "a", "a"), ("u1", 2, "second", "a", "a"), ("u2", 3, "x", "a", "(new) a")], "url string, pos int, html string, origtitle string, title string")
    got = {r.url: (r.old_html, r.fetch, r.is_new) for r in listing.merged(new, old).collect()}
    assert got == {"u1": ("first", False, False), "u2": ("x", False, True), "u3": (None, True, True)}
    assert [r.fetch for r in listing.merged(new, old, reload_first=True).orderBy("number").collect()] == [True, False, True]


def test_chapters_are_new_only_against_earlier_output(spark):
    new = spark.createDataFrame([("s", "u1", 1), ("s", "u2", 2), ("t", "v1", 1)], "story string, url string, number int")
    old = spark.createDataFrame([("s", "u1", 1, "x", "a", "a")], "story string, url string, pos int, html string, origtitle string, title string")
    got = {r.url: r.is_new for r in listing.merged(new, old, story="story").collect()}
    assert got == {"u1": False, "u2": True, "v1": False}
    assert not any(r.is_new for r in listing.merged(new, old.where("false")).collect())
    assert not any(r.is_new for r in listing.merged(new, old, mark_new=False).collect())
    assert {r.url: r.is_new for r in listing.merged(new, old.where("url = 'none'").unionByName(old), reload_first=True).collect()}["v1"] is False
    twice = old.select("story", F.col("pos").alias("number"), "html").unionByName(spark.createDataFrame([("s", 1, "b")], "story string, number int, html string"))
    assert sorted((r.story, r.number, r.old_html, r.is_new) for r in listing.merged_by_place(new, twice).collect()) == [("s", 1, "b", False), ("s", 2, None, True), ("t", 1, None, False)]


def test_long_chains_of_redirects_end(spark):
    moves = spark.range(1, 61).selectExpr("id as url", "id - 1 as location").unionByName(spark.createDataFrame([(100, 101), (101, 100), (99, 100)], "url bigint, location bigint"))
    start = spark.createDataFrame([(i,) for i in (0, 40, 59, 60, 99, 100, 7000)], "url bigint")
    assert {r.url: r.final_url for r in lookups.redirects(spark, start, moves).collect()} == {0: 0, 40: 0, 59: 0, 60: 0, 99: None, 100: None, 7000: 7000}


def test_many_redirects_are_not_broadcast(spark, monkeypatch):
    moves = spark.range(1, 61).selectExpr("id as url", "id - 1 as location")
    monkeypatch.setattr(lookups, "SMALL", 10)
    ends = lookups.redirects(spark, spark.range(70).withColumnRenamed("id", "url"), moves)
    assert "BroadcastExchange" not in ends._jdf.queryExecution().executedPlan().toString()
    assert {r.url: r.final_url for r in ends.collect()} == {i: 0 if i <= 60 else i for i in range(70)}


def test_update_decisions(spark):
    rows = spark.createDataFrame([(3, 3), (5, 3), (0, 3), (2, 3)], "o int, n int")
    assert [r.d for r in rows.select(listing.decision(F.col("o"), F.col("n")).alias("d")).collect()] == ["skip", "warn", "refuse", "update"]
    assert [r.d for r in rows.select(listing.decision(F.col("o"), F.col("n"), True, True).alias("d")).collect()] == ["update"] * 4
    assert spark.createDataFrame([(0, 0)], "o int, n int").select(listing.decision(F.col("o"), F.col("n"), True).alias("d")).first().d == "refuse"
    for mode, want in (("skip", "skip"), ("update", "skip"), ("overwrite_always", "overwrite"), ("add_new", "add")):
        assert rows.limit(1).select(listing.collision(mode, F.lit(True), F.lit(False)).alias("d")).first().d == want
    assert rows.limit(1).select(listing.collision("update", F.lit(False), F.lit(False)).alias("d")).first().d == "add"


def test_links_and_images(spark):
    chapters = spark.createDataFrame([(1, "u1", "f1", '<a href="u2">x</a><a href="other">y</a>'), (1, "u2", "f2", '<a href="u1"></a>'), (2, "u1", "g1", '<a href="u2">')], "story int, url string, file string, html string")
    got = {(r.story, r.url): r.html for r in listing.relinked(chapters, "story", "url", "file", "html").collect()}
    assert got == {(1, "u1"): '<a href="f2">x</a><a href="other">y</a>', (1, "u2"): '<a href="f1"></a>', (2, "u1"): '<a href="u2">'}
    new = spark.createDataFrame([("a", None), ("b", "n2"), ("c", None)], "url string, uuid string")
    old = spark.createDataFrame([("a", "n1", "s1", True), ("z", "n2", "s2", True), ("c", "n3", "s3", False)], "url string, uuid string, newsrc string, used boolean")
    assert {r.url: r.newsrc for r in listing.images_carried(new, old).collect()} == {"a": "s1", "b": "s2", "c": None}


def test_keep_first_and_longest(spark):
    rows = spark.createDataFrame([("k", "ab", 2), ("k", "cd", 1), ("k", "c", 0), (None, "x", 5), (None, "y", 4)], "k string, t string, pos int")
    assert {r.k: r.t for r in keys.first_by(rows, ["k"], F.col("pos")).collect()} == {"k": "c", None: "y"}
    assert {r.k: r.t for r in keys.longest_first(rows, ["k"], "t", "pos").collect()} == {"k": "cd", None: "y"}


def test_library(spark):
    books = spark.createDataFrame([("https://a/1", "T", "A"), ("https://a/9", "Old", "B"), ("x", "N", "N")], "url string, title string, author string")
    owned = spark.createDataFrame([(1, "http://a/1", "other", "o"), (2, "q", "OLD", "b")], "book_id int, url string, title string, author string")
    assert {(r.url, r.book_id, r.matched_by) for r in library.matched(books, owned).collect()} == {("https://a/1", 1, "url"), ("https://a/9", 2, "title"), ("x", None, "none")}
    changes = spark.createDataFrame([(2, "new", "t", "a"), (3, "n", "t", "a")], owned.schema)
    assert sorted((r.book_id, r.url) for r in library.upserted(owned, changes).collect()) == [(1, "http://a/1"), (2, "new"), (3, "n")]
    assert sorted(r.book_id for r in library.reading_list(owned, changes, owned.where("book_id = 1")).collect()) == [2, 3]
    rows = spark.createDataFrame([(None, True, "e"), ("old", False, ""), (None, False, "")], "o string, failed boolean, m string")
    assert [r.c for r in rows.select(library.error_column(F.col("o"), F.col("failed"), F.col("m")).alias("c")).collect()] == ["e", None, None]


def test_lookups(spark):
    objects = spark.createDataFrame([("a", "b", "A"), ("b", None, "B"), ("c", "zz", "C")], "key string, ref string, body string")
    assert {r.key: r.target for r in lookups.dereferenced(objects, "ref").collect()} == {"a": "B", "b": None, "c": None}
    rows = spark.createDataFrame([(["x views", "words"], ["10", "20"])], "h array<string>, v array<string>")
    pairs = F.transform(F.arrays_zip("h", "v"), lambda z: F.struct(z["h"].alias("header"), z["v"].alias("value")))
    assert rows.select(lookups.stat(pairs, "views").alias("s"), lookups.stat(pairs, "none").alias("n")).first() == ("10", None)
    res = spark.createDataFrame([(1, "k", 7, 10), (2, "k", 7, 20), (3, "k", 8, 99)], "res_id int, cache_key string, cache_key_hash int, last_used int")
    blobs = spark.createDataFrame([(1, "old"), (2, "new"), (3, "no")], "res_id int, blob string")
    assert lookups.blob_join(res, blobs, F.lit(7)).first().blob == "new"
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")], "url string, location string")
    ends = {r.url: r.final_url for r in lookups.redirects(spark, spark.createDataFrame([("a",), ("c",), ("q",)], "url string"), loop).collect()}
    assert ends["c"] == "d" and ends["q"] == "q" and ends["a"] is None


def test_positions(spark):
    rows = spark.createDataFrame([(1, 1, 1, "A"), (1, 2, 2, "B"), (1, 3, 0, None), (1, 4, 1, "C"), (1, 5, 0, None), (1, 6, 2, "D")], "s int, pos int, level int, title string")
    assert [r.path for r in positions.sections(rows, "s", "pos", "level", "title").orderBy("pos").collect()] == ["A", "A / B", "A / B", "C", "C", "C / D"]
    big = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("r"))
    placed = positions.placed(big, "r")
    assert placed.where("place <> r + 1").count() == 0 and placed.count() == 1000
    assert positions.placed(big.where("r < 0"), "r").count() == 0
    w = positions.last_values(spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], "k string, v int, o int"), ["k"], "v", F.col("o"))
    assert w.first().v == 2
    assert datetime.date


def test_covers_and_names(spark):
    from storyflow.operators import covers

    images = spark.createDataFrame([("http://a//b.png", 1, b"x"), ("http://c", 2, b"x"), ("data:image/png;base64,aGk=", 3, b"hi")], "url string, seq int, data binary")
    got = {r.seq: (r.src, r.name) for r in covers.named(images).collect()}
    assert got[1][1] == got[2][1] != got[3][1] and got[1][0] == "http://a/b.png" and got[3][0].startswith("file:///")


def test_site_steps(spark):
    from storyflow.operators import sites

    def one(column, x):
        return spark.createDataFrame([(x,)], "x string").select(column.alias("r")).first().r

    c = F.col("x")
    assert one(sites.without_notes(c, ["note"]), 'a<div class="q note">b</div><div>c</div>') == "a<div>c</div>"
    assert one(sites.plain_elements(c, ["p", "i"]), "<p>a<!-- c --><odd-tag x='1'>b</odd-tag><i>c</i></p>") == "<p>a<span>b</span><i>c</i></p>"
    quoted = '<div class="bbCodeBlock--quote">q</div><div class="bbCodeSpoiler">s</div><iframe>x</iframe>'
    assert one(sites.forum_markup(c, "drop"), quoted) == "<blockquote>q</blockquote>"
    assert one(sites.forum_markup(c, "open"), quoted) == "<blockquote>q</blockquote>s"
    assert one(sites.forum_markup(c), '<img class="l" src="blank" data-src="real">') == '<img class="l" src="real">'
    assert one(sites.route(F.lit(2), F.create_map(F.lit("2"), F.lit("r"))), "") == "r"
    links = spark.createDataFrame([("http://s/7/old",), ("http://s/about",)], "url string")
    known = spark.createDataFrame([("http://s/chapter/7/new",)], "url string")
    assert sorted(r.url for r in sites.canonical_chapters(links, known).collect()) == ["http://s/about", "http://s/chapter/7/new"]
    parts = spark.createDataFrame([("chapter", "t", "b", None), ("choice", "t", None, ["x", "y"]), ("post", "t", "p", None), ("odd", "t", None, None), ("chapter", "#special", "z", None)], "nt string, title string, body string, choices array<string>")
    assert [r.html for r in sites.rendered_parts(parts).collect()] == ["b", "<ul><li>x</li><li>y</li></ul>", "<blockquote>p</blockquote>", "<p>unknown part</p>"]
    ids = spark.createDataFrame([(1, "a"), (1, "z")], "story int, id string")
    assert {r.id: r.title for r in sites.achievements(ids, spark.createDataFrame([("a", "A")], "id string, title string"), "story").collect()} == {"a": "A", "z": "unknown achievement"}
