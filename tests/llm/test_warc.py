import duckdb

from storyflow.llm import warc

from . import cases

PAGES = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 5)) for i in range(1200)] + [(3, None, None), (3, None, None), (None, "u", "é"), (None, None, None)]
SCHEMA = "page_id bigint, url string, html string, archive string, node string, digest string"


def pages(spark, rows):
    if not rows:
        return spark.createDataFrame([], SCHEMA)
    return spark.createDataFrame([(*r, "a", "n", "d") for r in rows], SCHEMA)


def test_query_equals_sql(spark, small):
    small = small.replace("sf0.001", "sf0.1")
    got = warc.op6_warc(spark, small)
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{small}/pages.parquet'")
    want = db.sql(warc.SQL)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def audited(spark, ours, theirs):
    return warc.audited(*(warc.records(pages(spark, rows)) for rows in (ours, theirs))).collect()


def test_equal_replicas_have_no_differences(spark):
    assert audited(spark, PAGES, PAGES[::-1]) == []
    assert warc.index(warc.records(pages(spark, PAGES))).selectExpr("sum(records)").first()[0] == len(PAGES)


def test_audit_locates_each_kind_of_damage(spark):
    hurt = [(i, u, "X" + h[1:] if i == 701 else h) for i, u, h in PAGES if i != 1199] + [(2000, "new", "page")]
    got = {(r.status, r.page_id, r.length_a is None, r.length_b is None) for r in audited(spark, PAGES, hurt)}
    assert got == {("changed", 701, False, False), ("missing", 1199, False, True), ("extra", 2000, True, False)}


def test_a_lost_record_is_one_row_and_offsets_follow_from_the_records(spark):
    rows = [(i, "u", "x" * i) for i in range(512)]
    lost = [r for r in rows if r[0] != 40]
    lost[200] = (201, "u", "y")
    got = {r.page_id: r for r in audited(spark, rows, lost)}
    assert {i: r.status for i, r in got.items()} == {40: "missing", 201: "changed"}
    sizes = {r.page_id: len(r.record.encode()) for r in warc.records(pages(spark, rows)).collect()}
    at = sum(sizes[i] for i in range(201))
    assert (got[201].offset_a, got[201].offset_b, got[40].offset_b) == (at, at - sizes[40], None)
    assert (got[40].offset_a, got[40].length_a) == (sum(sizes[i] for i in range(40)), sizes[40])


def test_repeated_rows_of_a_page_count(spark):
    rows = [(5, "u", "a"), (5, "u", "a"), (5, "u", "b"), (6, "u", "c")]
    assert [(r.page_id, r.status, r.records_a, r.records_b) for r in audited(spark, rows, rows[1:])] == [(5, "changed", 3, 2)]
    assert [(r.page_id, r.status) for r in audited(spark, rows, [rows[0], *rows[2:], rows[2]])] == [(5, "changed")]


def test_pages_without_an_id_and_empty_tables(spark, tmp_path):
    assert {(r.page_id, r.status) for r in audited(spark, PAGES, PAGES[:-1])} == {(None, "missing")}
    assert warc.op6_warc(spark, cases.store(pages(spark, PAGES[:1]).where("false"), tmp_path / "a", "pages")).count() == 0
    assert {r.status for r in audited(spark, PAGES, [])} == {"missing"} and {r.status for r in audited(spark, [], PAGES)} == {"extra"}


def test_negative_ids_and_none_are_kept_apart(spark):
    rows = [(-5, "u", "five"), (-1, "u", "one"), (0, "u", "zero"), *[(None, f"n{i}", "none") for i in range(2500)]]
    hurt = [(-5, "u", "changed"), *rows[1:]]
    assert [(r.page_id, r.status, r.records_a, r.records_b) for r in audited(spark, rows, hurt)] == [(-5, "changed", 1, 1)]
    assert {(r.page_id, r.status) for r in audited(spark, rows, rows[:3])} == {(None, "missing")}
    assert sum(r.records_a for r in audited(spark, rows, rows[:3])) == 2500


def test_wide_ids_have_a_short_plan(spark):
    rows = [(1, "u", "a"), (2**60 + 7, "u", "b"), (-(2**63), "u", "c"), (2**63 - 1, "u", "d")]
    found = warc.audited(*(warc.records(pages(spark, r)) for r in (rows, [*rows[:1], (2**60 + 7, "u", "x"), *rows[2:]])))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    row = found.first()
    size = {r[0]: spark.range(1).select(warc.F.octet_length(warc.record(*(warc.F.lit(x) for x in r)))).first()[0] for r in rows}
    assert found.count() == 1 and (row.page_id, row.status, row.offset_a) == (2**60 + 7, "changed", size[-(2**63)] + size[1])
