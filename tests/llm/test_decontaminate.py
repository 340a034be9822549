import duckdb
import hashlib
import re

from storyflow.llm import decontaminate
from storyflow.shared import table

from . import cases

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain(texts, items, size=10):
    known = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            known.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in known}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit.update(range(i, i + n))
                    found |= {str(x) for x in known[tuple(w[i : i + n])] if x is not None}
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark, small):
    texts = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    want = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in plain(texts, items)]
    got = sorted((tuple(r) for r in decontaminate.op4_decontaminate(spark, small).collect()), key=repr)
    assert got == sorted(want, key=repr) and any(r[2] for r in got)


ITEMS = [
    (1, "sat on the mat and looked at the other cat all day long indeed"),
    (2, "Brown FOX"),
    (2, "Brown FOX"),
    (3, None),
    (4, "... !"),
    (None, "gato estaba"),
    (10, "día"),
    (5, "dog again and again and again the quick brown fox jumps over"),
    (6, "été"),
    (7, "brown fox"),
]


def items(spark):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in ITEMS], "item_id bigint, text string, gram string, doc_id string, n int")


def test_edge_rows_by_both_ways(spark):
    want = plain([(i, t) for i, t, _ in cases.ROWS], ITEMS)
    assert rows_of(decontaminate.contamination(cases.rows(spark), items(spark))) == want
    assert rows_of(decontaminate.contamination(cases.rows(spark), items(spark), max_windows=0)) == want
    assert sum(r[2] > 0 for r in want) >= 4


def test_empty_tables(spark):
    none = items(spark).where("item_id > 99")
    assert rows_of(decontaminate.contamination(cases.rows(spark), none)) == plain([(i, t) for i, t, _ in cases.ROWS], [])
    assert rows_of(decontaminate.contamination(cases.rows(spark), none, max_windows=-1)) == plain([(i, t) for i, t, _ in cases.ROWS], [])
    assert decontaminate.contamination(cases.empty(spark), items(spark)).count() == 0


def test_clean_drops_hit_rows_only(spark):
    kept = decontaminate.clean(cases.rows(spark), items(spark))
    assert kept.columns == cases.rows(spark).columns
    hit = {t for (_, t, _) in cases.ROWS if plain([(0, t)], ITEMS)[0][2]}
    assert sorted(r.text or "" for r in kept.collect()) == sorted(t or "" for _, t, _ in cases.ROWS if t not in hit)


def test_lowering_leaves_other_letters(spark):
    df = spark.createDataFrame([("ÀÉ Ab",), ("AB",), (None,)], "text string")
    assert [r[0] for r in df.select(decontaminate.lowered(decontaminate.F.col("text"))).collect()] == ["ÀÉ ab", "ab", None]


def test_main_path_runs_no_python(spark, small):
    plan = decontaminate.op4_decontaminate(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query_equals_sql(spark, small):
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"create view {name} as select * from '{small}/{name}.parquet'")
    want, got = db.sql(decontaminate.SQL), decontaminate.op4_decontaminate(spark, small)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())


def test_texts_beyond_the_broadcast_bounds(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_TEXTS", 0)
    monkeypatch.setattr(decontaminate, "MAX_BYTES", 0)
    hit = {t for (_, t, _) in cases.ROWS if plain([(0, t)], ITEMS)[0][2]}
    kept = decontaminate.clean(cases.rows(spark), items(spark))
    assert sorted(r.text or "" for r in kept.collect()) == sorted(t or "" for _, t, _ in cases.ROWS if t not in hit)
