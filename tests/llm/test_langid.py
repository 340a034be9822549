import zlib

from storyflow.llm import langid
from storyflow.shared import table

from . import cases


def test_held_out_accuracy(spark, small):
    small = small.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r.lang for r in table(spark, small, "documents").collect()}
    got = langid.op3_langid(spark, small).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    mine = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert sum(mine) / len(mine) > 0.98


def test_edge_rows(spark, tmp_path):
    got = langid.op3_langid(spark, cases.store(cases.rows(spark), tmp_path / "a")).collect()
    assert len(got) == len(cases.ROWS)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (4, 5, 7, 8)] == ["und"] * 4 and by[8].score == 0
    assert by[9].lang_pred == "en" and {r.lang_pred for r in got} <= {"en", "es", "und"}
    assert not [r for r in got if r.doc_id is None and r.held_out]
    assert langid.op3_langid(spark, cases.store(cases.empty(spark), tmp_path / "b")).count() == 0


def test_without_labels_everything_is_undetermined(spark):
    model = langid.train(cases.rows(spark).where("lang = 'none'"))
    got = cases.rows(spark).select(langid.predict(spark, model)(langid.F.col("text")).alias("r")).collect()
    assert model is None and {(r.r.lang_pred, r.r.score) for r in got} == {("und", 0.0)}


def test_counts_equal_a_plain_count(spark):
    rows = cases.rows(spark)
    model = langid.train(rows)
    found, of, _ = langid.grams([t.encode() for _, t, lang in cases.ROWS if lang == "es" and t])
    again = [langid.grams([t.encode()])[0] for _, t, lang in cases.ROWS if lang == "es" and t]
    assert sorted(found.tolist()) == sorted(x for g in again for x in g.tolist())
    assert model.langs == ["en", "es"]
