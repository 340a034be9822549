import duckdb
import hashlib

from hypothesis import given
from hypothesis import strategies as st

from storyflow.llm import chat
from storyflow.shared import table

from . import cases

ODD = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def plain(rows):
    turns = {}
    for conv, turn, role, text in rows:
        turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, found in turns.items():
        found.sort()
        loss = "".join(t for *_, r, t in found if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in found)
        out[conv] = (len(found), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.render(r, t)[0]) for *_, r, t in found))
    return out


def found(df):
    rows = df.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: tuple(r)[1:] for r in rows}


def test_query_equals_brute_force(spark, small):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, small, "conversations").collect()]
    assert found(chat.op8_chat(spark, small)) == plain(rows + ODD)


ROWS = [
    (1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, 1, "assistant", "<|end|>\n<|turn|>x\\"),
    (2, None, None, ""), (2, 0, "<tool>\n", "[INST] \\e \\l é😀"), (None, 3, "assistant", "b"), (None, 3, "user", cases.LONG), (3, 5, "assistant", "z" * 9),
]


def test_edge_rows(spark, tmp_path):
    df = spark.createDataFrame([(*r, "m", "s", "k") for r in ROWS], "conv_id bigint, turn bigint, role string, text string, msg string, seq string, kind string")
    got = found(chat.op8_chat(spark, cases.store(df, tmp_path / "a", "conversations")))
    want = plain(ROWS + ODD)
    assert got == want
    none = found(chat.op8_chat(spark, cases.store(df.where("false"), tmp_path / "b", "conversations")))
    assert none == plain(ODD)


def test_events_fold_into_the_final_text(spark):
    log = [(1, 1, k, kind, role, text) for k, (kind, role, text) in enumerate([("open", "assistant", None), ("delta", None, "dra"), ("delta", None, "ft"), ("regenerate", None, None), ("delta", None, "x"), ("edit", None, "fin"), ("delta", None, "al"), ("delta", None, None)])]
    log += [(1, 2, 0, "delta", None, "orphan")]
    df = spark.createDataFrame(log[::-1], "conv_id bigint, msg bigint, seq int, kind string, role string, text string")
    segments = chat.reconstruct(df).orderBy("part").collect()
    assert [chat.read(s.segment) for s in segments] == [("assistant", "final"), ("", "orphan")]
    assert segments[0].segment[segments[0].loss_start : segments[0].loss_end] == "final" and segments[1].loss_start == segments[1].loss_end


def test_events_delivered_again_count_once_and_ties_have_an_order(spark):
    log = [(1, 1, 1, "open", "user", None), (1, 1, 2, "delta", None, "hi"), (1, 1, 2, "delta", None, "hi"), (1, 1, 3, "delta", None, "b"), (1, 1, 3, "delta", None, "a"), (1, 1, 1, "open", "user", None)]
    for rows in (log, log[::-1]):
        df = spark.createDataFrame(rows, "conv_id bigint, msg bigint, seq int, kind string, role string, text string")
        assert [chat.read(s.segment) for s in chat.reconstruct(df).collect()] == [("user", "hiab")]


def test_query_equals_sql(spark, small):
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{small}/conversations.parquet'")
    want, got = db.sql(chat.SQL), chat.op8_chat(spark, small)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


@given(st.text(alphabet="\\<[elbab|turnd>\n]/INSTé", max_size=40), st.sampled_from(["user", "assistant", "sys<tem", "", "a\n\\n"]))
def test_rendering_is_reversible(text, role):
    segment, start, end = chat.render(role, text)
    assert chat.read(segment) == (role, text) and "[INST]" not in segment and "</s>" not in segment
    assert chat.unescape(segment[start:end]) == (text if role == "assistant" else "")
