import base64
import hashlib

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from storyflow.llm import bpe
from storyflow.shared import table

from . import cases

VOCABULARY = bpe.Vocabulary.load(public_tokenizers.path(bpe.VOCABULARY))
OWN = bpe.Tokenizer(VOCABULARY, public_tokenizers.PATTERN)
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(zip(VOCABULARY.keys, VOCABULARY.ids)), special_tokens={})


def check(rows, texts):
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = PLAIN.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_the_library(spark, small):
    texts = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    got = bpe.op7_bpe(spark, small).collect()
    assert len(got) == len(texts)
    check(got, texts)


def test_edge_rows(spark, tmp_path):
    got = bpe.op7_bpe(spark, cases.store(cases.rows(spark), tmp_path / "a")).collect()
    assert len(got) == len(cases.ROWS)
    check([r for r in got if r.doc_id is not None], {i: t for i, t, _ in cases.ROWS})
    assert bpe.op7_bpe(spark, cases.store(cases.empty(spark), tmp_path / "b")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_round_trip_and_library(text):
    ids = OWN.encode(text.encode("utf-8", "replace"))
    assert ids == PLAIN.encode_ordinary(text.encode("utf-8", "replace").decode())
    assert OWN.decode(ids) == text.encode("utf-8", "replace")


def test_perfect_hash_is_minimal_and_exact():
    hash_ = VOCABULARY.hash
    assert sorted(hash_.slots) == list(range(len(VOCABULARY.keys)))
    assert all(VOCABULARY.keys[hash_.slot(k)] == k for k in VOCABULARY.keys)
    assert VOCABULARY.id(b"no such token at all") is None


def test_repeated_bytes_merge_from_the_left():
    for n in (1, 2, 3, 7, 64, 1001):
        assert OWN.encode(b"a" * n) == PLAIN.encode_ordinary("a" * n)


def test_encoder_and_decoder_columns(spark):
    df = spark.createDataFrame([("héllo wörld",), (None,), ("",)], "text string")
    ids = df.select(bpe.encoder(spark)(bpe.F.col("text")).alias("ids"))
    got = [bytes(r.b).decode() for r in ids.select(bpe.decoder(spark)(bpe.F.col("ids")).alias("b")).collect()]
    assert got == ["héllo wörld", "", ""]


def test_a_worker_follows_the_vocabulary(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abab")], "doc_id bigint, text string")
    for k, pair in enumerate(("ab", "ba")):
        lines = [b"%s %d" % (base64.b64encode(t), i) for i, t in enumerate([b"a", b"b", pair.encode(), b"zz"])]
        (tmp_path / f"{k}.tiktoken").write_bytes(b"\n".join(lines))
        ids = docs.select(bpe.encoder(spark, str(tmp_path / f"{k}.tiktoken"))("text").alias("ids")).first().ids
        assert ids == [[2, 2], [0, 2, 1]][k]


def test_an_empty_vocabulary_knows_no_token():
    assert bpe.Vocabulary({}).id(b"a") is None
