import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyflow.llm import pieces
from storyflow.shared import table

from . import cases

VOCABULARY = pieces.Vocabulary.load(public_tokenizers.path(pieces.MODEL))
OWN = pieces.Tokenizer(VOCABULARY)
PLAIN = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
SIGNS = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" ▁\n\t aé<0x>s中😀")), max_size=60)


def check(rows, texts):
    for r in rows:
        ids = PLAIN.encode(texts[r.doc_id] or "")
        assert r.checked and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(PLAIN.decode(ids).encode()).hexdigest()


def test_query_equals_the_library(spark, small):
    texts = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    got = pieces.op13_sentencepiece(spark, small).collect()
    assert len(got) == len(texts)
    check(got, texts)


def test_edge_rows(spark, tmp_path):
    got = pieces.op13_sentencepiece(spark, cases.store(cases.rows(spark), tmp_path / "a")).collect()
    assert len(got) == len(cases.ROWS) and all(r.checked for r in got)
    check([r for r in got if r.doc_id is not None], {i: t for i, t, _ in cases.ROWS})
    assert pieces.op13_sentencepiece(spark, cases.store(cases.empty(spark), tmp_path / "b")).count() == 0


@settings(max_examples=500, deadline=None)
@given(SIGNS)
def test_encoding_equals_the_library(text):
    ids = OWN.encode(text)
    assert ids == PLAIN.encode(text)
    assert OWN.decode(ids) == PLAIN.decode(ids)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.integers(0, len(VOCABULARY.pieces) - 1), st.integers(0, 262), st.sampled_from([28705, 259, 264])), max_size=12))
def test_any_ids_decode_as_in_the_library(ids):
    assert OWN.decode(ids) == PLAIN.decode(ids)


def test_long_segments_without_a_cut():
    for text in ("a" * 30_001, "ab" * 20_000, "=" * 10_000, "中文" * 5_000, " " * 5_000, "\n" * 3_000, "😀" * 2_000):
        assert OWN.encode(text) == PLAIN.encode(text)


def test_a_text_longer_than_a_chunk(spark):
    text = ("naïve words, x1 " * 20 + "0123456789abcdef" * 30) * 2_000
    assert len(text.encode()) > 1 << 20
    row = spark.createDataFrame([(1, text)], "doc_id bigint, text string").select("doc_id", pieces.digests(spark)(F.col("text")).alias("r")).select("doc_id", "r.*").first()
    check([row], {1: text})


def test_columns_give_ids_and_texts_back(spark):
    df = spark.createDataFrame([(" a  b\n",), (None,), ("",), ("▁c",)], "text string")
    ids = df.select(pieces.encoder(spark)("text").alias("ids"))
    assert [r.ids for r in ids.collect()] == [PLAIN.encode(t) for t in (" a  b\n", "", "", "▁c")]
    assert [r.t for r in ids.select(pieces.decoder(spark)("ids").alias("t")).collect()] == [" a  b\n", "", "", " c"]


def test_other_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    other = sentencepiece_model_pb2.ModelProto.FromString(VOCABULARY.model)
    other.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        pieces.Vocabulary(other.SerializeToString())
    other = sentencepiece_model_pb2.ModelProto.FromString(VOCABULARY.model)
    other.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        pieces.Vocabulary(other.SerializeToString())


def test_marks_inside_pieces_leave_texts_uncut():
    from sentencepiece import sentencepiece_model_pb2

    other = sentencepiece_model_pb2.ModelProto.FromString(VOCABULARY.model)
    other.pieces[300].piece = "s▁t"
    own, library = pieces.Tokenizer(pieces.Vocabulary(other.SerializeToString())), sentencepiece.SentencePieceProcessor(model_proto=other.SerializeToString())
    for text in ("this thing", "cats test", "is ts t"):
        assert own.encode(text) == library.encode(text)
