import hashlib
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from storyflow.llm import bpe, langid
from storyflow.shared import table

from . import cases
from .test_decontaminate import plain as contaminated
from .test_jaccard import plain_roots
from .test_secretscan import plain as secrets


def test_run_equals_brute_force(spark, small):
    docs = table(spark, small, "documents")
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    model = langid.train(docs.where(~langid.held_out()))
    rows = {r.doc_id: r.text for r in docs.collect()}
    names, scores = model.score([(t or "").encode() for t in rows.values()])
    kept = sorted(i for i, n, s in zip(rows, names, scores) if n != "und" and s >= 0.5)
    kept = [kept[k] for k in sorted(set(plain_roots([rows[i] for i in kept])))]
    hit = {d for d, _, h, _ in contaminated([(i, rows[i]) for i in kept], items) if h}
    kept = [i for i in kept if i not in hit]
    vocabulary = bpe.Vocabulary.load(public_tokenizers.path(bpe.VOCABULARY))
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(zip(vocabulary.keys, vocabulary.ids)), special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, small).collect()}
    assert set(got) == set(kept) and 0 < len(kept) < len(rows)
    for i in kept:
        text, at = "", 0
        for start, _, end, _ in secrets(rows[i]):
            if start >= at:
                text += rows[i][at:start] + "[SECRET]"
            at = max(at, end)
        text += rows[i][at:]
        ids = plain.encode_ordinary(text)
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_keep_the_columns_and_stand_edge_rows(spark, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    bench = spark.createDataFrame([(1, "looked at the other cat all day long"), (2, None)], "item_id bigint, text string")
    for name, docs in (("a", cases.rows(spark)), ("b", cases.empty(spark))):
        folder = cases.store(bench, tmp_path / name, "benchmark")
        docs = docs.select(*columns, docs["score"].alias("component_id"), docs["key"].alias("own"), docs["item"].alias("judged"))
        for step, stage in corpus_pipeline.STAGES[:-1]:
            before = docs.count()
            docs = stage(spark, docs, folder)
            assert docs.columns[:5] == columns and docs.count() <= before, step
        last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
        assert last.count() == docs.count()


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "secrets", "encode"]
    assert corpus_pipeline.ORACLE_SQL is None and re.match("", "")
