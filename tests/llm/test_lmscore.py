import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from storyflow.llm import arrowtext, attention, lmscore
from storyflow.shared import table

from . import cases


def plain(rows):
    words = [(i, (t or "").encode().lower().split(), i is not None and zlib.crc32(str(i).encode()) % 5 == 1) for i, t in rows]
    counts, ends = Counter(), 0
    for _, w, held in words:
        if not held:
            counts.update(w)
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    log = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    return sorted((i if i is not None else -1, held, len(w) + 1, sum(x in counts for x in w) + (ends > 0), n, round(sum(log(counts[x]) for x in w) + log(ends), 5)) for i, w, held in words)


def found(df):
    rows = df.collect()
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    return sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows)


def test_query_equals_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    assert found(lmscore.op5_lm(spark, small)) == plain(rows)


def test_rare_words_come_by_the_join(spark):
    rows = [(i, t) for i, t, _ in cases.ROWS]
    assert found(lmscore.scores(cases.rows(spark), most_frequent=3)) == plain(rows)
    got = lmscore.scores(cases.rows(spark), most_frequent=0).collect()
    same = [r for r in got if r.doc_id == 1]
    assert len(got) == len(rows) and same[0] == same[1]


def test_empty_table_and_no_training_rows(spark):
    assert lmscore.scores(cases.empty(spark)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    df = spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")
    row = lmscore.scores(df).first()
    assert (row.n_known, row.train_tokens, row.base_score) == (0, 0, 0.0) and row.score < 0


def test_training_improves_held_out_texts(spark, small, monkeypatch):
    def total():
        return sum(r.score for r in lmscore.op5_lm(spark, small.replace("sf0.001", "sf0.01")).collect() if r.held_out)

    learned = total()
    monkeypatch.setattr(lmscore, "train", lambda texts, counted, n: attention.Model(counted.value).flat())
    assert learned > total()


def model_of(n=50, seed=3, moved=0.3):
    """An untrained model over counts of random texts, moved off its start."""
    random = np.random.default_rng(seed)
    v = attention.Vocabulary(np.arange(n), np.arange(n, 0, -1) ** 2, 10, n + 20, n - 5)
    size = len(v.mass)
    pairs, counts = np.unique(random.integers(0, size, 300) * size + random.integers(0, size, 300) ** 2 // size, return_counts=True)
    cells, times = np.unique(random.integers(0, size * v.classes**2, 500) // 3 * 3, return_counts=True)
    model = attention.Model(attention.Follows(v, pairs, counts, cells, times))
    model.p = {k: (x + random.standard_normal(x.shape) * moved).astype(np.float32) for k, x in model.p.items()}
    return model


def score_of(model, texts):
    total = np.zeros(len(texts))
    for x, y, owner in attention.laid_out(iter(texts), model.v.end, 7):
        total += np.bincount(owner, model.score(x, y, model.tables()), len(texts))
    return total


def plainly(model, text, every=None):
    """log-probability of a text, symbol by symbol with loops; ``every`` gets the sum of all symbols' shares."""
    p, v, f, width = {k: x.astype(float) for k, x in model.p.items()}, model.v, model.follows, attention.WIDTH
    size, counts = len(v.mass), dict(zip(f.pairs.tolist(), f.n.tolist()))
    says, total, cells = [v.end, *map(int, text)], 0.0, dict(zip(f.cells.tolist(), f.times.tolist()))
    mass = [v.mass[v.class_of == c].sum() for c in range(v.classes)]
    for t, goal in enumerate([*map(int, text), v.end]):
        start = t // attention.BLOCK * attention.BLOCK - attention.BLOCK
        seen = [says[j] if j >= 0 else v.end for j in range(start, t + 1)]
        q = p["embed"][says[t]] @ p["q"]
        scores = [q @ (p["embed"][s] @ p["k"]) / width**0.5 + p["ago"][len(seen) - 1 - j] for j, s in enumerate(seen)]
        share = np.exp(np.array(scores) - max(scores))
        h = sum(w * (p["embed"][s] @ p["v"]) for w, s in zip(share / share.sum(), seen))
        follow = {y: counts[says[t] * size + y] for y in range(size) if says[t] * size + y in counts}
        by_class = [sum(n for y, n in follow.items() if v.class_of[y] == c) for c in range(v.classes)]
        kinds = max(1, sum(n > 0 for n in by_class))
        short = [(n + kinds * m / sum(mass)) / (sum(by_class) + kinds) for n, m in zip(by_class, mass)]
        context = says[t] * v.classes + v.class_of[says[t - 1] if t else v.end]
        far = [cells.get(context * v.classes + c, 0) for c in range(v.classes)]
        more = max(1, sum(n > 0 for n in far))
        logit = [math.log((n + more * s) / (sum(far) + more)) + h @ p["out"][:, c] for c, (n, s) in enumerate(zip(far, short))]
        logit = np.array(logit) - np.log(np.exp(logit).sum())

        def chance(y):
            c = v.class_of[y]
            k = max(1, sum(v.class_of[z] == c for z in follow))
            return logit[c] + math.log((follow.get(y, 0) + k * v.mass[y] / mass[c]) / (by_class[c] + k))

        if every is not None:
            every.append(sum(math.exp(chance(y)) for y in range(size)))
        total += chance(goal)
    return total


def test_scores_equal_a_plain_model_and_shares_sum_to_one():
    model = model_of()
    texts = [np.random.default_rng(k).integers(0, 47, k).astype(np.uint16) for k in (0, 1, 15, 16, 17, 100)]
    every = []
    assert np.allclose(score_of(model, texts), [plainly(model, t, every) for t in texts], rtol=1e-5)
    assert len(every) == sum(len(t) + 1 for t in texts) and np.allclose(every, 1, atol=1e-6)
    assert abs(np.exp(model.v.share[model.v.share < 0]).sum() - 1) < 1e-9


def test_a_long_text_is_laid_out_in_pieces(monkeypatch):
    model, text = model_of(), np.random.default_rng(5).integers(0, 47, 500).astype(np.uint16)
    whole = score_of(model, [text])
    monkeypatch.setattr(attention, "PIECE", 64)
    assert np.allclose(score_of(model, [text]), whole, rtol=1e-6)


def test_attention_is_causal():
    model = model_of()
    a, b = np.arange(40) % 30, np.arange(40) % 30
    b[32:] = 7
    got = []
    for t in (a, b):
        x, y, _ = next(attention.laid_out(iter([t]), model.v.end, 99))
        got.append(model.score(x, y, model.tables()))
    assert np.allclose(got[0][:3], got[1][:3], atol=1e-6) and not np.allclose(got[0][3], got[1][3])


def test_large_scores_do_not_overflow():
    model = model_of()
    model.p["q"] *= 300
    assert model.tables()[-1]
    assert np.isfinite(score_of(model, [np.arange(40) % 30])).all()


def test_scoring_holds_no_table_of_all_pairs():
    model = model_of(4000)
    texts = [np.random.default_rng(k).integers(0, 3990, 300).astype(np.uint16) for k in range(20)]
    tables, _ = model.tables(), model.follows.class_log
    tracemalloc.start()
    for x, y, _ in attention.laid_out(iter(texts), model.v.end, 99):
        model.score(x, y, tables)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # a float for each of 4,000 x 4,000 pairs is 64 MB


def test_gradient_matches_differences():
    model = model_of(12)
    model.p = {k: x.astype(np.float64) for k, x in model.p.items()}
    random = np.random.default_rng(2)
    x, y, _ = next(attention.laid_out(iter([random.integers(0, model.v.end, 40), random.integers(0, model.v.end, 9)]), model.v.end, 99))
    weight = np.repeat([1.0, 3.0], [4, 2])
    _, d = model.gradient(x, y, weight)
    for name, p in model.p.items():
        for at in random.integers(0, p.size, 6):
            kept, e = p.ravel()[at], 1e-4
            p.ravel()[at] = kept + e
            up = model.gradient(x, y, weight)[0]
            p.ravel()[at] = kept - e
            down = model.gradient(x, y, weight)[0]
            p.ravel()[at] = kept
            assert abs((up - down) / (2 * e) - d[name].ravel()[at]) < 1e-5, name


def test_every_training_text_is_learned_from_with_its_copies(spark, small, monkeypatch):
    given, train, follows = [], lmscore.train, lmscore.follows
    monkeypatch.setattr(lmscore, "train", lambda texts, *more: (given.append(texts.selectExpr("sum(times) n").first().n), train(texts, *more))[1])
    monkeypatch.setattr(lmscore, "follows", lambda texts, v: (given.append(follows(texts, v)), given[-1])[1])
    docs = table(spark, small, "documents").where(~lmscore.held_out()).unionByName(table(spark, small, "documents"))
    lmscore.scores(docs)
    learned = docs.where(~lmscore.held_out())
    assert given[1] == learned.count()
    # every subword and end of every training text follows something once
    encoded = lmscore.Subwords(spark).encoding()
    ids = sum(len(encoded.encode_ordinary("".join(" " + w.decode() for w in lmscore.words_of((r.text or "").encode())))) for r in learned.collect())
    assert given[0].n.sum() == ids + learned.count()


def test_training_lowers_the_loss_and_moves_with_every_text():
    model, random = model_of(moved=0), np.random.default_rng(1)
    texts = [np.repeat(random.integers(0, 40, 8), 6) for _ in range(200)]
    flat, seen = attention.trained(model, ((t, 1) for t in texts))
    before = score_of(model, texts).sum()
    assert seen == sum(len(t) + 1 for t in texts)
    other, _ = attention.trained(model, ((t, 1) for t in texts[:-1]))
    assert not np.array_equal(flat, other)
    model.load(flat)
    assert score_of(model, texts).sum() > before


def test_scores_do_not_depend_on_partitions(spark, small):
    docs = table(spark, small, "documents").select("doc_id", "text")
    found = [{r.doc_id: r.score for r in lmscore.scores(docs.repartition(n)).collect()} for n in (1, 7)]
    assert found[0].keys() == found[1].keys() and all(abs(found[1][k] - x) <= 1e-6 * abs(x) for k, x in found[0].items())


def test_pieces_keep_words_whole():
    text = b" ".join(b"w%d" % (i * 7919) for i in range(300)) + b"\n" + b"x" * 500 + b" end"
    for limit in (1, 40, 700, 10_000):
        assert sum((lmscore.words_of(p) for p in lmscore.pieces(text, limit)), []) == text.split() and b"".join(lmscore.pieces(text, limit)) == text


def test_the_4096_most_frequent_ids_are_symbols():
    v = attention.Vocabulary(np.arange(6000), np.arange(6000, 0, -1), 10, 6000)
    assert v.other == 4096 and sorted(v.symbol[:4096]) == list(range(4096)) and (v.symbol[4096:] == v.other).all()


def test_words_are_counted_and_spelled_by_arrow(spark, monkeypatch):
    texts = [None, b"", b" ", b" a  B\x1c\x1d\x1fc \xc2\x85x \xc2\xa0y\t\n\x0b\x0c\rZ a", "ÉA İb".encode(), b"\xff\xfe A", b"x" * 90]
    array = pa.array(texts, pa.binary()).view(pa.string())
    for given, own in ((array, texts), (array.slice(3, 2), texts[3:5])):
        words, owner = arrowtext.ascii_words(given)
        assert list(zip(owner.tolist(), words.cast(pa.binary()).to_pylist())) == [(i, w) for i, t in enumerate(own) for w in lmscore.words_of(t)]
    monkeypatch.setattr(arrowtext, "CHUNK_BYTES", 8)
    monkeypatch.setattr(arrowtext.slices, "__defaults__", (8,))
    monkeypatch.setattr(arrowtext.pieces, "__defaults__", (8,))
    monkeypatch.setattr(lmscore, "HELD_WORDS", 2)
    expected = Counter(w for t in texts for w in lmscore.words_of(t))
    monkeypatch.setattr(lmscore, "words_of", None)
    found = Counter()
    for batch in lmscore._count(iter([pa.RecordBatch.from_arrays([array], names=["text"])] * 2)):
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found[word] += n
    assert found == {w: 2 * n for w, n in expected.items()}


def test_shares_of_pairs_are_those_counted():
    f = model_of(300).follows
    last, after = np.divmod(np.arange(len(f.v.mass) ** 2), len(f.v.mass))
    counts = dict(zip(f.pairs.tolist(), f.n.tolist()))
    group = f.v.class_of[after]
    n = np.array([counts.get(k, 0) for k in range(len(last))])
    kinds = f.kinds[last, group]
    assert np.allclose(f.share(last.astype(np.int32), after.astype(np.int32)), (n + kinds * f.within[after]) / (f.seen[last, group] + kinds))
    assert f.share(last[:0], after[:0]).size == 0


def test_a_step_multiplies_each_window_five_times(monkeypatch):
    model, calls, matmul = model_of(), [], np.matmul
    x, y, _ = next(attention.laid_out(iter([np.arange(400) % 40]), model.v.end, 99))
    monkeypatch.setattr(np, "matmul", lambda a, b, **more: (calls.append(b.ndim), matmul(a, b, **more))[1])
    model.gradient(x, y, np.ones(len(x), np.float32))
    assert calls.count(3) == 5  # six before keys and values were rows of embed, and projections besides


def test_pairs_are_shuffled_by_spans(spark, monkeypatch):
    random = np.random.default_rng(4)
    v = attention.Vocabulary(np.arange(200), np.arange(200, 0, -1) ** 2, 10, 220, 190)
    texts = [(random.integers(0, v.end, k).astype(np.uint16), 1 + k % 3) for k in (0, 1, 5, 40, 300, 300)]
    pairs, cells = Counter(), Counter()
    for text, times in texts:
        own = [v.end, v.end, *map(int, text), v.end]
        for a, b, c in zip(own, own[1:], own[2:]):
            pairs[b * len(v.mass) + c] += times
            cells[(b * v.classes + int(v.class_of[a])) * v.classes + int(v.class_of[c])] += times
    shuffled = []
    monkeypatch.setattr(lmscore, "PAIRS", 64)
    monkeypatch.setattr(lmscore, "SPAN", 100)
    df = spark.createDataFrame([(bytearray(t.tobytes()), n) for t, n in texts], "symbols binary, times bigint").repartition(3)
    mapped = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, fn, schema: (shuffled.append(schema), mapped(self, fn, schema))[1])
    f = lmscore.follows(df, v)
    assert shuffled[0].startswith("span int")
    assert dict(zip(f.pairs.tolist(), f.n.tolist())) == pairs and dict(zip(f.cells.tolist(), f.times.tolist())) == cells
    assert (np.diff(f.pairs) > 0).all() and (np.diff(f.cells) > 0).all()
