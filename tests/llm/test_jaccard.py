import corpus_pipeline
import numpy as np
import pyarrow as pa

from storyflow.llm import jaccard
from storyflow.shared import table

from . import cases


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset([b" ".join(words)] if len(words) < 5 else [b" ".join(words[i : i + 5]) for i in range(len(words) - 4)])


def plain_roots(texts):
    sets = [plain_set(t) for t in texts]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and len(a & b) / len(a | b) >= 0.8:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def grouped(keys):
    places = {}
    for i, k in enumerate(keys):
        places.setdefault(k, []).append(i)
    return sorted(places.values())


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.root for r in jaccard.near_duplicates(df).collect()}
    assert grouped([got[i] for i in range(len(texts))]) == grouped(plain_roots(texts))


def edited(count):
    random = np.random.default_rng(5)
    base = [f"w{i}" for i in random.integers(0, 5000, 300)]
    texts = []
    for k in range(count):
        words = list(base)
        for at in random.integers(0, 300, k % 14):
            words[at] = f"new{k}x{at}"
        texts.append(" ".join(words))
    return texts


def test_stage_equals_brute_force(spark, small):
    docs = table(spark, small, "documents")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    want = {rows[r].doc_id for r in plain_roots([r.text for r in rows])}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, small).collect()} == want


def test_near_copies_and_edge_texts(spark, monkeypatch):
    texts = edited(60) + [t for _, t, _ in cases.ROWS]
    check(spark, texts)
    monkeypatch.setattr(jaccard, "PAIRS", 0)  # rounds by a bucket's first set
    monkeypatch.setattr(jaccard, "BROADCAST", 0)
    check(spark, texts)
    assert jaccard.near_duplicates(cases.empty(spark)).count() == 0


def test_names_that_clash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_names", lambda owns, seed: pa.array([len(o) % 2 if seed == jaccard.SEED else hash(o.tobytes()) % 2**31 for o in owns], pa.int64()))
    check(spark, edited(30) + [t for _, t, _ in cases.ROWS])


def test_similar_sets_share_a_first_shingle():
    random = np.random.default_rng(8)
    for _ in range(3000):
        n = int(random.integers(1, 60))
        a = np.unique(random.integers(0, 90, n).astype(np.uint64))
        b = np.union1d(np.setdiff1d(a, random.choice(a, len(a) // 8)), random.integers(0, 90, int(random.integers(0, 8))).astype(np.uint64))
        known = np.unique(random.integers(0, 90, 40).astype(np.uint64))
        frequent = (known, random.integers(1, 9, len(known)))
        common = len(np.intersect1d(a, b))
        if common / (len(a) + len(b) - common) >= 0.8:
            x, y = (jaccard.first_shingles(s, frequent, 0.8) for s in (a, b))
            first = next(h for h in x if h in y)
            i, j = list(x).index(first), list(y).index(first)
            assert 1.8 * min(len(a) - i, len(b) - j) + 1e-6 >= 0.8 * (len(a) + len(b))


def test_a_shared_passage_makes_no_pairs(spark, monkeypatch):
    random = np.random.default_rng(9)
    passage = " ".join(f"p{i}" for i in range(200))
    texts = [" ".join(f"w{x}" for x in random.integers(0, 10**6, 150)) + " " + passage for _ in range(1500)]
    texts += [texts[0] + " more", texts[1].replace("p7 ", "q7 ")]
    seen = []
    compared = jaccard._similar
    monkeypatch.setattr(jaccard, "_similar", lambda pairs, *rest: seen.append(pairs.count()) or compared(pairs, *rest))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.root for r in jaccard.near_duplicates(df).collect()}
    assert len(set(got.values())) == 1500 and got[0] == got[1500] and got[1] == got[1501]
    assert sum(seen) < 100


def test_copies_of_one_text_take_a_comparison_each(spark, monkeypatch):
    random = np.random.default_rng(11)
    base = [f"w{i}" for i in random.integers(0, 10**6, 400)]
    texts = [" ".join(base)]
    for k in range(110):
        words = list(base)
        for at in random.choice(40, 6, replace=False) * 10:
            words[at] = f"new{k}x{at}"
        texts.append(" ".join(words))
    sets = [plain_set(t) for t in texts]
    alike = sum(len(a & b) / len(a | b) >= 0.8 for i, a in enumerate(sets) for b in sets[:i])
    assert alike < 300  # each is like the first text, few are like each other
    seen = []
    compared = jaccard._similar
    monkeypatch.setattr(jaccard, "_similar", lambda pairs, *rest: seen.append(pairs.count()) or compared(pairs, *rest))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert len({r.root for r in jaccard.near_duplicates(df).collect()}) == 1
    assert sum(seen) <= 2 * len(texts)


def test_a_pair_is_named_by_its_first_bucket(spark):
    words = [f"w{i}" for i in range(2000)]
    docs = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words[:1700] + [f"x{i}" for i in range(300)]))], "doc_id bigint, text string")
    frequent = jaccard.frequent_shingles(docs.select("text"))
    own = docs.select(jaccard.sets(frequent)("text").alias("s")).select("s.*")
    spread = own.selectExpr("set", "n", "posexplode(first) as (at, bucket)")
    members = jaccard._shared(spread, 0.8)[0].cache()
    a, b = (members.where(f"set = {r.set}").alias(k) for r, k in zip(own.collect(), "ab"))
    both = a.join(b, "bucket")
    assert both.count() > 100 and 1 <= both.where("not arrays_overlap(a.before, b.before)").count() < 10


def test_the_gray_index_names_near_copies_first(spark):
    base = [f"w{i}" for i in range(3000)]
    other = [f"v{i}" for i in range(3000)]
    texts = [" ".join(base), " ".join(base + ["end"]), " ".join(other), " ".join(["start"] + other), "one text alone"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    frequent = jaccard.frequent_shingles(docs.select("text"))
    own = docs.selectExpr("doc_id", "sha2(text, 256) as key", "text").withColumn("s", jaccard.sets(frequent)("text")).select("doc_id", "key", "s.*").cache()
    of = {r.set: r.doc_id for r in own.collect()}
    assert {frozenset((of[r.a], of[r.b])) for r in jaccard.by_index(own, docs.select("text")).collect()} == {frozenset((0, 1)), frozenset((2, 3))}
