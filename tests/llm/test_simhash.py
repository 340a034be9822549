import re

import numpy as np
import xxhash

from storyflow.llm import simhash
from storyflow.shared import table

from . import cases

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, own in enumerate(ids):
        if own is not None:
            least[find(i)] = min(least.get(find(i), own), own)
    return [least.get(find(i)) for i in range(len(prints))]


def test_query_equals_brute_force(spark, small):
    docs = table(spark, small, "documents").select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in docs]
    want = sorted((r.doc_id, f"{p:016x}", c) for r, p, c in zip(docs, prints, plain_components(prints, [r.doc_id for r in docs])))
    assert sorted(map(tuple, simhash.op1_simhash(spark, small).collect())) == want


def test_edge_rows(spark):
    got = simhash.near_duplicates(cases.rows(spark)).collect()
    prints = [plain_fingerprint(t) for _, t, _ in cases.ROWS]
    want = zip([i for i, _, _ in cases.ROWS], prints, plain_components(prints, [i for i, _, _ in cases.ROWS]))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0


def test_first_of_each_keeps_one_row_per_group(spark):
    kept = simhash.first_of_each(cases.rows(spark))
    assert kept.columns == cases.rows(spark).columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted(set(ids)) and 1 in ids and 2 not in ids
    assert simhash.first_of_each(cases.empty(spark)).count() == 0


def test_tree_finds_all_pairs_within_radius():
    random = np.random.default_rng(3)
    base = random.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << np.uint64(b)) ^ (np.uint64(1) << np.uint64(c)) for b, c in ((1, 1), (3, 40), (63, 0), (5, 6))]))
    codes = codes[np.argsort(simhash._rank(codes))]
    q, m = simhash.GrayTree(codes, np.full(len(codes), 2**64 - 1, np.uint64)).search(codes)
    want = {(i, j) for i in range(len(codes)) for j in range(len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 2}
    assert set(zip(q.tolist(), m.tolist())) == want and len(q) == len(want)


def test_many_blocks_lose_no_link(spark, monkeypatch):
    random = np.random.default_rng(5)
    near = random.integers(0, 1 << 63, 1, dtype=np.uint64) ^ np.array([(1 << a) ^ (1 << b) ^ (1 << c) for a in range(8) for b in range(8, 20) for c in range(20, 26)], np.uint64)
    far = random.integers(0, 1 << 63, 600, dtype=np.uint64)
    codes = np.unique(np.concatenate([near, far, far[:200] ^ np.uint64(1 << 50)]))
    monkeypatch.setattr(simhash, "BLOCK", 32)
    df = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp bigint")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    want = plain_components([int(c) for c in codes], list(range(len(codes))))
    signed = codes.view(np.int64).tolist()
    groups = {}
    for i, c in enumerate(want):
        groups.setdefault(roots.get(signed[i], signed[i]), set()).add(c)
    assert all(len(v) == 1 for v in groups.values()) and len(groups) == len(set(want))


def test_gray_rank_matches_numpy(spark):
    codes = np.array([0, 1, 2, 3, 1 << 63, 2**64 - 1, 0x123456789ABCDEF0], np.uint64)
    got = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp bigint").select(simhash.gray_rank(simhash.F.col("fp")).alias("r"), "fp").collect()
    assert {r.fp: r.r for r in got} == dict(zip(codes.view(np.int64).tolist(), simhash._rank(codes).tolist()))
