import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa

from pairlift.llm import minhash
from pairlift.llm.components import components


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(pairs, width, percent):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingles(t, width) for _, t in pairs]
    parent = list(range(len(pairs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(pairs)), 2):
        a, b = sets[i], sets[j]
        if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
            parent[root(j)] = root(i)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(pairs):
        groups[root(i)].append(doc_id)
    least = {r: min((d is None, d) for d in ids)[1] for r, ids in groups.items()}
    return [(doc_id, len(sets[i]), least[root(i)]) for i, (doc_id, _) in enumerate(pairs)]


def key(row):
    return tuple((v is None, v) for v in row)


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus():
    """Texts of all sizes: chains of copies, groups whose pairs are on both sides of the threshold, short ones."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for size in (4, 7, 8, 14, 40, 150, 600):
        for group in range(4):
            base = rng.choices(vocabulary, k=size)
            texts.append(" ".join(base))
            texts += near_copies(rng, base, 12, max(1, size * (1 + group) // 100))
            texts += [" ".join(base[1:]), " ".join(base[:-1]), " ".join([*base, "more"])]
            chain = list(base)
            for step in range(6):
                chain = [*chain[: step * 3], f"x{group}{step}", *chain[step * 3 + 1 :]]
                texts.append(" ".join(chain).upper())
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def same_as_brute(spark_rows, pairs, width, percent):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in spark_rows]
    assert sorted(got, key=key) == sorted(brute(pairs, width, percent), key=key)


def test_against_brute_force(make_docs):
    pairs = corpus()
    for width, percent in ((3, 85), (5, 80)):
        rows = minhash.near_duplicates(make_docs(pairs), width=width, percent=percent).collect()
        same_as_brute(rows, pairs, width, percent)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_edge_rows(make_docs, edge_pairs):
    rows = minhash.near_duplicates(make_docs(edge_pairs), width=3, percent=85).collect()
    pairs = [p for p in edge_pairs]
    same_as_brute(rows, pairs, 3, 85)
    words = [r for r in rows if r["n_shingles"]]
    assert sum(r["kept"] for r in words) == len({r["component_id"] for r in words})
    assert all(r["kept"] for r in rows if not r["n_shingles"])


def test_empty_table(make_docs):
    assert minhash.near_duplicates(make_docs([])).collect() == []
    assert minhash.near_duplicates(make_docs([(1, None), (2, " ")])).count() == 2


def test_drop_keeps_one_of_each_group(make_docs, edge_pairs):
    docs = make_docs(edge_pairs)
    left = minhash.drop_near_duplicates(docs, width=3, percent=85)
    assert left.columns == docs.columns
    rows = minhash.near_duplicates(docs, width=3, percent=85).collect()
    assert left.count() == sum(r["kept"] for r in rows)


def test_estimate_follows_similarity():
    rng = np.random.default_rng(3)
    for n, common in ((300, 0.9), (300, 0.5), (20_000, 0.8), (20_000, 0.0)):
        shared = int(n * common)
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n - shared : 2 * n - shared])
        ra, rb = minhash.registers_of([a]), minhash.registers_of([b])
        guess, used = minhash.estimate(ra, rb, np.array([len(a)]), np.array([len(b)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(guess[0] - true) <= 4 * (0.25 / used[0]) ** 0.5


def test_registers_of_nothing():
    assert minhash.registers_of([np.zeros(0, np.uint64)]).sum() == 0
    assert [len(s) for s in minhash.shingle_sets(pa.array(["", " ", "a", "a b c a b c"]), 3)] == [0, 0, 1, 3]


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (202, 201), (300, 300)] + [(500, 600 + i) for i in range(50)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    roots = {r["node"]: r["root"] for r in rows}
    assert len(roots) == len(rows)
    want = {i: 1 for i in [*range(2, 41), 100]} | {201: 200, 202: 200} | {600 + i: 500 for i in range(50)}
    assert roots == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
