import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from pairlift.llm import lm_scoring as lm


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def held_out(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 1


def base_rows(pairs):
    count = Counter(t for i, text in pairs if not held_out(i) for t in tokens(text))
    n, v = sum(count.values()), len(count)
    total = n + 0.5 * (v + 1)
    out = []
    for i, text in pairs:
        own = tokens(text)
        base = sum(log10((count[t] + 0.5) / total) for t in own)
        out.append((str(i), held_out(i), len(own), sum(count[t] > 0 for t in own), n, base))
    return out


def prose(rng, n):
    """Words of two languages that never mix, so a word tells much about the next."""
    out = []
    for k in range(n):
        common = ["the", "of", "and", "to"] if k % 2 else ["der", "die", "und", "zu"]
        rare = [f"{'en' if k % 2 else 'de'}{rng.randrange(300)}" for _ in range(40)]
        out.append(" ".join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(60)))
    return out


@pytest.mark.parametrize("size, hot_words", [(2048, 400_000), (4, 10), (0, 0)])
def test_base_columns_are_exact_and_the_model_is_better(make_docs, edge_pairs, size, hot_words):
    pairs = [*edge_pairs, *enumerate(prose(random.Random(4), 300), 1000)]
    rows = lm.score(make_docs(pairs), size=size, hot_words=hot_words).collect()
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows)
    for g, w in zip(got, sorted(base_rows(pairs)), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
    new = [r for r in rows if r["held_out"] and (r["doc_id"] or 0) >= 1000]
    assert all(np.isfinite(r["score"]) for r in rows)
    if size > 1000:
        assert sum(r["score"] for r in new) > sum(r["base_score"] for r in new)


def test_filter_gives_levels_back():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 40, 30_000, dtype=np.uint64)
    keys = np.unique(keys)
    counts = rng.integers(1, 5000, len(keys))
    bits = np.zeros((3, 1 << 20), np.uint8)
    where = lm.LogFrequencyFilter.segment_of(keys, 3)
    for s in range(3):
        lm.LogFrequencyFilter.add(bits[s], keys[where == s], lm.level_of(counts)[where == s])
    found = lm.LogFrequencyFilter(bits).levels(keys)
    assert (found >= lm.level_of(counts)).all() and (found > lm.level_of(counts)).mean() < 0.01
    absent = np.setdiff1d(rng.integers(0, 1 << 40, 30_000, dtype=np.uint64), keys)
    assert (lm.LogFrequencyFilter(bits).levels(absent) > 0).mean() < 0.01


def test_levels_and_their_counts():
    counts = np.arange(0, 3000)
    levels = lm.level_of(counts)
    assert levels[0] == 0 and levels[1] == 1 and (np.diff(levels) >= 0).all()
    middle = lm.count_of(levels)
    assert (middle[1:] / counts[1:] < 1.6).all() and (middle[1:] / counts[1:] > 0.6).all()


def test_probabilities_sum_to_one(spark, make_docs):
    pairs = list(enumerate(prose(random.Random(9), 200)))
    texts = make_docs(pairs).select("text")
    model = lm.fit(texts, lm.word_counts(texts), size=200)
    classes = [c for c in range(model.vocabulary.size) if c != 2]
    assert model.vocabulary.class_share()[classes].sum() == pytest.approx(1)
    for h in (1, 2, 5, 40):
        p = 10 ** model.log_pair(np.full(len(classes), h), np.array(classes))
        assert 0.97 < p.sum() < 1.03


def test_empty_tables(make_docs):
    assert lm.score(make_docs([])).collect() == []
    only = [i for i in range(50) if held_out(i)][:2]
    rows = lm.score(make_docs([(only[0], "a b"), (only[1], None)])).collect()
    assert all(r["train_tokens"] == 0 and r["base_score"] == 0 and np.isfinite(r["score"]) for r in rows)


def brute_scores(pairs):
    """log10 probabilities by exact pair counts, without a filter."""
    count = Counter(t for i, text in pairs if not held_out(i) for t in tokens(text))
    follow = Counter(p for i, text in pairs if not held_out(i) for p in zip(["", *tokens(text)[:-1]], tokens(text), strict=True))
    total = sum(count.values()) + 0.5 * (len(count) + 1)
    out = {}
    for i, text in pairs:
        own = tokens(text)
        terms = zip(["", *own[:-1]], own, strict=True)
        before = lambda h: count[None] if h == "" else count[h]
        out[i] = sum(log10((follow[h, w] + lm.DIRICHLET * (count[w] + 0.5) / total) / (before(h) + lm.DIRICHLET)) for h, w in terms)
    return out


def rare_word_pairs():
    """Over 3,000 words, each as frequent as any other, that always come in the same couples."""
    rng = random.Random(5)
    return list(enumerate(" ".join(f"left{k} right{k}" for k in rng.sample(range(1600), 60)) for _ in range(300)))


@pytest.mark.parametrize("hot_words", [400_000, 10, 0])
def test_pairs_of_all_words_are_counted(make_docs, edge_pairs, hot_words):
    pairs = rare_word_pairs()
    want = brute_scores(pairs)
    rows = lm.score(make_docs(pairs), hot_words=hot_words).collect()
    assert {r["doc_id"] for r in rows} == set(want)
    assert all(r["score"] == pytest.approx(want[r["doc_id"]], rel=0.01) for r in rows)
    new = [r for r in rows if r["held_out"]]
    # Every second word is told by the one before: the unigram model doesn't know.
    assert sum(r["score"] for r in new) > sum(r["base_score"] for r in new) + 10 * len(new)
    edge = lm.score(make_docs(edge_pairs), hot_words=hot_words).collect()
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in edge)
    for g, w in zip(got, sorted(base_rows(edge_pairs)), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)


def test_bounded_vocabulary_is_filled_when_counts_are_equal(spark):
    counts = spark.createDataFrame([(f"w{k}", 7) for k in range(50)] + [("", 9)], "word string, n long")
    known = lm.vocabulary(counts, size=20)
    assert len(known.classes) == 20 and len(known.counts) == 50


def test_a_block_asks_each_pair_once_and_gets_its_level(monkeypatch):
    """However often a pair comes, it travels once a block; counts of all blocks make its level."""
    monkeypatch.setattr(lm.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 3})())
    schema = lm.pa.schema([("doc_id", lm.pa.int64()), ("held_out", lm.pa.bool_()), ("text", lm.pa.string())])
    tables = [
        [[1, 2, None], [False, True, False], ["a b " * 500, "a b c", ""]],
        [[4], [False], ["a b " * 7 + "d"]],
    ]
    blocks = list(lm._blocks(lm.pa.RecordBatch.from_arrays([lm.pa.array(c, f.type) for c, f in zip(t, schema, strict=True)], schema=schema) for t in tables))
    assert [b.column("block").to_pylist() for b in blocks] == [[3 << 33], [(3 << 33) + 1]]
    buckets = lm.Buckets(1)
    asked = list(lm._ask(buckets)(iter(blocks)))
    # start-a, a-b, b-a, b-end, b-c, c-end, start-end; start-a, a-b, b-a, a-d or b-d, d-end.
    assert [sum(x.column("n").to_pylist()) for x in asked] == [7, 5]
    assert sum(len(k) for x in asked for k in x.column("keys").to_pylist()) < 400
    rows = sorted((r for x in asked for r in x.to_pylist()), key=lambda r: r["bucket"])
    answers = [r for x in lm._answer(30, buckets.rest)(iter([lm.pa.RecordBatch.from_pylist(rows, schema=lm._ASKED)])) for r in x.to_pylist()]
    first = [r for r in answers if r["block"] == 3 << 33]
    levels = np.frombuffer(b"".join(lm.pa.Codec("zstd").decompress(r["levels"], r["n"], asbytes=True) for r in sorted(first, key=lambda r: r["bucket"])), np.uint8)
    # a-b 507, b-a 499 + 6, start-a 2, b-end 1, start-end 1, and two that only the held-out text has.
    assert sorted(levels.tolist()) == sorted([*lm.level_of(np.array([507, 505, 2, 1, 1])).tolist(), 0, 0])
    pairs = np.zeros(99, int)
    for r in answers:
        if r["block"] is None:
            pairs[: len(r["pairs"])] += r["pairs"]
    assert pairs.sum() == 7 and pairs[0] == 0


def test_word_hashes_tell_words_apart():
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [*(a + b + c + d for a in letters for b in letters for c in letters for d in "Aé\x00Z"), *("a" * k for k in range(1, 300)), *("\x00" * k for k in range(1, 300))]
    array = lm.pa.array(["x", *words])
    hashes = lm.word_hashes(array.slice(1))
    assert len(np.unique(hashes)) == len(words) and (hashes == lm.word_hashes(lm.pa.array(words))).all()
    # Every bit is set in about half of them.
    share = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).mean(axis=0)
    assert ((share > 0.48) & (share < 0.52)).all()
    assert len(lm.word_hashes(lm.pa.array([], lm.pa.string()))) == 0
