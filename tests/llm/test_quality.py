import random
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from pairlift.llm import quality_classifier as qc, quality_rules as qr

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed)


def prose(rng, n=300):
    """Words made of syllables, as varied as in real text."""
    syllables = ["ka", "lo", "mi", "ter", "en", "sha", "qu", "ber", "tion", "za", "ro", "fi"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))


def rule_texts():
    rng = random.Random(6)
    few = [prose(rng, 12) for _ in range(3)]
    return [prose(rng, n) for n in (19, 20, 25, 60, 300, 3000)] + [
        "\n".join(rng.choices(few, k=9)), "a b c d e f g h a b c d e f g h i", " ".join(f"{a} " * 9 for a in ["x", "yy", "z"]),
        "l\n \nl\nl\r\nl\x85", prose(rng, 40) + " " + "one two three four five six seven eight " * 2,
    ]


def test_rules_against_brute_force(make_docs, edge_pairs):
    pairs = [*edge_pairs, *enumerate(rule_texts(), 1000)]
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = qr.quality_rules(make_docs(pairs)).collect()
    got = sorted((str(r["doc_id"]), *(r[c] for c in cols)) for r in rows)
    assert got == sorted((str(i), *brute_counts(t)) for i, t in pairs)
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def verdicts(texts):
    return qr.measures(pa.array(texts, pa.string()))["kept"].tolist()


def test_compression_bands():
    rng = random.Random(1)
    clean = [prose(rng, n) for n in (25, 80, 300, 2000, 20_000)]
    assert all(verdicts(clean))
    noise = ["".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=n)) for n in (3000, 30_000)]
    noise = [" ".join(x[i : i + 60] for i in range(0, len(x), 60)) for x in noise]
    again = [" ".join(w for w in prose(rng, 40).split() for _ in range(7)) for _ in range(3)]
    assert not any(verdicts([*noise, *again]))


def test_bad_chunks_reject_a_text_that_is_good_on_the_whole():
    rng = random.Random(2)
    text = prose(rng, 2500) + " " + " ".join(w for w in prose(rng, 900).split() for _ in range(7))
    found = qr.measures(pa.array([text]))
    assert found["bad_chunks"][0] > 0.5 and not found["kept"][0]


def junk(rng, letters, n):
    """Random words of 3 to 12 letters, about n bytes."""
    return " ".join("".join(rng.choices(letters, k=rng.randint(3, 12))) for _ in range(2 * n // 17))


@pytest.mark.parametrize(
    "letters, least",
    [("0123456789abcdef", 2500), ("abcdefghijklmnopqrstuvwxyz", 2500), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1500), ("abcdefghijklmnopqrstuvwxyz0123456789", 1500)],
)
def test_random_letters_are_rejected(letters, least):
    rng = random.Random(3)
    texts = [junk(rng, letters, n) for n in (least, 5000, 20_000, 400_000) for _ in range(3)]
    assert not any(verdicts(texts))


def test_half_junk_and_junk_tails_are_rejected():
    rng = random.Random(4)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    clean = prose(rng, 1600)
    assert len(clean) > 8192 and verdicts([clean]) == [True]
    half = clean[:11_000] + " " + junk(rng, base64, 9000)
    tail = clean[:8192] + " " + junk(rng, base64, 4000)
    found = qr.measures(pa.array([half, tail]))
    assert not found["kept"].any() and found["bad_chunks"][1] > 0.25


def test_keep_by_rules_leaves_columns(make_docs, edge_pairs):
    pairs = [*edge_pairs, *enumerate(rule_texts(), 1000)]
    docs = make_docs(pairs)
    left = qr.keep_by_rules(docs)
    assert left.columns == docs.columns
    want = [r["doc_id"] for r in qr.quality_rules(docs).collect() if r["kept"]]
    assert sorted(map(str, want)) == sorted(str(r["doc_id"]) for r in left.collect())
    assert qr.keep_by_rules(make_docs([])).collect() == qr.quality_rules(make_docs([])).collect() == []


def labelled(n=600):
    rng = random.Random(3)
    texts, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        text = prose(rng, rng.randint(20, 80))
        if bad:
            text = " ".join(w + "!!" for w in text.upper().split()) if k % 8 else " ".join(w for w in text.split() for _ in range(4))
        texts.append(text)
        labels.append(0 if bad else 1)
    return texts, labels


def held_out(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 5 == 0


def test_held_out_accuracy_and_flags(spark, make_docs, edge_pairs):
    texts, labels = labelled()
    pairs = [*edge_pairs, *enumerate(texts, 1000)]
    docs = make_docs(pairs)
    rows = [(i, y, None) for i, y in enumerate(labels, 1000)] + [(None, 1, 1), (1001, None, None), (7, 3, 0)]
    table = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    model = qc.fit(docs, table)
    found = qc.quality_scores(docs, model).collect()
    assert len(found) == len(pairs)
    truth = dict(enumerate(labels, 1000))
    new = [r for r in found if r["held_out"] and (r["doc_id"] or 0) >= 1000]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in new) >= 0.97 * len(new)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == held_out(r["doc_id"]) for r in found)
    kept = qc.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in found)


def test_held_out_labels_are_never_read(spark, make_docs):
    texts, labels = labelled(200)
    docs = make_docs(list(enumerate(texts)))
    schema = "doc_id long, quality int"
    model = qc.fit(docs, spark.createDataFrame(list(enumerate(labels)), schema))
    flipped = [(i, 1 - y if held_out(i) else y) for i, y in enumerate(labels)]
    other = qc.fit(docs, spark.createDataFrame(flipped, schema))
    assert model.bias == other.bias and np.array_equal(model.per_bucket, other.per_bucket)


def test_scores_follow_the_features():
    """The per-bucket shortcut gives the same odds as averaging features."""
    model = qc.Model(np.random.default_rng(0).normal(size=qc.BUCKETS).astype(np.float32), 0.25)
    texts = ["", "one", "one one two", "Ä ö 你好 a-b", "x" * 500]
    odds = [float(share.astype(np.float64) @ model.per_bucket[index]) + 0.25 for index, share in qc.features_of(pa.array(texts))]
    assert qc.scores(pa.array(texts), model) == pytest.approx(1 / (1 + np.exp(-np.array(odds))), rel=1e-4)


def test_scoring_a_batch_holds_little_at_a_time():
    """A batch of 10 MB took 78 MB with few different words, 326 MB with many; the scores don't depend on slices."""
    rng = random.Random(5)
    texts = [prose(rng, 400) for _ in range(350)]
    model = qc.Model(np.random.default_rng(1).normal(size=qc.BUCKETS).astype(np.float32), -0.1)
    want = np.tile(qc.scores(pa.array(texts), model), 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(10 * len(texts)), pa.int64()), pa.array(texts * 10)], names=["doc_id", "text"])
    for made in (
        lambda: np.concatenate([b.column("score").to_numpy() for b in qc._score(SimpleNamespace(value=model))(iter([batch]))]),
        lambda: qc.scores_of_slices(batch.column("text"), model),
    ):
        tracemalloc.start()
        found = made()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.array_equal(found, want) and peak < 50 << 20
    assert len(qc.scores_of_slices(pa.array([], pa.string()), model)) == 0


def test_sample_is_bounded_and_empty_tables_work(spark, make_docs):
    texts, labels = labelled(100)
    docs = make_docs([*enumerate(texts), (3, "again"), (3, "again")])
    table = spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int")
    got, y = qc.labelled_sample(docs, table, rows=10, chars=300)
    assert len(got) == len(y) <= 10 and all(len(t) <= 300 for t in got)
    empty = qc.fit(make_docs([]), table.limit(0))
    assert qc.quality_scores(make_docs([(1, "a"), (2, None)]), empty).select("score").distinct().collect()[0][0] == 0.5
    assert qc.quality_scores(make_docs([]), empty).collect() == []
