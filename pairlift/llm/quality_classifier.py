"""Quality classifier by supervised subword embeddings.

A word, a pair of neighbouring words and every run of 3 to 5 characters of a word (its ends
marked) each have a learned vector, found by a hash; a word right after itself is one feature,
whatever the word. A document is the average of the
vectors of all its features; a softmax layer over it gives the probability of label 1.
Stochastic gradient descent in numpy learns both layers from a bounded sample of labels.

For scoring, a vector only counts by its product with the softmax weights, so the table that
tasks get holds one number per hash bucket: its size is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairlift.llm.common import Words, crc32_of_id, id_and_text, mix64, segment_sums, slices

BUCKETS = 1 << 18
GRAMS = (3, 4, 5)
DIM = 8
EPOCHS = 4
RATE = 0.2
VECTOR_RATE = 1000.0
SEED = 11
# The sample that training sees: so many labelled rows at most, of texts up to so many characters.
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 20_000
# Training makes the features of so many texts at a time, anew in each epoch: all of them at once would fill the driver.
SLICE_TEXTS = 64
THRESHOLD = 0.3
# Text scored at a time: its features and pairs take about fifty times as much memory.
SCORE_SLICE_BYTES = 2 << 20


def _word_features(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all features of each vocabulary word: word i has features[starts[i]:starts[i + 1]]."""
    vocabulary = words.vocabulary.to_pylist()
    n = len(vocabulary)
    points = np.frombuffer("".join(f"<{w}>" for w in vocabulary).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, vocabulary), np.int64, n) + 2
    ends = np.cumsum(size)
    word = np.repeat(np.arange(n), size)
    end = np.repeat(ends, size)
    found, owner = [words.hashes() + np.uint64(7)], [np.arange(n)]
    with np.errstate(over="ignore"):
        rolling = np.zeros(len(points), np.uint64)
        for k in range(max(GRAMS)):
            shifted = points[k:]
            rolling[: len(shifted)] = rolling[: len(shifted)] * np.uint64(0x100000001B3) + shifted
            if k + 1 in GRAMS:
                at = np.nonzero(np.arange(len(points)) + k < end)[0]
                found.append(rolling[at] + np.uint64((k + 1) << 40))
                owner.append(word[at])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    features = (mix64(np.concatenate(found)[order]) % np.uint64(buckets)).astype(np.int64)
    return features, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def _pair_features(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the pairs of neighbouring words, and the texts they are in."""
    text = words.texts_of_ids()
    here = np.nonzero(text[1:] == text[:-1])[0]
    of_word = words.hashes()
    with np.errstate(over="ignore"):
        left, right = words.ids[here], words.ids[here + 1]
        pairs = np.where(left == right, np.uint64(1), mix64(of_word[left]) + of_word[right])
    return (mix64(pairs) % np.uint64(buckets)).astype(np.int64), text[here]


def features_of(texts: pa.Array, buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, its distinct feature buckets and their share of all its features."""
    words = Words(texts, lower=False)
    features, starts = _word_features(words, buckets)
    pairs, in_text = _pair_features(words, buckets)
    bounds = np.searchsorted(in_text, np.arange(len(words.counts) + 1))
    out = []
    for i in range(len(words.counts)):
        ids, times = np.unique(words.ids[words.starts[i] : words.starts[i + 1]], return_counts=True)
        n = starts[ids + 1] - starts[ids]
        at = np.arange(n.sum()) + np.repeat(starts[ids] - (np.cumsum(n) - n), n)
        own = pairs[bounds[i] : bounds[i + 1]]
        found, where = np.unique(np.concatenate([features[at], own]), return_inverse=True)
        weight = np.bincount(where, np.concatenate([np.repeat(times, n), np.ones(len(own))]), len(found))
        out.append((found, (weight / max(weight.sum(), 1)).astype(np.float32)))
    return out


@dataclass(frozen=True)
class Model:
    """``per_bucket``: what a feature of a bucket adds to the log odds of label 1; ``bias``: the rest."""

    per_bucket: np.ndarray
    bias: float


def train(texts: list[str], labels: list[int], *, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Plain gradient descent, one text a step, the rate falling to zero; the order of rows and the start are fixed by ``seed``.

    Without rows of both labels every text gets the odds of the labels, one of each added.
    """
    ones = sum(labels)
    prior = float(np.log((ones + 1) / (len(labels) - ones + 1)))
    if not 0 < ones < len(labels):
        return Model(np.zeros(buckets, np.float32), prior)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    weights = rng.normal(0, 1, (2, dim)).astype(np.float32)
    bias = np.array([0, prior], np.float32)
    steps, step = epochs * len(texts), 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for chosen in np.split(order, range(SLICE_TEXTS, len(order), SLICE_TEXTS)):
            rows = features_of(pa.array([texts[i] for i in chosen], pa.string()), buckets)
            for i, (index, share) in zip(chosen, rows, strict=True):
                left = 1 - step / steps
                step += 1
                mean = share @ vectors[index]
                odds = weights @ mean + bias
                gradient = np.exp(odds - odds.max())
                gradient /= gradient.sum()
                gradient[labels[i]] -= 1
                vectors[index] -= (left * VECTOR_RATE) * np.outer(share, gradient @ weights)
                weights -= (left * RATE) * np.outer(gradient, mean)
                bias -= (left * RATE * 0.1) * gradient
    return Model((vectors @ (weights[1] - weights[0])).astype(np.float32), float(bias[1] - bias[0]))


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    """Probability of label 1 for each text; a text without words has the bias alone."""
    words = Words(texts, lower=False)
    buckets = len(model.per_bucket)
    features, starts = _word_features(words, buckets)
    value = model.per_bucket.astype(np.float64)
    per_word = segment_sums(value[features], starts)
    pairs, in_text = _pair_features(words, buckets)
    n = len(words.counts)
    total = words.sums(per_word[words.ids]) + np.bincount(in_text, value[pairs], n)
    count = words.sums(np.diff(starts)[words.ids]) + np.bincount(in_text, minlength=n)
    odds = model.bias + total / np.maximum(count, 1)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def scores_of_slices(texts: pa.Array, model: Model) -> np.ndarray:
    """``scores``, made for SCORE_SLICE_BYTES of text at a time; they don't depend on it."""
    whole = pa.RecordBatch.from_arrays([texts], names=["text"])
    return np.concatenate([np.zeros(0), *(scores(part.column("text"), model) for part in slices(iter([whole]), size=SCORE_SLICE_BYTES))])


def labelled_sample(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``rows`` labelled documents with crc32(id) mod 5 <> 0, those with the smallest hashed ids.

    Texts over ``chars`` characters are left out, so at most rows * chars characters reach the
    driver. A document with both labels counts as 0; of rows with the same id one is taken.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("doc_id is not null and quality in (0, 1)").filter(crc32_of_id(F.col("doc_id")) % 5 != 0)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = id_and_text(docs).filter(F.char_length("text") <= chars)
    found = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    sample = sorted(found.collect(), key=lambda r: r["doc_id"])
    return [r["text"] for r in sample], [r["quality"] for r in sample]


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    return train(*labelled_sample(docs, labels, rows=rows, chars=chars))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, size=SCORE_SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(part.column("text"), model.value))], names=["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out (its label is never learned), score, predicted (score >= ``threshold``) for each row, whole texts.

    Null and empty texts score the model's bias. A null id counts as the empty text for
    held_out. Equal texts get equal scores. No rows: no rows. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = id_and_text(docs, id_col, text_col).mapInArrow(_score(shared), "doc_id long, score double")
    return rows.select(
        "doc_id",
        (crc32_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns as they were.

    Null and empty texts score the model's bias; texts are read whole. Equal texts stay or go
    together, so repeated rows stay repeated. Ids are not looked at and may be null. No rows: no
    rows. Columns of any name pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(scores_of_slices(text, shared.value))

    return docs.filter(score(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))) >= threshold)
