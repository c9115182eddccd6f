"""Language-model scores with a log-frequency Bloom filter.

The model is a bigram over all words, the start and the end of a text. Counts of hashed pairs
are quantised on a log scale, and the filter holds (pair, 1), (pair, 2), ... up to the pair's
level. A lookup probes the levels in turn until one is missing. The probability of a word
after another one is the Dirichlet mixture of the pair's count with the word's unigram
probability; a level stands for the mean count of the corpus's pairs that have it, never for
more than the word's own count. The mass that false positives are expected to add is part of
the denominator, and hashes are added with the logarithm of the number of words, so that it
doesn't grow with them.

The filter is cut by the leading bits of a pair's hash into buckets of SEGMENTS_EACH segments, as
many as the tokens need at SEGMENT_BYTES a segment. Nobody holds all of it, and no pair
occurrence travels: a block of texts sends each of its different pairs to the pair's bucket
once, with its count in the block's training texts; the bucket fills its segments, looks all
pairs up and answers one level each. Blocks and answers meet in one more shuffle, where all of a
text's score is computed. So a pair that every text has is one entry a block. Only where ``size`` is given is the model a bounded one, whose filter
is broadcast: bigrams over the ``size`` most frequent words and one class for all others,
with a word's own unigram share of the class. V such words give at most (V + 3)^2 pairs, and
N tokens at most pairs * (1 + log(N / pairs) / log(base)) entries: for V = 2048 and 2 * 10^13
tokens (about 100 TB of text) 39 million levels a million pairs, 300 MB in all.

Unigram counts of all words are exact. They stay in a table: the most frequent ones, at most
``hot_words`` short words, go to the tasks, all others are joined by word, once for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pairlift.llm.common import Words, crc32_of_id, id_and_text, mix64, slices, staged
from pairlift.session import shuffle_partitions

HOT_WORDS = 400_000
HOT_WORD_BYTES = 64
BASE = 1.5
HASHES = 10
BITS_PER_ENTRY = 14.5
SEGMENT_BYTES = 1 << 20
DIRICHLET = 300.0
# A task hands on its pair counts when it holds so many different pairs.
PAIRS_HELD = 2_000_000
# Words for which HASHES hashes are enough; each doubling takes one more.
WORDS_PER_HASHES = 2048
# Segments of a bucket; it has about SEGMENT_BYTES for each of them, at most.
SEGMENTS_EACH = 8
# Bits of a pair's hash that a bucket looks at; 10^6 pairs there make one of 10^8 absent ones look like another.
KEY_BITS = 48
START, END = np.uint64(1), np.uint64(2)


def level_of(count: np.ndarray) -> np.ndarray:
    """Quantised count: 1 + floor(log_BASE(count)), 0 for 0."""
    return np.where(count > 0, 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(BASE) + 1e-9), 0).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle of the counts that have a level."""
    return np.where(level > 0, (BASE ** (level - 1.0) + np.maximum(BASE ** (1.0 * level) - 1, BASE ** (level - 1.0))) / 2, 0.0)


class LogFrequencyFilter:
    """Levels of keys in a Bloom filter of segments of one size; a key and all its levels are in one segment."""

    def __init__(self, segments: np.ndarray, hashes: int = HASHES):
        self.segments = segments
        self.hashes = hashes

    @staticmethod
    def segment_of(keys: np.ndarray, n_segments: int) -> np.ndarray:
        return (mix64(keys ^ np.uint64(0x5BF03635)) % np.uint64(n_segments)).astype(np.int64)

    @staticmethod
    def _first_and_step(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            first = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level))
            return first, mix64(first ^ np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)

    @staticmethod
    def _bit(first: np.ndarray, step: np.ndarray, k: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((first + np.uint64(k) * step) >> np.uint64(16)).astype(np.int64) % bits

    @classmethod
    def _bits(cls, keys: np.ndarray, level: int, bits: int, hashes: int = HASHES) -> Iterator[np.ndarray]:
        first, step = cls._first_and_step(keys, level)
        for k in range(hashes):
            yield cls._bit(first, step, k, bits)

    @classmethod
    def add(cls, segment: np.ndarray, keys: np.ndarray, levels: np.ndarray) -> None:
        """Enter keys, all of this segment, with their levels."""
        for level in range(1, int(levels.max(initial=0)) + 1):
            for bit in cls._bits(keys[levels >= level], level, 8 * len(segment)):
                np.bitwise_or.at(segment, bit >> 3, (1 << (bit & 7)).astype(np.uint8))

    @classmethod
    def segment(cls, keys: np.ndarray, levels: np.ndarray, hashes: int) -> np.ndarray:
        """A segment of the size that these keys and levels need."""
        bits = 8 * max(64, int(np.ceil(levels.sum() * hashes * BITS_PER_ENTRY / HASHES / 8)))
        marks = np.zeros(bits, bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            for bit in cls._bits(keys[levels >= level], level, bits, hashes):
                marks[bit] = True
        return np.packbits(marks, bitorder="little")

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: as many probes as it takes until one misses."""
        out = np.zeros(len(keys), np.int64)
        if not len(self.segments):
            return out
        where = self.segment_of(keys, len(self.segments))
        left = np.arange(len(keys))
        level = 1
        while len(left):
            first, step = self._first_and_step(keys[left], level)
            for k in range(self.hashes):
                bit = self._bit(first, step, k, 8 * self.segments.shape[1])
                hit = (self.segments[where[left], bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
                if not hit.all():
                    left, first, step = left[hit], first[hit], step[hit]
            out[left] = level
            level += 1
        return out


@dataclass
class Vocabulary:
    """Classes of words: 0 any other, 1 end, 2 start (never predicted), from 3 on the words of ``classes``.

    ``counts``: exact counts of the hot words, those of the vocabulary among them; ``tokens``
    and ``distinct`` are those of all training text, ends included.
    """

    classes: dict[str, int]
    counts: dict[str, int]
    ends: int
    tokens: int
    distinct: int

    @property
    def size(self) -> int:
        return len(self.classes) + 3

    def log_base(self, count):
        """log10 of the smoothed unigram probability of a word seen ``count`` times."""
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def class_share(self) -> np.ndarray:
        """Unigram probability of each class."""
        total = self.tokens + 0.5 * (self.distinct + 1)
        inside = np.zeros(self.size)
        for word, c in self.classes.items():
            inside[c] = self.counts[word] + 0.5
        inside[1] = self.ends + 0.5
        known = sum(self.counts[w] for w in self.classes)
        others = self.tokens - self.ends - known + 0.5 * (self.distinct - (self.ends > 0) - len(self.classes) + 1)
        inside[0] = others
        return inside / total

    def class_ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Classes of all texts, each from its start to its end, and where each text begins."""
        of_word = np.fromiter((self.classes.get(w, 0) for w in words.vocabulary.to_pylist()), np.int64, len(words.vocabulary))
        n = len(words.counts)
        starts = words.starts[:-1] + 2 * np.arange(n)
        ids = np.empty(len(words.ids) + 2 * n, np.int64)
        inside = np.ones(len(ids), bool)
        ids[starts], inside[starts] = 2, False
        ends = starts + words.counts + 1
        ids[ends], inside[ends] = 1, False
        ids[inside] = of_word[words.ids]
        return ids, np.append(starts, len(ids))


@dataclass
class Model:
    vocabulary: Vocabulary
    filter: LogFrequencyFilter
    # Sum of the dequantised counts of each class's pairs.
    context: np.ndarray
    false_positive: float = field(default=2.0**-HASHES)

    def log_pair(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """log10 probability of each class after each class."""
        pairs, where = np.unique(before * self.vocabulary.size + after, return_inverse=True)
        count = count_of(self.filter.levels(pairs.astype(np.uint64)))
        h, w = np.divmod(pairs, self.vocabulary.size)
        total = self.context[h] + DIRICHLET + self.false_positive * (self.vocabulary.size - 1)
        return np.log10((count + DIRICHLET * self.vocabulary.class_share()[w]) / total)[where]


def is_held_out(doc_id):
    return crc32_of_id(doc_id) % 5 == 1


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each slice; the empty word stands for ends of texts."""
    for part in slices(batches):
        words = Words(part.column("text"), lower=True)
        n = np.bincount(words.ids, minlength=len(words.vocabulary))
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([words.vocabulary.cast(pa.string()), pa.array([""], pa.string())]), pa.array(np.append(n, part.num_rows), pa.int64())], names=["word", "n"]
        )


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all texts, as a written table."""
    counts = texts.select("text").mapInArrow(_count_words, "word string, n long")
    return _summed_words(counts)


def _summed_words(counts: DataFrame) -> DataFrame:
    return staged(counts.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def vocabulary(counts: DataFrame, *, size: int = 0, hot_words: int = HOT_WORDS) -> Vocabulary:
    """The ``size`` most frequent short words, equal counts by word, hot words by whole steps of the count scale, and the totals."""
    step = F.floor(F.log2("n") * 8).cast("int")
    short = (F.octet_length("word") <= HOT_WORD_BYTES) & (F.col("word") != "")
    steps = counts.groupBy(step.alias("step")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"), F.count(F.when(short, 1)).alias("short"), F.sum(F.when(F.col("word") == "", F.col("n"))).alias("ends")
    )
    rows = sorted(steps.collect(), key=lambda r: -r["step"])  # at most 8 * 64 rows
    taken, lowest = 0, 1 << 10
    for r in rows:
        taken += r["short"]
        if taken > hot_words:
            break
        lowest = r["step"]
    # As Arrow columns: row objects would take several times the memory.
    hot = counts.filter(short & (step >= lowest)).select("word", "n").toArrow()
    top = {r["word"]: r["n"] for r in counts.filter(short).orderBy(F.desc("n"), "word").limit(size).collect()} if size else {}
    return Vocabulary(
        {w: i for i, w in enumerate(sorted(top), 3)},
        dict(zip(hot.column("word").to_pylist(), hot.column("n").to_pylist(), strict=True)) | top,
        sum(r["ends"] or 0 for r in rows),
        sum(r["n"] for r in rows),
        sum(r["words"] for r in rows),
    )


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the sums of their numbers."""
    keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    n = np.concatenate([n for _, n in held])
    return keys, np.bincount(where, n).astype(n.dtype)


def _count_pairs(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        for part in slices(batches):
            ids, starts = known.class_ids(Words(part.column("text"), lower=True))
            pairs = ids[:-1] * known.size + ids[1:]
            keys, n = np.unique(np.delete(pairs, starts[1:-1] - 1), return_counts=True)
            held.append((keys, n))
            if sum(len(k) for k, _ in held) > PAIRS_HELD:
                held = [_summed(held)]
                if len(held[0][0]) > PAIRS_HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held.pop()], names=["pair", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _summed(held)], names=["pair", "n"])

    return run


def _fill_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (segment, pair, n) come sorted by segment."""
    now, bits = None, None
    for batch in batches:
        segment = batch.column("segment").to_numpy()
        keys = batch.column("pair").to_numpy().astype(np.uint64)
        levels = level_of(batch.column("n").to_numpy())
        bounds = np.flatnonzero(np.diff(segment)) + 1 if len(segment) else []
        for a, b in zip([0, *bounds], [*bounds, len(segment)], strict=True):
            if a == b:
                continue
            if now is not None and now != segment[a]:
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([bits.tobytes()], pa.binary())], names=["segment", "bits"])
            if now != segment[a]:
                now, bits = int(segment[a]), np.zeros(SEGMENT_BYTES, np.uint8)
            LogFrequencyFilter.add(bits, keys[a:b], levels[a:b])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([bits.tobytes()], pa.binary())], names=["segment", "bits"])


def _segments(n_segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = LogFrequencyFilter.segment_of(batch.column("pair").to_numpy().astype(np.uint64), n_segments)
            yield pa.RecordBatch.from_arrays([pa.array(where), batch.column("pair"), batch.column("n")], names=["segment", "pair", "n"])

    return run


def fit(texts: DataFrame, counts: DataFrame, *, size: int, hot_words: int = HOT_WORDS) -> Model:
    """The bounded model of ``texts`` (text), whose ``word_counts`` are ``counts``. Tasks fill segments of the filter; the driver joins them."""
    known = vocabulary(counts, size=size, hot_words=hot_words)
    spark = texts.sparkSession
    pairs = texts.select("text").mapInArrow(_count_pairs(spark.sparkContext.broadcast(known)), "pair long, n long")
    pairs = staged(pairs.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    # The same levels as level_of, whose rounding decides; this one only sizes the filter and the contexts.
    level = 1 + F.floor(F.log("n") / np.log(BASE) + 1e-9)
    power = lambda e: F.pow(F.lit(BASE), e)
    middle = (power(level - 1) + F.greatest(power(level) - 1, power(level - 1))) / 2
    rows = pairs.groupBy(F.expr(f"pair div {known.size}").alias("h")).agg(F.sum(middle).alias("total"), F.sum(level).alias("entries")).collect()
    context = np.zeros(known.size)
    for r in rows:  # at most one row for each class
        context[r["h"]] = r["total"]
    n_segments = max(1, int(np.ceil(sum(r["entries"] for r in rows) * BITS_PER_ENTRY / 8 / SEGMENT_BYTES)))
    placed = pairs.mapInArrow(_segments(n_segments), "segment long, pair long, n long")
    filled = placed.repartition("segment").sortWithinPartitions("segment").mapInArrow(_fill_segments, "segment long, bits binary")
    bits = np.zeros((n_segments, SEGMENT_BYTES), np.uint8)
    for r in filled.toLocalIterator():
        bits[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    return Model(known, LogFrequencyFilter(bits), context)


_SCORED_DDL = "uid long, doc_id long, n_tokens long, known long, base double, score double, rest array<string>, times array<long>"
_SCORED = pa.schema(
    [("uid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
     ("rest", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))]
)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = model.vocabulary
        log_other = np.log10(known.class_share()[0])
        for part in slices(batches):
            words = Words(part.column("text"), lower=True)
            n = part.num_rows
            vocabulary_ = words.vocabulary.to_pylist()
            count = np.fromiter((known.counts.get(w, -1) for w in vocabulary_), np.int64, len(vocabulary_))
            log_word = np.where(count >= 0, known.log_base(np.maximum(count, 0)), 0.0)
            base = words.sums(log_word[words.ids]) + known.log_base(known.ends)
            ids, starts = known.class_ids(words)
            text = np.repeat(np.arange(n), words.counts + 2)
            inner = np.flatnonzero(ids != 2)
            score = np.bincount(text[inner], model.log_pair(ids[inner - 1], ids[inner]), n)
            other = np.array([w not in known.classes for w in vocabulary_], bool)[words.ids]
            score += words.sums(np.where(other, log_word[words.ids] - log_other, 0.0))
            # Words that are not hot: each with its times in the text, for the join.
            cold = np.flatnonzero(count[words.ids] < 0)
            pairs, times = np.unique(words.texts_of_ids()[cold] * len(vocabulary_) + words.ids[cold], return_counts=True)
            in_text, word = np.divmod(pairs, max(len(vocabulary_), 1))
            offsets = pa.array(np.searchsorted(in_text, np.arange(n + 1)), pa.int32())
            columns = [
                part.column("uid"),
                part.column("doc_id"),
                pa.array(words.counts + 1),
                pa.array(words.sums((count[words.ids] > 0).astype(np.int64)) + (known.ends > 0)),
                pa.array(base),
                pa.array(score),
                pa.ListArray.from_arrays(offsets, words.vocabulary.take(pa.array(word)).cast(pa.string())),
                pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_SCORED)

    return run


def _byte_numbers(at: np.ndarray) -> np.ndarray:
    """A number for each byte at its place (place * 256 + byte)."""
    with np.errstate(over="ignore"):
        return mix64(mix64(at.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + np.uint64(0x5BF03635))


# Those of a word's first 64 bytes.
FIRST_BYTES = _byte_numbers(np.arange(64 * 256))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word (none is empty): the sum of a number for every byte at its place, mixed."""
    if not len(words):
        return np.zeros(0, np.uint64)
    packed = words.cast(pa.binary())
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    data = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    at = (np.arange(len(data)) - np.repeat(starts, sizes)) << 8 | data
    numbers = FIRST_BYTES[np.minimum(at, len(FIRST_BYTES) - 1)]
    far = np.flatnonzero(at >= len(FIRST_BYTES))
    numbers[far] = _byte_numbers(at[far])
    with np.errstate(over="ignore"):
        return mix64(np.add.reduceat(numbers, starts) + sizes.astype(np.uint64))


def word_pairs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word and end: hash of the pair with what is before it, number of its text, and its word (-1: an end)."""
    n = len(words.counts)
    starts = words.starts[:-1] + np.arange(n)
    word = np.full(len(words.ids) + n, -1)
    inside = np.ones(len(word), bool)
    inside[starts + words.counts] = False
    word[inside] = words.ids
    after = np.full(len(word), END)
    after[inside] = word_hashes(words.vocabulary)[words.ids]
    before = np.roll(after, 1)
    before[starts] = START
    with np.errstate(over="ignore"):
        keys = mix64(mix64(before) * np.uint64(0x9E3779B97F4A7C15) + after)
    return keys, np.repeat(np.arange(n), words.counts + 1), word


_BLOCKS_DDL = "block long, rows binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each slice as one compressed Arrow stream, under a number of its own."""
    task = TaskContext.get().partitionId()
    for i, part in enumerate(slices(batches)):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(part)
        yield pa.RecordBatch.from_arrays([pa.array([(task << 33) + i], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])


def _opened(rows: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(rows).read_next_batch()


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        for block, rows in zip(batch.column("block").to_pylist(), batch.column("rows"), strict=True):
            yield block, _opened(rows.as_py())


def _count_training_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_count_words`` of the training rows of blocks."""
    return _count_words(rows.filter(pc.invert(rows.column("held_out"))) for _, rows in _each_block(batches))


@dataclass(frozen=True)
class Buckets:
    """Keys by their leading ``bits``, and the KEY_BITS after them by which a bucket tells its keys apart."""

    bits: int

    @property
    def rest(self) -> int:
        return min(KEY_BITS, 64 - self.bits)

    def cut(self, keys: np.ndarray) -> np.ndarray:
        """Keys without the bits that aren't looked at; their order is that of buckets."""
        return keys >> np.uint64(64 - self.bits - self.rest)

    def split(self, cut: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(bucket, from, to) of each bucket in sorted cut keys."""
        bucket = (cut >> np.uint64(self.rest)).astype(np.int64)
        bounds = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), len(cut)], strict=True):
            if a < b:
                yield int(bucket[a]), a, b


def _packed(cut: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys of a bucket and their counts byte by byte, the same byte of all keys together."""
    keys = cut.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]
    counts = counts.astype("<u4").view(np.uint8).reshape(-1, 4)
    return pa.Codec("zstd").compress(keys.T.tobytes() + counts.T.tobytes(), asbytes=True)


def _unpacked(packed: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys less their bucket, and counts."""
    wide = KEY_BITS // 8
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed, (wide + 4) * n), np.uint8).reshape(wide + 4, n)
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :wide] = planes[:wide].T
    return keys.view("<u8")[:, 0], np.ascontiguousarray(planes[wide:].T).view("<u4")[:, 0].astype(np.int64)


_ASKED_DDL = "bucket long, block long, n long, keys binary"
_ASKED = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("keys", pa.binary())])


def _ask(buckets: Buckets):
    """Each block's different pairs, one row a bucket, with their counts in its training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _each_block(batches):
            keys, text, _ = word_pairs(Words(rows.column("text"), lower=True))
            keys = buckets.cut(keys)
            trains = ~rows.column("held_out").to_numpy(zero_copy_only=False)
            trained, times = np.unique(keys[trains[text]], return_counts=True)
            keys = np.unique(keys)
            counts = np.zeros(len(keys), np.int64)
            counts[np.searchsorted(keys, trained)] = times
            mask = np.uint64((1 << buckets.rest) - 1)
            out = [(bucket, block, b - a, _packed(keys[a:b] & mask, counts[a:b])) for bucket, a, b in buckets.split(keys)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ASKED, strict=True)], schema=_ASKED)

    return run


_LEVELS_DDL = "block long, bucket long, n long, levels binary, pairs array<long>, total array<long>"
_LEVELS = pa.schema(
    [("block", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("levels", pa.binary()), ("pairs", pa.list_(pa.int64())), ("total", pa.list_(pa.int64()))]
)


def _answer(hashes: int, rest: int):
    """Fill each bucket's filter with the pairs of all blocks and answer each block with the levels found there.

    A row without a block has the number of a bucket's pairs and the sum of their counts at
    each level. Rows come sorted by bucket.
    """

    def answers(bucket: int, held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        parts = [_unpacked(packed, n) for _, n, packed in held]
        keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        # Counts as doubles are exact up to 2^53.
        counts = np.bincount(where, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)
        levels = level_of(counts)
        found = np.zeros(len(keys), np.uint8)
        edges = np.searchsorted(keys, (np.arange(1, SEGMENTS_EACH, dtype=np.uint64) << np.uint64(rest)) // np.uint64(SEGMENTS_EACH))
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
            if (entered := np.flatnonzero(counts[a:b]) + a).size:
                segment = LogFrequencyFilter.segment(keys[entered], levels[entered], hashes)
                found[a:b] = LogFrequencyFilter(segment[None, :], hashes).levels(keys[a:b])
        found = found[where]
        ends = np.cumsum([n for _, n, _ in held]).tolist()
        seen = levels > 0
        out = [(block, bucket, n, pa.Codec("zstd").compress(found[end - n : end].tobytes(), asbytes=True), None, None) for (block, n, _), end in zip(held, ends, strict=True)]
        out.append((None, bucket, 0, None, np.bincount(levels[seen]).tolist(), np.bincount(levels[seen], counts[seen]).astype(np.int64).tolist()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _LEVELS, strict=True)], schema=_LEVELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, block, n, keys in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "n", "keys")), strict=True):
                if held and now != bucket:
                    yield answers(now, held)
                    held = []
                now = bucket
                held.append((block, n, keys))
        if held:
            yield answers(now, held)

    return run


def _cold_words(shared):
    """(block, place, word) of each block's words whose counts the tasks don't have; a place is one in the block's vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for block, rows in _each_block(batches):
            vocabulary_ = Words(rows.column("text"), lower=True).vocabulary
            place = np.flatnonzero(np.fromiter((w not in known.counts for w in vocabulary_.to_pylist()), bool, len(vocabulary_)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(place), block)), pa.array(place), vocabulary_.take(pa.array(place)).cast(pa.string())], names=["block", "place", "word"]
            )

    return run


_SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score_blocks(shared, means: np.ndarray, buckets: Buckets, false_mass: float):
    """Scores of each block's rows; its rows come first, then its cold words' counts, then its pairs' levels by bucket."""

    def scores(rows: bytes, places: list[np.ndarray], counts: list[np.ndarray], levels: list[bytes]) -> pa.RecordBatch:
        known = shared.value
        part = _opened(rows)
        words = Words(part.column("text"), lower=True)
        count = np.fromiter((known.counts.get(w, 0) for w in words.vocabulary.to_pylist()), np.int64, len(words.vocabulary))
        if places:
            count[np.concatenate(places)] = np.concatenate(counts)
        keys, text, word = word_pairs(words)
        keys = buckets.cut(keys)
        different = np.unique(keys)
        level = np.frombuffer(b"".join(levels), np.uint8)
        if len(level) != len(different):
            raise ValueError(f"{len(different)} pairs were asked, {len(level)} answered")
        found = means[np.minimum(level, len(means) - 1)][np.searchsorted(different, keys)]
        n = np.append(count, known.ends)[word]
        total = known.tokens + 0.5 * (known.distinct + 1)
        # What a word's unigram probability counts for is DIRICHLET / total * (n + 0.5).
        pairs = np.bincount(text, np.log10(1 + np.minimum(found, n) / (DIRICHLET / total * (n + 0.5))), part.num_rows)
        added = DIRICHLET + false_mass
        base = words.sums(known.log_base(count)[words.ids]) + known.log_base(known.ends)
        contexts = words.sums(np.log10(count + added)[words.ids]) + np.log10(known.ends + added)
        n_tokens = words.counts + 1
        columns = [
            part.column("doc_id"), part.column("held_out"), pa.array(n_tokens), pa.array(words.sums((count > 0).astype(np.int64)[words.ids]) + (known.ends > 0)),
            pa.array(base), pa.array(base + n_tokens * np.log10(DIRICHLET) - contexts + pairs),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, places, counts, levels = None, [], [], []
        for batch in batches:
            kind, place, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "place", "n"))
            at = 0
            while at < batch.num_rows:
                if kind[at] == 0:
                    if rows is not None:
                        yield scores(rows, places, counts, levels)
                    rows, places, counts, levels = batch.column("packed")[at].as_py(), [], [], []
                    at += 1
                elif kind[at] == 1:
                    others = np.flatnonzero(kind[at:] != 1)
                    stop = at + int(others[0]) if len(others) else batch.num_rows
                    places.append(place[at:stop].copy())
                    counts.append(n[at:stop].copy())
                    at = stop
                else:
                    levels.append(pa.Codec("zstd").decompress(batch.column("packed")[at].as_py(), int(n[at]), asbytes=True))
                    at += 1
        if rows is not None:
            yield scores(rows, places, counts, levels)

    return run


def _score_all(tagged: DataFrame, hot_words: int) -> tuple[Vocabulary, DataFrame]:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of ``tagged`` by the model of all pairs of its training rows."""
    spark = tagged.sparkSession
    partitions = shuffle_partitions(spark)
    blocks = staged(tagged.mapInArrow(_blocks, _BLOCKS_DDL), "blocks")
    counts = _summed_words(blocks.mapInArrow(_count_training_words, "word string, n long"))
    known = vocabulary(counts, hot_words=hot_words)
    shared = spark.sparkContext.broadcast(known)
    hashes = HASHES + max(0, int(np.ceil(np.log2(max(known.distinct, 1) / WORDS_PER_HASHES))))
    # A pair's level is at most its count, so there are at most as many entries as tokens.
    bound = known.tokens * hashes * BITS_PER_ENTRY / HASHES / 8
    buckets = Buckets(int(np.ceil(np.log2(max(partitions, bound / (SEGMENTS_EACH * SEGMENT_BYTES), 2)))))
    asked = blocks.mapInArrow(_ask(buckets), _ASKED_DDL).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    levels = staged(asked.mapInArrow(_answer(hashes, buckets.rest), _LEVELS_DDL), "levels")
    steps = levels.filter("block IS NULL").select(F.posexplode(F.arrays_zip("pairs", "total")).alias("level", "x"))
    rows = steps.groupBy("level").agg(F.sum("x.pairs").alias("pairs"), F.sum("x.total").alias("total")).collect()  # a row for each level
    means = np.zeros(1 + max((r["level"] for r in rows), default=0))
    for r in rows:
        means[r["level"]] = r["total"] / max(r["pairs"], 1)
    cold = blocks.mapInArrow(_cold_words(shared), "block long, place long, word string").join(counts, "word")
    none = F.lit(None)
    parts = blocks.select("block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("n"), F.col("rows").alias("packed"))
    parts = parts.unionByName(cold.select("block", F.lit(1).alias("kind"), "place", "n", none.cast("binary").alias("packed")))
    parts = parts.unionByName(levels.filter("block IS NOT NULL").select("block", F.lit(2).alias("kind"), F.col("bucket").alias("place"), "n", F.col("levels").alias("packed")))
    parts = parts.repartition(partitions, "block").sortWithinPartitions("block", "kind", "place")
    # The count that false positives are expected to add to a word's followers.
    false_mass = 2.0**-hashes * known.distinct
    return known, parts.mapInArrow(_score_blocks(shared, means, buckets, false_mass), _SCORES_DDL)


def score(docs: DataFrame, *, size: int | None = None, hot_words: int = HOT_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows by the model of those with crc32(id) mod 5 <> 1.

    Columns: doc_id, held_out, n_tokens (words and one end), n_known (seen in training),
    train_tokens, base_score (unigrams), score (the model's log10 probability of the text).
    A null or empty text is its end alone. Repeated rows count as often as they come. A null id
    counts as the empty text for held_out. Without training text every word has unigram
    probability 1. No rows: no rows. Other columns are not looked at. All word pairs are
    counted, unless ``size`` asks for the bounded model.
    """
    tagged = id_and_text(docs, id_col, text_col)
    if size is None:
        known, found = _score_all(tagged.withColumn("held_out", is_held_out(F.col("doc_id"))), hot_words)
        return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(known.tokens).cast("long").alias("train_tokens"), "base_score", "score")
    tagged = tagged.withColumn("uid", F.monotonically_increasing_id())
    training = tagged.filter(~is_held_out(F.col("doc_id"))).select("text")
    counts = word_counts(training)
    model = fit(training, counts, size=size, hot_words=hot_words)
    known = model.vocabulary
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = staged(tagged.select("uid", "doc_id", "text").mapInArrow(_score(shared), _SCORED_DDL), "scored")
    rest = scored.select("uid", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("uid", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    log_total = float(np.log10(known.tokens + 0.5 * (known.distinct + 1)))
    found = rest.join(counts, "word", "left").select(
        "uid",
        "times",
        (F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 0.5) - log_total)).alias("log"),
        F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("seen"),
    )
    added = found.groupBy("uid").agg(F.sum("log").alias("log"), F.sum("seen").alias("seen"), F.sum("times").alias("times"))
    log_other = float(np.log10(known.class_share()[0]))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.drop("rest", "times").join(added, "uid", "left").select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + zero("seen")).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("log")).alias("base_score"),
        (F.col("score") + zero("log")).alias("score"),
    )
