"""Best-fit packing of token pieces into sequences of a fixed capacity.

Only the number of pieces of each length decides how bins are filled, so the packer works
on a table of at most ``capacity`` counts, whatever the size of the corpus: it makes
patterns (lengths that share a bin) with the number of bins of each. Then every piece gets
its place from its rank among the pieces of its length.

A pattern is filled greedily, the largest length that still fits first. Then the bin's
smallest piece makes room for two unpacked pieces, if two fit its expanded gap more
tightly. A pattern is repeated until one of its lengths runs out, so there are at most
about capacity * ln(capacity) patterns; that bounds the one table that is broadcast.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from pairlift.llm.common import id_and_text, slices, staged
from pairlift.session import shuffle_partitions

CAPACITY = 4096
END_ID = 1
# Rows of one length are ranked in buckets of about this many.
BUCKET_ROWS = 50_000
# Text tokenised at a time: its chunks, ids and their places take many times as much memory.
TOKEN_SLICE_BYTES = 4 << 20

_PIECES = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
_PIECES_DDL = "uid long, doc_id long, piece int, start long, length long, ids binary"

# Where a word ends before marks that end the chunk: the tokenizer parts them, so a space there changes nothing
# unless what it makes of the last letter ends in a combining mark, which goes with the marks.
WORD_END = r"([\p{L}\p{N}])([.,;:!?]+)( |$)"
# Lower-case letters that are their own normal form.
PLAIN_WORD = r"^[a-zß-öø-ÿ]+$"
# Chunks in a call of the tokenizer.
CALL_CHUNKS = 2048


@lru_cache(maxsize=4)
def joining_letters(tokenizer) -> str | None:
    """A pattern of the letters and digits whose normal form in ``tokenizer`` doesn't end in a letter or digit; None: there are none."""
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] in "LN"]
    forms = tokenizer.normalizer.normalize_str(" ".join(letters)).split(" ") if tokenizer.normalizer else letters
    if len(forms) != len(letters):
        raise ValueError("the tokenizer's normaliser makes white space of letters")
    joining = [a for a, form in zip(letters, forms, strict=True) if not form or unicodedata.category(form[-1])[0] not in "LN"]
    return "[" + "".join(joining) + "]" if joining else None


def closing_ids(tokenizer) -> np.ndarray | None:
    """For each id, whether it closes a word; None: the tokenizer doesn't mark that."""
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    if not suffix:
        return None
    vocabulary = tokenizer.get_vocab()
    closes = np.zeros(max(vocabulary.values()) + 1, bool)
    closes[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
    return closes


class ChunkTokenizer:
    """Token ids of texts whose tokenizer drops white space and never joins what it parts, nor words and marks.

    Each different chunk between spaces, line feeds and ends of words goes to the tokenizer once, words of plain letters many in
    a call; the ids of later ones come from a table that is emptied when it holds more than ``keep`` chunks. A text that holds an added token of the file
    (``<|endoftext|>``), in its letter case, goes to the tokenizer whole, so that the token gets its own id.
    """

    def __init__(self, path: str, keep: int = 600_000):
        # Spark's tasks have the cores; the library's threads on top of them only cost.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.added = "|".join(re.escape(t) for t in added) if added else None
        # Of chunks: none holds an added token, but lower-casing could make one of <|ENDOFTEXT|>.
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = "A B C D E F G H I J K L M N O P Q R S T U V W X Y Z"
        self.lower_cases = self.tokenizer.encode(letters).ids == self.tokenizer.encode(letters.lower()).ids
        self.joining = joining_letters(self.whole)
        self.closes = closing_ids(self.whole)
        self.keep = keep
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def _rows(self, chunks: pa.Array) -> np.ndarray:
        """Row of each chunk in the table; unknown ones are encoded first."""
        if len(self.known) > self.keep:
            self._clear()
        rows = pc.fill_null(pc.index_in(chunks, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            unknown = chunks.take(pa.array(missing)).cast(pa.string())
            new = unknown.unique()
            # Words of plain letters come first: they are encoded together.
            plain = pc.match_substring_regex(new, PLAIN_WORD)
            words, others = new.filter(plain), new.filter(pc.invert(plain))
            new = pa.concat_arrays([words, others])
            coded = [self._words(words.to_pylist()), self._separate(others.to_pylist())]
            rows[missing] = len(self.known) + pc.index_in(unknown, value_set=new).to_numpy(zero_copy_only=False)
            self.known = pa.concat_arrays([self.known, new])
            self.ids = np.concatenate([self.ids, *(ids for ids, _ in coded)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate([sizes for _, sizes in coded]))])
        return rows

    def _separate(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks and the number of each, by a call of the tokenizer for each."""
        ids, sizes = [np.zeros(0, np.uint32)], []
        for i in range(0, len(chunks), CALL_CHUNKS):
            coded = [c.ids for c in self.tokenizer.encode_batch_fast(chunks[i : i + CALL_CHUNKS], add_special_tokens=False)]
            sizes += map(len, coded)
            ids.append(np.fromiter(chain.from_iterable(coded), np.uint32))
        return np.concatenate(ids), np.array(sizes, np.int64)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words of plain letters, many in a call: the last id of each is one that closes a word."""
        if self.closes is None:
            return self._separate(words)
        out = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        for i in range(0, len(words), CALL_CHUNKS):
            part = words[i : i + CALL_CHUNKS]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            # A word that is parted, or has no such id, shows in their number.
            fits = len(ends) == len(part) and ends[-1] == len(ids)
            out.append((ids, np.diff(ends, prepend=0)) if fits else self._separate(part))
        return np.concatenate([ids for ids, _ in out]), np.concatenate([sizes for _, sizes in out])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (uint32), as the tokenizer gives them with add_special_tokens=False."""
        if self.added is None:
            return self._by_chunks(texts)
        holds = pc.match_substring_regex(texts, self.added)
        whole = np.flatnonzero(pc.fill_null(holds, False).to_numpy(zero_copy_only=False))
        if not len(whole):
            return self._by_chunks(texts)
        ids = self._by_chunks(pc.if_else(holds, "", texts))
        for i in whole.tolist():
            ids[i] = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return ids

    def _by_chunks(self, texts: pa.Array) -> list[np.ndarray]:
        # The tokenizer lower-cases; doing so for A-Z first leaves fewer different chunks. It composes letters
        # and marks before, so letters with a mark of their own stay as they are.
        if self.lower_cases:
            texts = pc.if_else(pc.match_substring_regex(texts, r"[A-Z]\p{M}"), texts, pc.ascii_lower(texts))
        texts = pc.replace_substring(texts, "\n", " ")
        parted = pc.replace_substring_regex(texts, WORD_END, r"\1 \2\3")
        texts = parted if self.joining is None else pc.if_else(pc.match_substring_regex(texts, self.joining), texts, parted)
        lists = pc.split_pattern(texts, " ")
        counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        row = self._rows(lists.flatten())
        first, n = self.ends[row], self.ends[row + 1] - self.ends[row]
        done = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.arange(done[-1]) + np.repeat(first - done[:-1], n)]
        bounds = done[np.concatenate([[0], np.cumsum(counts)])]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@lru_cache(maxsize=1)
def worker_tokenizer(path: str) -> ChunkTokenizer:
    """One for each Python worker, kept from task to task: the table of chunks doesn't begin empty in every task."""
    return ChunkTokenizer(path)


def _tokenize(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(path)
        for part in slices(batches, size=TOKEN_SLICE_BYTES):
            out: list[tuple] = []
            encoded = tokenizer.encode(part.column("text"))
            for uid, doc_id, ids in zip(part.column("uid").to_pylist(), part.column("doc_id").to_pylist(), encoded, strict=True):
                whole = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(whole), capacity)):
                    cut = whole[start : start + capacity]
                    out.append((uid, doc_id, piece, start, len(cut), cut.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, piece, start, length, ids) of all documents: ids as little-endian unsigned 32-bit binary.

    A document's ids end with ``end_id``; only longer ones are cut, into pieces of ``capacity``
    ids, of which the last may be shorter. A null or empty text has the end id alone.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    tagged = id_and_text(docs, id_col, text_col).withColumn("uid", F.monotonically_increasing_id())
    return tagged.mapInArrow(_tokenize(tokenizer_path, capacity, end_id), _PIECES_DDL)


def fill_patterns(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a bin, largest first) and how many bins each fills, for ``counts`` pieces per length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        left[length] = n
    index = np.arange(capacity + 1)
    out: list[tuple[list[int], int]] = []
    # fit[x]: the largest length with unpacked pieces that is at most x, 0 if there is none.
    fit = np.maximum.accumulate(np.where(left > 0, index, 0))
    while fit[capacity]:
        bin_, gap = [], capacity
        used: Counter[int] = Counter()

        def free(x: int) -> int:
            # The few lengths that this bin has used up itself are skipped.
            length = int(fit[x])
            while length and left[length] <= used[length]:
                length = int(fit[length - 1])
            return length

        while length := free(gap):
            bin_.append(length)
            used[length] += 1
            gap -= length
        while gap and len(bin_) > 1:
            pair = _tighter_pair(bin_[-1], gap, left, used, index)
            if pair is None:
                break
            used[bin_[-1]] -= 1
            used.update(pair)
            gap += bin_.pop() - sum(pair)
            bin_ = sorted([*bin_, *pair], reverse=True)
        times = min(int(left[length]) // n for length, n in used.items() if n)
        out.append((bin_, times))
        for length, n in used.items():
            left[length] -= n * times
        if any(not left[length] for length in used):
            fit = np.maximum.accumulate(np.where(left > 0, index, 0))
    return out


def _tighter_pair(smallest: int, gap: int, left: np.ndarray, used: Counter, index: np.ndarray) -> tuple[int, int] | None:
    """Two unpacked lengths that fill the gap without ``smallest`` better than it does; None if there are none."""
    room = gap + smallest
    spare = left[: room + 1].copy()
    for length, n in used.items():
        if length <= room:
            spare[length] -= n - (length == smallest)
    best = np.maximum.accumulate(np.where(spare > 0, index[: room + 1], 0))
    a = index[: room + 1][spare > 0]
    b = best[room - a]
    b = np.where((b == a) & (spare[a] < 2), best[np.maximum(a - 1, 0)], b)
    total = np.where(b > 0, a + b, 0)
    if not len(a) or total.max() <= smallest:
        return None
    at = int(total.argmax())
    return int(a[at]), int(b[at])


def _slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces of it in a bin, their first offset) of all patterns."""
    rank: Counter[int] = Counter()
    out, sequence = [], 0
    for bin_, times in patterns:
        offset = 0
        for length, n in sorted(Counter(bin_).items(), reverse=True):
            out.append((length, rank[length], rank[length] + n * times, sequence, n, offset))
            rank[length] += n * times
            offset += n * length
        sequence += times
    return out


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a stored table with uid, piece and length; other columns pass) with sequence_id and offset.

    Offsets in a sequence have no gaps. Pieces of one length are ranked in buckets of hashed
    tags, so that a length shared by a third of all rows is spread like any other.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(fill_patterns(counts, capacity))
    spark = pieces.sparkSession
    buckets = max(shuffle_partitions(spark), sum(counts.values()) // BUCKET_ROWS)
    ranked = pieces.withColumn("_bucket", F.pmod(F.xxhash64("uid", "piece"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranked.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("uid", "piece"))
    ranked = ranked.withColumn("_inside", inside).join(sizes, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_inside") - 1).drop("_bucket", "_inside", "_before")
    places = spark.createDataFrame(slots, "_length long, _from long, _to long, _sequence long, _each long, _offset long")
    here = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    nth = F.col("_rank") - F.col("_from")
    return ranked.join(F.broadcast(places), here).select(
        *pieces.columns,
        (F.col("_sequence") + F.expr("(_rank - _from) div _each")).alias("sequence_id"),
        (F.col("_offset") + nth % F.col("_each") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as token pieces, each with its sequence and its offset there.

    Columns: uid (tag of the input row), doc_id, piece, start, length, ids_crc32, sequence_id,
    offset, and ids unless ``keep_ids`` is false. Null texts count as empty; a document without
    tokens is its end id alone. Repeated rows and rows with a null doc_id are documents of
    their own. No rows: no rows. Other columns are not looked at.
    """
    pieces = token_pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids"))
    return pack(staged(pieces if keep_ids else pieces.drop("ids"), "pieces"), capacity=capacity)
