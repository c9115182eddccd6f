"""What the text operators share: row tags, written tables, and words of an Arrow batch as numbers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pairlift.workspace import scratch_path

# Text handled at a time inside a task; a batch that Spark hands over is cut into slices of about this size.
SLICE_BYTES = 8 << 20
SLICE_ROWS = 4096


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once in the shared folder, zstd-compressed, and read it back.

    What follows reads a finished table: a lost executor repeats a read, and numbers given
    out in the written job (names, row tags) can't change any more.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_name(taken: Sequence[str], name: str) -> str:
    """``name``, with underscores before it until no column has it (letters' case aside)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", uid_col: str | None = None) -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (null: empty), with ``uid`` if asked for; other columns, whatever their names, stay behind."""
    cols = [
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    ]
    return docs.select(*([F.col(f"`{uid_col}`").alias("uid")] if uid_col else []), *cols)


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``size`` bytes of ``column`` and at most SLICE_ROWS rows; a longer row is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, done + size, side="right"))
            stop = min(max(stop, start + 1), start + SLICE_ROWS)
            yield batch.slice(start, stop - start)
            start = stop


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of many texts: ``ids`` index ``vocabulary``, text i has ids[starts[i]:starts[i + 1]]."""

    def __init__(self, texts: pa.Array, lower: bool):
        texts = pc.fill_null(texts, "")
        if lower:
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values = lists.flatten()
        # A text that begins or ends with white space gives an empty string there.
        filled = pc.greater(pc.binary_length(values), 0)
        if not pc.all(filled).as_py() and len(values):
            kept = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
            bounds = np.concatenate([[0], np.cumsum(counts)])
            counts = np.diff(kept[bounds])
            values = values.filter(filled)
        coded = values.dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocabulary = coded.dictionary
        self._hashes = None
        self.counts = counts
        self.starts = np.concatenate([[0], np.cumsum(counts)])

    def texts_of_ids(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each vocabulary word."""
        if self._hashes is None:
            from xxhash import xxh3_64_intdigest

            words = self.vocabulary.cast(pa.binary()).to_pylist()
            self._hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
        return self._hashes

    def sums(self, of_ids: np.ndarray) -> np.ndarray:
        """Sum of a number per word over each text."""
        return segment_sums(of_ids, self.starts)


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i + 1]]; integers exactly, doubles segment by segment."""
    out = np.zeros(len(starts) - 1, dtype=values.dtype if values.dtype.kind == "f" else np.int64)
    full = starts[1:] > starts[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, starts[:-1][full], dtype=out.dtype)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves about half of the output bits."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def window_hashes(word_hashes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words inside a text, and the number of the text.

    Texts with fewer words have no run.
    """
    n = np.diff(starts)
    runs = np.maximum(n - width + 1, 0)
    text = np.repeat(np.arange(len(n)), runs)
    first = np.concatenate([[0], np.cumsum(runs)])[:-1]
    at = np.arange(runs.sum()) + np.repeat(starts[:-1] - first, runs)
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for k in range(width):
            h = mix64(h + word_hashes[at + k] + np.uint64(k + 1))
    return h, text
