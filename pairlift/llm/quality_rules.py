"""Quality rules: word and line counts, and zstandard compression bands.

Text that repeats itself compresses far below what prose of its length does, and text
without any pattern hardly compresses. The ratio compressed/raw depends on the length, so
each length band has limits of its own, for whole texts and for the mean over fixed chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pairlift.llm.common import Words, id_and_text, segment_sums, slices, window_hashes

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
LEVEL = 3
CHUNK_BYTES = 4096


@dataclass(frozen=True)
class Band:
    """Limits for texts of at least ``from_bytes``: a ratio outside ``low`` to ``high`` rejects.

    ``low_chunk`` and ``high_chunk`` hold for each chunk; a text is rejected if more than
    ``bad_share`` of its chunks are outside.
    """

    from_bytes: int
    low: float
    high: float
    low_chunk: float = 0.0
    high_chunk: float = 1.0
    bad_share: float = 0.25


# The low limits are about half of what prose of these lengths compresses to. The high ones are 0.01 to 0.05 above the
# highest ratio of clean prose of the length: 0.909, 0.742, 0.696, 0.591, 0.521, 0.478, 0.428, of chunks 0.484, in sf0.1.
# Random letters in one case have 0.59 and more, hex 0.51 to 0.54 from 1,500 bytes on: below 2,048 bytes prose has that too.
BANDS = (
    Band(0, 0.0, 9.0),
    Band(64, 0.45, 0.95),
    Band(256, 0.33, 0.78),
    Band(512, 0.33, 0.74),
    Band(1024, 0.28, 0.605),
    Band(2048, 0.28, 0.535),
    Band(4096, 0.25, 0.51, 0.25, 0.51),
    Band(16384, 0.22, 0.47, 0.25, 0.51),
    Band(262144, 0.15, 0.47, 0.25, 0.51),
)

_DDL = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_bytes long, ratio double, bad_chunks double"
)


def repeated_words(words: Words) -> np.ndarray:
    """For each text, the words that lie in a window of WINDOW words found twice or more in it."""
    hashes, text = window_hashes(words.hashes()[words.ids] if len(words.ids) else np.zeros(0, np.uint64), words.starts, WINDOW)
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    same = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    runs = np.maximum(np.diff(words.starts) - WINDOW + 1, 0)
    first = np.concatenate([[0], np.cumsum(runs)[:-1]]) if len(runs) else runs
    at = order[twice] + (words.starts[:-1] - first)[t[twice]]
    cover = np.zeros(len(words.ids) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return segment_sums((np.cumsum(cover)[:-1] > 0).astype(np.int64), words.starts)


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def band_of(n_bytes: int, bands: tuple[Band, ...]) -> Band:
    return next(b for b in reversed(bands) if n_bytes >= b.from_bytes)


def _compression(texts: list[bytes], bands: tuple[Band, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ratio of each text, share of its chunks outside their limits, and whether both are as they should."""
    import zstandard

    compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
    ratio, bad, good = np.ones(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
    for i, text in enumerate(texts):
        if not text:
            continue
        band = band_of(len(text), bands)
        ratio[i] = len(compressor.compress(text)) / len(text)
        # A shorter chunk would need limits of its own: the last one reaches back to be a full one.
        starts = [*range(0, len(text) - CHUNK_BYTES + 1, CHUNK_BYTES)]
        if starts and len(text) % CHUNK_BYTES:
            starts.append(len(text) - CHUNK_BYTES)
        chunks = [len(compressor.compress(text[at : at + CHUNK_BYTES])) / CHUNK_BYTES for at in starts]
        if chunks:
            bad[i] = sum(not band.low_chunk <= r <= band.high_chunk for r in chunks) / len(chunks)
        good[i] = band.low <= ratio[i] <= band.high and bad[i] <= band.bad_share
    return ratio, bad, good


def measures(texts: pa.Array, bands: tuple[Band, ...] = BANDS) -> dict[str, np.ndarray]:
    """All counts and the verdict of each text, by column name."""
    words = Words(texts, lower=False)
    raw = texts.cast(pa.binary()).to_pylist()
    chars = pc.utf8_length(words.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    repeats = repeated_words(words)
    failed = (words.counts < 20) | (100 * repeats > 30 * words.counts)
    ratio, bad, good = _compression(raw, bands)
    return {
        "n_words": words.counts,
        "word_chars": words.sums(chars[words.ids]),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in raw], np.int64),
        "n_dup_lines": np.array([duplicate_lines(t) for t in raw], np.int64),
        "n_repeat_words": repeats,
        "base_failed": failed,
        "kept": ~failed & good,
        "n_bytes": np.array([len(t) for t in raw], np.int64),
        "ratio": ratio,
        "bad_chunks": bad,
    }


def _measure(bands: tuple[Band, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = measures(part.column("text"), bands)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, found.values())], names=["doc_id", *found])

    return run


def quality_rules(docs: DataFrame, bands: tuple[Band, ...] = BANDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict for each row, all made in one pass without a shuffle.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
    (fewer than 20 words, or over 30 % of them repeated), kept (not base_failed, and compression
    within its band), n_bytes, ratio, bad_chunks. A null or empty text has ratio 1, no words,
    and fails. Equal rows get equal rows. No rows: no rows. Other columns are not looked at.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(_measure(bands), _DDL)


def keep_by_rules(docs: DataFrame, bands: tuple[Band, ...] = BANDS, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is kept, all columns as they were.

    Null and empty texts have no words and go. Texts are measured whole. Equal texts stay or go
    together, so repeated rows stay repeated. Ids are not looked at and may be null. No rows: no
    rows. Columns of any name pass through.
    """

    @F.pandas_udf("boolean")
    def kept(text: pd.Series) -> pd.Series:
        whole = pa.RecordBatch.from_arrays([pa.array(text, pa.string(), from_pandas=True)], names=["text"])
        parts = [measures(part.column("text"), bands)["kept"] for part in slices([whole])]
        return pd.Series(np.concatenate([np.zeros(0, bool), *parts]))

    return docs.filter(kept(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
