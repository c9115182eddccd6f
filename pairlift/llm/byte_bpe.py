"""Byte-level BPE encoding and decoding in overlapping chunks.

A text longer than a chunk is cut into chunks that overlap, and those are pre-tokenised in
parallel, each from its own start. A pre-token depends only on what follows its start, so
once two chunks both start a pre-token at the same place of their overlap, they agree from
there on: that is where they are stitched. Where they don't meet in the overlap (a run of
letters longer than that), the earlier chunk goes on into the later one, until it meets the
one after. The pieces between the stitches are then encoded in parallel, and a document's
ids are its pieces' in order. Decoding joins the raw bytes of the ids.

A stitch is only made after a character that is not white space: the pattern looks ahead
there for nothing, so the piece before it ends in the same pre-token by itself.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairlift.llm.common import id_and_text, slices

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1024

_CHUNKS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int64()), ("start", pa.int64()), ("text", pa.string())])
_CHUNKS_DDL = "uid long, doc_id long, k long, start long, text string"
_CUT = pa.schema([*_CHUNKS, ("starts", pa.list_(pa.int64()))])
_IDS_DDL = "uid long, doc_id long, k long, ids binary"


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _table(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pre_token_starts(text: str, pattern: str) -> list[int]:
    """Where pre-tokens start that follow a character other than white space; the text's start is not among them.

    U+001C to U+001F are left out: pattern libraries differ on whether they are white space.
    """
    import regex

    starts = (m.start() for m in regex.compile(pattern).finditer(text))
    return [s for s in starts if s and not text[s - 1].isspace() and text[s] not in "\x1c\x1d\x1e\x1f"]


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for uid, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("uid", "doc_id", "text")), strict=True):
                starts = range(0, max(1, len(text) - overlap), chunk)
                yield _table([(uid, doc_id, k, s, text[s : s + chunk + overlap]) for k, s in enumerate(starts)], _CHUNKS)

    return run


def _pre_tokenise(pattern: str, chunk: int, overlap: int):
    """Adds, as places in the document, the pre-token starts in the overlaps with the chunk before and the one after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = list(zip(*(part.column(f.name).to_pylist() for f in _CHUNKS), strict=True))
            starts = [[row[3] + s for s in pre_token_starts(row[4], pattern) if s < overlap or s >= chunk] for row in rows]
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in _CHUNKS), pa.array(starts, pa.list_(pa.int64()))], schema=_CUT)

    return run


def stitched(chunks: Iterable[tuple[int, str, list[int]]], pattern: str) -> Iterator[str]:
    """Pieces of one document from its chunks (start, text, pre-token starts in the overlaps), in order."""
    held_at, held, held_starts = 0, "", []
    for at, text, starts in chunks:
        if not held:
            held_at, held, held_starts = at, text, starts
            continue
        end = held_at + len(held)
        common = sorted({s for s in starts if at < s < end} & set(held_starts))
        if common:
            yield held[: common[0] - held_at]
            held_at, held, held_starts = common[0], text[common[0] - at :], starts
        else:
            # The held text's starts are right; from the last of them on, the longer text is looked at again.
            held += text[end - at :]
            tail = [s for s in held_starts if s < end]
            known = max(tail, default=held_at)
            if known > held_at:
                yield held[: known - held_at]
                held_at, held = known, held[known - held_at :]
            held_starts = [held_at + s for s in pre_token_starts(held, pattern)]
    if held:
        yield held


def _stitch(pattern: str):
    """Rows come sorted by document and chunk."""

    def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in slices(batches):
            yield from zip(*(part.column(f.name).to_pylist() for f in _CUT), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chunk_rows(batches)
        row = next(rows, None)
        while row is not None:
            uid, doc_id = row[0], row[1]

            def own() -> Iterator[tuple[int, str, list[int]]]:
                nonlocal row
                while row is not None and row[0] == uid:
                    yield row[3], row[4], row[5]
                    row = next(rows, None)

            for k, piece in enumerate(stitched(own(), pattern)):
                yield _table([(uid, doc_id, k, 0, piece)], _CHUNKS)

    return run


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path, pattern)
        for part in slices(batches):
            ids = [np.array(encoding.encode_ordinary(t), "<u4").tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("uid", "doc_id", "k")), pa.array(ids, pa.binary())], names=["uid", "doc_id", "k", "ids"])

    return run


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, held = None, []

    def whole() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([0], pa.int64()), pa.array([b"".join(held)], pa.binary())],
            names=["uid", "doc_id", "k", "ids"],
        )

    for part in slices(batches, "ids"):
        for uid, doc_id, ids in zip(*(part.column(c).to_pylist() for c in ("uid", "doc_id", "ids")), strict=True):
            if now is not None and now[0] != uid:
                yield whole()
                held = []
            now = (uid, doc_id)
            held.append(ids)
    if now is not None:
        yield whole()


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    *,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row's whole text; ids as little-endian unsigned 32-bit binary.

    ``ranks_path``: a rank file that every executor can open; ``pattern``: the pre-token
    pattern, each match of which is encoded by itself, without special tokens. Null and empty
    texts have no ids. Repeated rows and null ids are rows like any other. No rows: no rows.
    Other columns are not looked at.
    """
    if not 0 < overlap_chars <= chunk_chars:
        raise ValueError("the overlap must be at least 1 character and at most a chunk")
    tagged = id_and_text(docs, id_col, text_col).withColumn("uid", F.monotonically_increasing_id())
    is_long = F.char_length("text") > chunk_chars + overlap_chars
    encoder = _encode(ranks_path, pattern)
    short = tagged.filter(~is_long).select("uid", "doc_id", F.lit(0).cast("long").alias("k"), "text").mapInArrow(encoder, _IDS_DDL)
    chunks = tagged.filter(is_long).mapInArrow(_cut(chunk_chars, overlap_chars), _CHUNKS_DDL).repartition("uid", "k")
    cut = chunks.mapInArrow(_pre_tokenise(pattern, chunk_chars, overlap_chars), f"{_CHUNKS_DDL}, starts array<long>")
    pieces = cut.repartition("uid").sortWithinPartitions("uid", "k").mapInArrow(_stitch(pattern), _CHUNKS_DDL)
    coded = pieces.select("uid", "doc_id", "k", "text").repartition("uid", "k").mapInArrow(encoder, _IDS_DDL)
    joined = coded.repartition("uid").sortWithinPartitions("uid", "k").mapInArrow(_join_pieces, _IDS_DDL)
    return short.unionByName(joined).select("doc_id", F.expr("length(ids) div 4").cast("long").alias("n_tokens"), "ids")


def _decode(ranks_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks_path, pattern)
        for part in slices(batches, "ids"):
            decoded = [encoding.decode_bytes(np.frombuffer(ids or b"", "<u4").tolist()) for ids in part.column("ids").to_pylist()]
            others = [c for c in part.schema.names if c != "decoded"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(decoded, pa.binary())], names=[*others, "decoded"])

    return run


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with ``decoded``: the raw bytes of its ids, joined."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decode(ranks_path, pattern), "doc_id long, n_tokens long, ids binary, decoded binary")
