"""Token sequences in training order, as shards of fixed-stride records.

Each task joins its documents' ids, every document closed by an end id, and cuts them into
sequences of ``length`` ids; a task's last sequence is padded. Sequences are numbered by task
and place, and a keyed Feistel permutation gives each number its global slot: a network over
the next even power of two, applied again while the result is no slot (cycle-walking). Slots
are a bijection known from the key alone, so no shuffle buffer and no sort key is stored.

Sequences are then range-partitioned by slot into shards of ``shard_records`` records. A
record is its slot (8 bytes), its number of ids (4 bytes), ``length`` ids of 2 or 4 bytes,
all little-endian, and a line feed. So slot s is in shard s div shard_records at byte
(s mod shard_records) * stride, and a reader can go on from any slot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairlift.llm.common import id_and_text, mix64, slices, staged
from pairlift.llm.packing import TOKEN_SLICE_BYTES, worker_tokenizer

LENGTH = 2048
SHARD_RECORDS = 16_384
ROUNDS = 6
PAD_ID = 0

_SEQUENCES = pa.schema([("block", pa.int32()), ("place", pa.int64()), ("n_ids", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("ids", pa.binary())])
_SEQUENCES_DDL = "block int, place long, n_ids int, doc_ids array<long>, ids binary"
_RECORDS_DDL = "slot long, n_ids int, ids binary"


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of ``index`` (0 to n - 1): a permutation of 0 to n - 1 that depends on ``key`` only."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) ^ mix64(np.array([key % (1 << 64)], np.uint64)))
    out = index.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> np.uint64(half), out[walking] & mask
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & mask)
        out[walking] = (left << np.uint64(half)) | right
        walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


def _sequences(path: str, length: int, end_id: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(path)
        block = TaskContext.get().partitionId()
        held: list[tuple[int | None, np.ndarray]] = []
        size = place = 0

        def cut(whole: bool) -> Iterator[tuple]:
            """Sequences of the held ids; what is left over stays held, or is padded if this is the end."""
            nonlocal held, size, place
            ids = np.concatenate([np.zeros(0, dtype), *(x for _, x in held)])
            ends = np.cumsum([len(x) for _, x in held])
            stop = len(ids) if whole else len(ids) // length * length
            for at in range(0, stop, length):
                part = ids[at : at + length]
                first, last = np.searchsorted(ends, [at, at + len(part) - 1], side="right")
                padded = np.concatenate([part, np.full(length - len(part), PAD_ID, dtype)])
                yield block, place, len(part), [d for d, _ in held[first : last + 1]], padded.tobytes()
                place += 1
            first = int(np.searchsorted(ends, stop, side="right"))
            held = [(held[k][0], held[k][1][max(0, stop - (ends[k] - len(held[k][1]))) :]) for k in range(first, len(held))]
            size = len(ids) - stop

        def table(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            rows = list(rows)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SEQUENCES, strict=True)], schema=_SEQUENCES)

        for part in slices(batches, size=TOKEN_SLICE_BYTES):
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), tokenizer.encode(part.column("text")), strict=True):
                held.append((doc_id, np.append(ids, np.uint32(end_id)).astype(dtype)))
                size += len(held[-1][1])
            if size >= length:
                yield from table(cut(False))
        yield from table(cut(True))

    return run


def _records(n: int, key: int):
    """Sequences by number to records by slot; the line feed is the text writer's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = feistel(batch.column("slot").to_numpy(), n, key)
            rows = zip(slots.tolist(), batch.column("n_ids").to_pylist(), batch.column("ids").to_pylist(), strict=True)
            records = [slot.to_bytes(8, "little") + size.to_bytes(4, "little") + ids for slot, size, ids in rows]
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(records, pa.binary())], names=["slot", "record"])

    return run


def _slots(n: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("slot")
            yield batch.set_column(at, "slot", pa.array(feistel(batch.column(at).to_numpy(), n, key)))

    return run


@dataclass(frozen=True)
class Shards:
    """Written shards and all that a reader needs to know of them."""

    path: str
    n_sequences: int
    length: int
    id_bytes: int
    shard_records: int

    @property
    def stride(self) -> int:
        return 12 + self.length * self.id_bytes + 1

    def place(self, slot: int) -> tuple[str, int]:
        """Folder of the shard that has a slot, and the byte there at which its record begins."""
        return f"{self.path}/shard={slot // self.shard_records}", slot % self.shard_records * self.stride

    def read(self, spark: SparkSession, from_slot: int = 0) -> DataFrame:
        """(slot, n_ids, ids without padding) of the slots from ``from_slot`` on; earlier shards aren't opened."""
        if from_slot >= self.n_sequences:
            return spark.createDataFrame([], _RECORDS_DDL)
        last = (self.n_sequences - 1) // self.shard_records
        paths = f"{self.path}/shard=*"
        if first := from_slot // self.shard_records:
            paths = ",".join(f"{self.path}/shard={s}" for s in range(first, last + 1))
        id_bytes = self.id_bytes

        def fields(records):
            for r in records:
                slot, n = int.from_bytes(r[:8], "little"), int.from_bytes(r[8:12], "little")
                if slot >= from_slot:
                    yield slot, n, r[12 : 12 + n * id_bytes]

        return spark.createDataFrame(spark.sparkContext.binaryRecords(paths, self.stride).mapPartitions(fields), _RECORDS_DDL)


def materialise(
    docs: DataFrame,
    tokenizer_path: str,
    path: str,
    *,
    key: int,
    length: int = LENGTH,
    end_id: int = 1,
    shard_records: int = SHARD_RECORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[Shards, DataFrame]:
    """Write ``docs`` as shards under ``path`` and return them with their index (slot, n_ids, doc_ids, ids_crc32).

    ``tokenizer_path``: a tokenizer that never joins what a space or line feed parts. A null or
    empty text is its end id alone; repeated rows and null ids are documents like any other.
    No rows: no shards. Other columns are not looked at.
    """
    if length < 1 or shard_records < 1:
        raise ValueError("length and shard_records must be at least 1")
    from tokenizers import Tokenizer

    dtype = "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"
    id_bytes = int(dtype[-1])
    spark = docs.sparkSession
    run = _sequences(tokenizer_path, length, end_id, dtype)
    cut = staged(id_and_text(docs, id_col, text_col).mapInArrow(run, _SEQUENCES_DDL), "sequences")
    sizes = sorted((r["block"], r["n"]) for r in cut.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each task
    n = sum(size for _, size in sizes)
    shards = Shards(path, n, length, id_bytes, shard_records)
    starts = np.cumsum([0, *(size for _, size in sizes)])
    before = spark.createDataFrame([(b, int(s)) for (b, _), s in zip(sizes, starts, strict=False)], "block int, before long")
    placed = cut.join(F.broadcast(before), "block").select((F.col("before") + F.col("place")).alias("slot"), "n_ids", "doc_ids", "ids")
    used = F.expr(f"substring(ids, 1, n_ids * {id_bytes})")
    index = placed.select("slot", "n_ids", "doc_ids", F.crc32(used).alias("ids_crc32"))
    index = index.mapInArrow(_slots(n, key), "slot long, n_ids int, doc_ids array<long>, ids_crc32 long")
    records = placed.select("slot", "n_ids", "ids").mapInArrow(_records(n, key), "slot long, record binary")
    shard = F.expr(f"slot div {shard_records}").alias("shard")
    # A text column may hold any bytes; the text writer puts them down as they are.
    lines = records.select(shard, "slot", F.col("record").cast("string").alias("value"))
    n_shards = max(1, -(-n // shard_records))
    lines = lines.repartitionByRange(n_shards, "shard").sortWithinPartitions("shard", "slot").select("shard", "value")
    lines.write.partitionBy("shard").option("compression", "none").option("maxRecordsPerFile", 0).text(path)
    return shards, index
