"""Exact top-k inner-product search on a bit-sliced index.

The rows of a segment are columns of bitmaps: slice b of attribute d has a bit for every
row, bit b of that row's component d (less the smallest of the segment, so none is
negative). For a query, each weight is a sum of few signed powers of two; a power shifts the
attribute's slices, a minus sign takes their complement. Whole bitmaps are then added column
by column with full adders, and what is left are the slices of the scores of all rows at
once. From the most significant slice down, rows are told to be among the first k, out of
them, or still equal; rows that stay equal at the last slice are the boundary, and of these
the smallest ids are taken. All numbers are exact; complements and the shift of the
components add a constant per query and segment that doesn't change the order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pairlift.llm.common import staged
from pairlift.llm.vectors import SCALE, meet, tile_counts, usable, whole_numbers

SEGMENT_ROWS = 1 << 16
# Queries and segments that meet in one task.
QUERY_TILE, LEAST_QUERY_TILE, SEGMENT_TILE = 4096, 8, 8
NO_ID = -(1 << 63)

_SEGMENT_DDL = "_dim int, _rt int, n int, ids binary, uids binary, base array<long>, bits array<int>, slices binary"
_SEGMENT = pa.schema(
    [("_dim", pa.int32()), ("_rt", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("uids", pa.binary()),
     ("base", pa.list_(pa.int64())), ("bits", pa.list_(pa.int32())), ("slices", pa.binary())]
)
_FOUND_DDL = "query_uid long, query_id long, uid long, vec_id long, score long"
_FOUND = pa.schema([(c, pa.int64()) for c in ("query_uid", "query_id", "uid", "vec_id", "score")])


def matrix_of(lists: pa.ChunkedArray, dim: int) -> np.ndarray:
    """The rows of a column of equally long lists of whole numbers."""
    flat = pa.concat_arrays([c.flatten() for c in lists.chunks]) if lists.num_chunks else pa.array([], pa.int64())
    return flat.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(lists), dim)


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words; bits after the last are 0."""
    words = -(-bits.shape[1] // 64)
    packed = np.zeros((bits.shape[0], words * 8), np.uint8)
    packed[:, : -(-bits.shape[1] // 8)] = np.packbits(bits, axis=1, bitorder="little")
    return packed.view(np.uint64)


def rows_of(bitmap: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the rows whose bit is set, ascending."""
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little", count=n))


class Segment:
    """Bitmaps of the attributes of at most some 100,000 rows, in the order of their ids."""

    def __init__(self, n: int, base: np.ndarray, bits: np.ndarray, slices: np.ndarray):
        self.n, self.base, self.bits, self.slices = n, base, bits, slices
        self.starts = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)
        self.full = _pack(np.ones((1, n), bool))[0]
        self.top = [(1 << int(b)) - 1 for b in bits]

    @classmethod
    def build(cls, values: np.ndarray) -> Segment:
        """From the rows' whole numbers (n x dim)."""
        n, dim = values.shape
        base = values.min(axis=0) if n else np.zeros(dim, np.int64)
        high = values.max(axis=0) if n else base
        spans = [int(h) - int(b) for h, b in zip(high, base, strict=True)]
        if any(s >= 1 << 62 for s in spans):
            raise ValueError("components are too far apart for 64-bit scores")
        bits = np.array([s.bit_length() for s in spans], np.int32)
        slices = [
            _pack(((values[:, d] - base[d])[None, :] >> np.arange(bits[d])[:, None]) & 1 != 0) for d in range(dim) if bits[d]
        ]
        return cls(n, base, bits, np.concatenate(slices) if slices else np.zeros((0, -(-n // 64)), np.uint64))

    def check(self, weights: np.ndarray) -> None:
        """Stops unless all scores, and sums on the way to them, fit 64 bits."""
        reach = sum(abs(int(w)) * max(abs(int(b)), abs(int(b) + t)) for w, b, t in zip(weights, self.base, self.top, strict=True))
        if reach >= 1 << 61:
            raise ValueError("scores don't fit 64 bits")

    def values(self, rows: np.ndarray) -> np.ndarray:
        """The whole numbers of some rows, put together again from their bits."""
        picked = (self.slices[:, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
        out = np.tile(self.base, (len(rows), 1))
        for d, (start, stop) in enumerate(zip(self.starts[:-1], self.starts[1:], strict=True)):
            if stop > start:
                out[:, d] += (picked[start:stop].T.astype(np.int64) << np.arange(stop - start)).sum(axis=1)
        return out

    def score_slices(self, weights: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the scores of all rows less a constant, least significant first."""
        # |w| in non-adjacent form: few digits, each a power of two to add or to take away.
        size = np.abs(weights)
        plus, minus = (3 * size & ~size) >> 1, (size & ~(3 * size)) >> 1
        columns: dict[int, list[int]] = {}
        for d in np.flatnonzero((size > 0) & (self.bits > 0)):
            for digits, negative in ((int(plus[d]), weights[d] < 0), (int(minus[d]), weights[d] > 0)):
                shift = 0
                while digits:
                    if digits & 1:
                        for b in range(self.bits[d]):
                            columns.setdefault(shift + b, []).append(int(self.starts[d]) + b if not negative else -1 - int(self.starts[d]) - b)
                    digits >>= 1
                    shift += 1
        out: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        column = 0
        while carried or any(c >= column for c in columns):
            sums = [*carried]
            carried = []
            if places := columns.get(column):
                at = np.array(places)
                bitmaps = self.slices[np.where(at < 0, -1 - at, at)]
                bitmaps[at < 0] ^= self.full
                sums.append(bitmaps)
            rows = np.concatenate(sums) if sums else np.zeros((1, len(self.full)), np.uint64)
            while len(rows) > 1:
                third = len(rows) // 3
                if third:
                    a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
                    half = a ^ b
                    carried.append((a & b) | (half & c))
                    rows = np.concatenate([half ^ c, rows[3 * third :]])
                else:
                    carried.append(rows[:1] & rows[1:])
                    rows = rows[:1] ^ rows[1:]
            out.append(rows[0])
            column += 1
        return out

    def top_rows(self, weights: np.ndarray, k: int) -> np.ndarray:
        """The k rows of the highest scores; among equal ones, those that come first in the segment."""
        self.check(weights)
        if k >= self.n:
            return np.arange(self.n)
        inside, equal, n_inside = np.zeros_like(self.full), self.full.copy(), 0
        for bits in reversed(self.score_slices(weights)):
            one = equal & bits
            n = int(np.bitwise_count(one).sum())
            if n_inside + n > k:
                equal = one
            else:
                inside |= one
                n_inside += n
                equal &= ~bits
                if n_inside == k:
                    break
        rows = rows_of(inside, self.n)
        if n_inside < k:
            rows = np.concatenate([rows, rows_of(equal, self.n)[: k - n_inside]])
        return rows


def _build(key: tuple, table: pa.Table) -> pa.Table:
    dim = key[0].as_py()
    table = table.sort_by([("vec_id", "ascending"), ("uid", "ascending")])  # a null id comes last
    segment = Segment.build(matrix_of(table.column("q"), dim))
    ids = table.column("vec_id").fill_null(NO_ID).to_numpy()
    row = [[dim], [key[1].as_py() // SEGMENT_TILE], [segment.n], [ids.tobytes()], [table.column("uid").to_numpy().tobytes()],
           [segment.base.tolist()], [segment.bits.tolist()], [segment.slices.tobytes()]]
    return pa.table([pa.array(v, f.type) for v, f in zip(row, _SEGMENT, strict=True)], schema=_SEGMENT)


def _search(k: int):
    def run(queries: pa.Table, segments: pa.Table) -> pa.Table:
        empty = _FOUND.empty_table()
        if not queries.num_rows or not segments.num_rows:
            return empty
        dim = queries.column("_dim")[0].as_py()
        weights = matrix_of(queries.column("q"), dim)
        uids, names = queries.column("uid").to_numpy(), queries.column("vec_id").to_numpy()
        found: list[np.ndarray] = []
        for part in segments.to_pylist():
            words = -(-part["n"] // 64)
            bits = np.array(part["bits"], np.int32)
            segment = Segment(part["n"], np.array(part["base"], np.int64), bits, np.frombuffer(part["slices"], np.uint64).reshape(-1, words))
            ids, row_uids = np.frombuffer(part["ids"], np.int64), np.frombuffer(part["uids"], np.int64)
            for i in range(len(uids)):
                # One more than asked for: the query itself may be among them.
                rows = segment.top_rows(weights[i], k + 1)
                rows = rows[row_uids[rows] != uids[i]]
                scores = segment.values(rows) @ weights[i]
                found.append(np.stack([np.full(len(rows), uids[i]), np.full(len(rows), names[i]), row_uids[rows], ids[rows], scores]))
        all_found = np.concatenate(found, axis=1)
        columns = [pa.array(c) for c in all_found]
        columns[3] = pa.array(all_found[3], mask=all_found[3] == NO_ID)
        return pa.table(columns, schema=_FOUND)

    return run


def top_k(
    vectors: DataFrame,
    is_query: str = "vec_id % 50 = 0",
    *,
    k: int = 5,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` holds for, the ``k`` other rows of the highest scores.

    Components count as floor(``scale`` * x); the score is the inner product of these whole
    numbers. Equal scores go to the smaller vec_id, a null one last. Rows are told apart as
    rows: one that comes twice is two candidates, and two queries if it is one; a null
    vec_id is never a query. Vectors that are null or hold a null or a component that isn't
    finite take no part, vectors of different lengths never meet, and scores that don't fit
    64 bits stop the job. No rows, or no queries: no rows. Other columns are not looked at.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v")).where(usable(F.col("v")))
    rows = rows.select("vec_id", whole_numbers(F.col("v"), scale).alias("q"), F.coalesce(F.expr(is_query), F.lit(False)).alias("asks"))
    rows = staged(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", F.size("q").alias("_dim"), "q", "asks"), "vectors")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    n_segments = max(1, -(-n // segment_rows))
    # The tag of a row, not its content, says where it goes: equal rows are spread like others.
    by_segment = rows.select("uid", "vec_id", "q", "_dim", F.pmod(F.xxhash64("uid"), F.lit(n_segments)).cast("int").alias("_segment"))
    segments = staged(by_segment.groupBy("_dim", "_segment").applyInArrow(_build, _SEGMENT_DDL), "segments")
    right_tiles = -(-n_segments // SEGMENT_TILE)
    left_tiles = tile_counts(rows, n_queries, QUERY_TILE, LEAST_QUERY_TILE, right_tiles)
    queries = rows.where("asks").select("uid", "vec_id", "q", "_dim", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(left_tiles)).cast("int").alias("_lt"))
    found = meet(queries, segments, ["_dim"], left_tiles, right_tiles, _search(k), _FOUND_DDL)
    best = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
