"""Hard-negative mining with coordinate pruning in length buckets.

Rows are dealt into buckets of similar length. A bucket holds its rows' coordinates, each
coordinate with a list of the rows sorted by their value there (of the vector at unit
length). A search for scores of at least t in a bucket asks for a cosine of at least
t / (length of the anchor * greatest length of the bucket). No row can have it if that is
over one; else it bounds each coordinate to a range around the anchor's own value, which is
a run of the sorted list. The runs of the anchor's largest coordinates, its focus, are
intersected, and the rows in all of them are scored exactly. t starts at the least score
that can count and rises with what has been found, long buckets first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.taskcontext import TaskContext

from pairlift.llm.bit_sliced import NO_ID, matrix_of
from pairlift.llm.common import staged
from pairlift.llm.vectors import SCALE, meet, tile_counts, usable, whole_numbers

BUCKET_ROWS = 4096
# Anchors and bucket rows that meet in one task.
ANCHOR_TILE, LEAST_ANCHOR_TILE, ROWS_TILE = 2048, 8, 8192
FOCUS = 4
# Room for rounding in cosines; a wider range only lets more rows be scored.
SLACK = 1e-9

_BUCKET_DDL = "_dim int, part int, longest double, ids binary, uids binary, labels binary, width int, cells binary, lists binary"
_BUCKET = pa.schema(
    [("_dim", pa.int32()), ("part", pa.int32()), ("longest", pa.float64()), ("ids", pa.binary()), ("uids", pa.binary()),
     ("labels", pa.binary()), ("width", pa.int32()), ("cells", pa.binary()), ("lists", pa.binary())]
)
_POSITIVES = [("anchor_uid", "long"), ("uid", "long"), ("vec_id", "long"), ("score", "long")]
_NEGATIVES = [("anchor_uid", "long"), ("anchor_id", "long"), ("positive_uid", "long"), ("positive_id", "long"), ("positive_score", "long"),
              ("uid", "long"), ("negative_id", "long"), ("negative_score", "long")]


class Bucket:
    """Rows of similar length with a sorted list per coordinate."""

    def __init__(self, ids: np.ndarray, uids: np.ndarray, labels: np.ndarray, cells: np.ndarray, lists: np.ndarray | None = None):
        self.ids, self.uids, self.labels = ids, uids, labels
        self.cells = cells.astype(np.float64)
        self.whole = cells
        lengths = np.sqrt((self.cells * self.cells).sum(axis=1))
        self.shortest, self.longest = (lengths.min(), lengths.max()) if len(ids) else (0.0, 0.0)
        self.lengths = np.where(lengths > 0, lengths, 1.0)
        if lists is None:
            lists = np.argsort(self.cells / self.lengths[:, None], axis=0, kind="stable").T
        self.lists, self.sorted = lists, {}
        self.largest = np.abs(self.cells).max(axis=0, initial=0.0)

    def values(self, f: int) -> np.ndarray:
        """Coordinate ``f`` of the rows at unit length, ascending: the values of its list."""
        if f not in self.sorted:
            rows = self.lists[f]
            self.sorted[f] = self.cells[rows, f] / self.lengths[rows]
        return self.sorted[f]

    def candidates(self, unit: np.ndarray, length: float, focus: np.ndarray, least: float) -> np.ndarray | None:
        """Rows that may score ``least`` or more with an anchor of this direction and length; None: any row may."""
        reach = length * (self.longest if least > 0 else self.shortest)
        if reach == 0.0:
            return np.zeros(0, np.int64) if least > 0 else None
        cosine = least / reach - SLACK
        if cosine > 1.0:
            return np.zeros(0, np.int64)
        if cosine <= -1.0:
            return None
        angle = np.arccos(cosine)
        own = np.arccos(np.clip(unit[focus], -1.0, 1.0))
        low = np.cos(np.minimum(np.pi, own + angle)) - SLACK
        high = np.cos(np.maximum(0.0, own - angle)) + SLACK
        runs = []
        for f, lo, hi in zip(focus, low, high, strict=True):
            values = self.values(int(f))
            start, stop = np.searchsorted(values, lo, "left"), np.searchsorted(values, hi, "right")
            if stop - start < len(self.ids):
                runs.append(self.lists[f, start:stop])
        if not runs:
            return None
        runs.sort(key=len)
        rows = runs[0]
        for other in runs[1:]:
            inside = np.zeros(len(self.ids), bool)
            inside[other] = True
            rows = rows[inside[rows]]
        return rows

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact whole-number scores of some rows: in doubles where these hold every sum exactly."""
        reach = float((self.largest * np.abs(anchor.astype(np.float64))).sum())
        if reach < 2.0**53:
            # All rows together are one product; picking rows first costs more than it saves unless they are few.
            if 4 * len(rows) > len(self.ids):
                return (self.cells @ anchor.astype(np.float64))[rows].astype(np.int64)
            return (self.cells[rows] @ anchor.astype(np.float64)).astype(np.int64)
        if reach >= 2.0**62:
            raise ValueError("scores don't fit 64 bits")
        return self.whole[rows].astype(np.int64) @ anchor


class Best:
    """The first ``k`` of the rows seen so far, by score, then id (a null one last), then tag."""

    def __init__(self, k: int, least: float):
        self.k, self.least = k, least
        self.scores, self.ids, self.uids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        keep = scores >= self.least
        if not keep.any():
            return
        scores, ids, uids = (np.concatenate([a, b[keep]]) for a, b in ((self.scores, scores), (self.ids, ids), (self.uids, uids)))
        if len(scores) > 4 * self.k:
            keep = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids, uids = scores[keep], ids[keep], uids[keep]
        first = np.lexsort((uids, ids, ids == NO_ID, -scores))[: self.k]
        self.scores, self.ids, self.uids = scores[first], ids[first], uids[first]
        if len(first) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


def _place(n: int) -> np.dtype:
    """The number type of places in a list of ``n``."""
    return np.dtype(np.uint16 if n <= 1 << 16 else np.int32)


def _emit(dim: int, rows: list[tuple]) -> pa.RecordBatch:
    ids, uids, labels, cells = (np.concatenate([r[i] for r in rows]) for i in range(4))
    bucket = Bucket(ids, uids, labels, cells)
    narrow = next(t for t in (np.int16, np.int32, np.int64) if bucket.largest.max(initial=0.0) <= np.iinfo(t).max)
    values = [dim, TaskContext.get().partitionId(), float(bucket.longest), ids.tobytes(), uids.tobytes(), labels.tobytes(),
              np.dtype(narrow).itemsize, cells.astype(narrow).tobytes(), bucket.lists.astype(_place(len(ids))).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BUCKET, strict=True)], schema=_BUCKET)


def _fill(bucket_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n, dim = 0, None
        for batch in batches:
            dims = batch.column("_dim").to_numpy()
            start = 0
            while start < len(dims):
                if held and dims[start] != dim:
                    yield _emit(dim, held)
                    held, n = [], 0
                dim = int(dims[start])
                same = np.flatnonzero(dims[start:] != dim)
                stop = min(start + int(same[0]) if len(same) else len(dims), start + bucket_rows - n)
                part = pa.Table.from_batches([batch.slice(start, stop - start)])
                held.append((part.column("vec_id").fill_null(NO_ID).to_numpy(), part.column("uid").to_numpy(), part.column("label").to_numpy(), matrix_of(part.column("q"), dim)))
                n += stop - start
                start = stop
                if n >= bucket_rows:
                    yield _emit(dim, held)
                    held, n = [], 0
        if held:
            yield _emit(dim, held)

    return run


def _open(table: pa.Table) -> Iterator[Bucket]:
    """The buckets of a cell, longest first, one at a time."""
    for at in np.argsort(-table.column("longest").to_numpy(), kind="stable"):
        part = {c: table.column(c)[int(at)] for c in table.column_names}
        ids, uids, labels = (np.frombuffer(part[c].as_buffer(), np.int64) for c in ("ids", "uids", "labels"))
        dim, width = part["_dim"].as_py(), part["width"].as_py()
        cells = np.frombuffer(part["cells"].as_buffer(), np.dtype(f"i{width}")).reshape(len(ids), dim)
        yield Bucket(ids, uids, labels, cells, np.frombuffer(part["lists"].as_buffer(), _place(len(ids))).reshape(dim, len(ids)))


def _focused(anchors: pa.Table, focus: int) -> list[tuple]:
    """(vector, direction, length, focus coordinates) of each anchor."""
    out = []
    for vector in matrix_of(anchors.column("q"), anchors.column("_dim")[0].as_py()):
        length = float(np.sqrt((vector.astype(np.float64) ** 2).sum()))
        unit = vector / length if length else vector.astype(np.float64)
        out.append((vector, unit, length, np.argsort(-np.abs(unit), kind="stable")[:focus]))
    return out


def _columns(fields: list[tuple[str, str]], rows: list[np.ndarray]) -> pa.Table:
    """A table of whole numbers; NO_ID is null in the columns of ids."""
    schema = pa.schema([(c, pa.int64()) for c, _ in fields])
    if not rows:
        return schema.empty_table()
    cells = np.concatenate(rows, axis=1)
    return pa.table([pa.array(v, mask=v == NO_ID) if c.endswith("_id") else pa.array(v) for (c, _), v in zip(fields, cells, strict=True)], schema=schema)


def _positives(k: int, focus: int):
    def run(anchors: pa.Table, table: pa.Table) -> pa.Table:
        if not anchors.num_rows or not table.num_rows:
            return _columns(_POSITIVES, [])
        uids, labels = anchors.column("uid").to_numpy(), anchors.column("label").to_numpy()
        best = [Best(k, -np.inf) for _ in uids]
        seen = _focused(anchors, focus)
        for bucket in _open(table):
            for uid, label, (vector, unit, length, at), found in zip(uids, labels, seen, best, strict=True):
                rows = bucket.candidates(unit, length, at, found.least)
                fits = (bucket.labels == label) & (bucket.uids != uid)
                rows = np.flatnonzero(fits) if rows is None else rows[fits[rows]]
                if len(rows):
                    found.add(bucket.scores(rows, vector), bucket.ids[rows], bucket.uids[rows])
        return _columns(_POSITIVES, [np.stack([np.full(len(b.ids), uid), b.uids, b.ids, b.scores]) for uid, b in zip(uids, best, strict=True)])

    return run


def _negatives(k: int, focus: int, low: int, high: int):
    def run(anchors: pa.Table, table: pa.Table) -> pa.Table:
        if not anchors.num_rows or not table.num_rows:
            return _columns(_NEGATIVES, [])
        facts = anchors.select(["uid", "vec_id", "label", "positives"]).to_pylist()
        # Positives of the same score have the same negatives.
        wanted = [{p["score"]: Best(k, -(-low * p["score"] // 100)) for p in a["positives"] if low * p["score"] <= high * p["score"]} for a in facts]
        seen = _focused(anchors, focus)
        for bucket in _open(table):
            for anchor, (vector, unit, length, at), lists in zip(facts, seen, wanted, strict=True):
                if not lists:
                    continue
                least = min(b.least for b in lists.values())
                rows = bucket.candidates(unit, length, at, least)
                other = bucket.labels != anchor["label"]
                rows = np.flatnonzero(other) if rows is None else rows[other[rows]]
                if not len(rows):
                    continue
                scores = bucket.scores(rows, vector)
                near = scores >= least
                rows, scores = rows[near], scores[near]
                for positive, found in lists.items():
                    fits = scores <= high * positive // 100
                    found.add(scores[fits], bucket.ids[rows[fits]], bucket.uids[rows[fits]])
        out = []
        for anchor, lists in zip(facts, wanted, strict=True):
            own = NO_ID if anchor["vec_id"] is None else anchor["vec_id"]
            for p in anchor["positives"]:
                if (b := lists.get(p["score"])) is not None and len(b.ids):
                    head = [anchor["uid"], own, p["uid"], NO_ID if p["vec_id"] is None else p["vec_id"], p["score"]]
                    out.append(np.stack([*(np.full(len(b.ids), v) for v in head), b.uids, b.ids, b.scores]))
        return _columns(_NEGATIVES, out)

    return run


def _ddl(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"{c} {t}" for c, t in fields)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: str = "vec_id % 100 = 0",
    *,
    n_positives: int = 5,
    n_negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: str | Column = "label",
    bucket_rows: int = BUCKET_ROWS,
    focus: int = FOCUS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each row that ``is_anchor`` holds for and each of its ``n_positives`` best-scored
    other rows of the same label, the first ``n_negatives`` rows of another label whose score
    is ``low`` to ``high`` percent of the positive's; all there are, if fewer. A score is the
    inner product of the whole numbers floor(``scale`` * x) and higher ones come first; equal
    ones go to the smaller vec_id, a null one last.

    Rows with a null label, a null vector, or a null or not finite component take no part;
    vectors of different lengths never meet. Rows are told apart as rows: a copy of an anchor
    can be its positive, and a row that comes twice is two candidates. An anchor without
    positives, or a positive whose range holds no row, gives no rows. Scores that don't fit
    64 bits stop the job. No rows: no rows. Other columns are not looked at.
    """
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"), label.cast("long").alias("label"))
    rows = rows.where(F.col("label").isNotNull() & usable(F.col("v")))
    rows = rows.select("vec_id", "label", whole_numbers(F.col("v"), scale).alias("q"), F.coalesce(F.expr(is_anchor), F.lit(False)).alias("asks"))
    square = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = staged(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", F.size("q").alias("_dim"), square.alias("square"), "q", "asks"), "labelled-vectors")
    n, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()

    # The tag breaks ties of length, so that equal rows can be dealt into several buckets.
    dealt = rows.repartitionByRange(max(1, -(-n // bucket_rows)), "_dim", F.desc("square"), "uid").sortWithinPartitions("_dim")
    buckets = staged(dealt.select("uid", "vec_id", "label", "_dim", "q").mapInArrow(_fill(bucket_rows), _BUCKET_DDL), "length-buckets")
    right_tiles = max(1, -(-n // ROWS_TILE))
    left_tiles = tile_counts(rows, n_anchors, ANCHOR_TILE, LEAST_ANCHOR_TILE, right_tiles)
    buckets = buckets.withColumn("_rt", F.pmod("part", F.lit(right_tiles)).cast("int"))
    tile = F.pmod(F.xxhash64("uid"), F.lit(left_tiles)).cast("int").alias("_lt")
    anchors = rows.where("asks").select("uid", "vec_id", "label", "_dim", "q", tile)

    found = meet(anchors, buckets, ["_dim"], left_tiles, right_tiles, _positives(n_positives, focus), _ddl(_POSITIVES))
    best = Window.partitionBy("anchor_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    positives = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= n_positives)
    lists = positives.groupBy(F.col("anchor_uid").alias("uid")).agg(F.collect_list(F.struct("uid", "vec_id", "score")).alias("positives"))
    asking = anchors.join(staged(lists, "positives"), "uid")
    mined = meet(asking, buckets, ["_dim"], left_tiles, right_tiles, _negatives(n_negatives, focus, low, high), _ddl(_NEGATIVES))
    order = Window.partitionBy("anchor_uid", "positive_uid").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "uid")
    ranked = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
