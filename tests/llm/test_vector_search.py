"""Bit-sliced top-k and hard negatives against comparing every pair."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from pairlift.llm import bit_sliced, hard_negatives

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("uid", T.StringType()),
        T.StructField("_DIM", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("_lt", T.StringType()),
    ]
)


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, None, "x", None, "t") for r in rows], SCHEMA).repartition(parts)


def whole(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(256 * x) for x in v]


def order(r):
    return (-r[0], r[1] is None, r[1] or 0)


def brute_top(rows, k, every):
    rows = [(i, whole(v)) for i, v, _ in rows]
    rows = [r for r in rows if r[1] is not None]
    out = []
    for a, (i, q) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = [(sum(x * y for x, y in zip(q, v, strict=True)), j) for b, (j, v) in enumerate(rows) if b != a and len(v) == len(q)]
        out += [(i, rank, j, s) for rank, (s, j) in enumerate(sorted(scored, key=order)[:k], 1)]
    return out


def brute_negatives(rows, every, low=30, high=90):
    rows = [(i, whole(v), c) for i, v, c in rows]
    rows = [r for r in rows if r[1] is not None and r[2] is not None]
    out = []
    for a, (i, q, c) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = sorted([(sum(x * y for x, y in zip(q, v, strict=True)), j, l) for b, (j, v, l) in enumerate(rows) if b != a and len(v) == len(q)], key=order)
        for ps, pid, _ in [r for r in scored if r[2] == c][:5]:
            fits = [r for r in scored if r[2] != c and low * ps <= 100 * r[0] <= high * ps][:10]
            out += [(i, pid, rank, j, ps, s) for rank, (s, j, _) in enumerate(fits, 1)]
    return out


def edge_rows():
    """All kinds of vectors: copies, ties, nulls, numbers that aren't finite, other lengths, very long and zero ones."""
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.15) for _ in range(12)], rng.randrange(3)) for i in range(300)]
    same = [0.25, -0.5, 0.125] + [0.0] * 9
    rows += [(i, list(same), i % 2) for i in range(300, 460)]
    rows += [(i, [x * rng.choice([0.01, 3, 40]) for x in rows[i - 460][1]], rng.randrange(3)) for i in range(460, 540)]
    rows += [(540, None, 1), (550, [0.1] * 11 + [None], 1), (600, [0.1] * 11 + [float("nan")], 1), (650, [float("-inf")] + [0.1] * 11, 2)]
    rows += [(700, [], 0), (701, [], 1), (702, [], 0), (750, [0.5], 0), (751, [-0.5], 1), (752, [0.25], 0), (753, [0.4], 1)]
    rows += [(800, [0.0] * 12, 1), (801, [0.0] * 12, 1), (802, [0.0] * 12, 0), (900, [1e4] * 12, 1), (901, [-1e4] * 12, 0), (902, [9e3] * 12, 0)]
    rows += [(None, list(same), 1), (None, rows[7][1], 0), (0, rows[0][1], 0), (0, rows[0][1], 0), (1000, list(same), None)]
    return rows


def key(r):
    return tuple((v is None, v) for v in r)


@pytest.mark.parametrize(("k", "segment_rows"), [(5, 50), (1, 1 << 16), (1000, 200)])
def test_top_k_against_brute_force(spark, k, segment_rows):
    rows = edge_rows()
    got = bit_sliced.top_k(table(spark, rows), k=k, segment_rows=segment_rows)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_top(rows, k, 50), key=key)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]


def test_slices_add_up():
    """The slices of a segment give its rows and, with any weights, their order back."""
    rng = np.random.default_rng(1)
    for n, dim in ((1, 1), (63, 3), (64, 5), (130, 20)):
        values = rng.integers(-300, 300, (n, dim))
        values[:, 0] = 7
        segment = bit_sliced.Segment.build(values)
        assert (segment.values(np.arange(n)) == values).all()
        for weights in (rng.integers(-300, 300, dim), np.zeros(dim, np.int64), np.full(dim, -1)):
            scores = np.zeros(n, np.int64)
            for b, bitmap in enumerate(segment.score_slices(weights)):
                scores[bit_sliced.rows_of(bitmap, n)] += 1 << b
            exact = values @ weights
            assert len(set((scores - exact).tolist())) == 1
            for k in (1, 5, n - 1):
                want = np.lexsort((np.arange(n), -exact))[:k]
                assert sorted(segment.top_rows(weights, k)) == sorted(want)


def test_scores_that_do_not_fit_stop_the_search():
    segment = bit_sliced.Segment.build(np.array([[1 << 40], [5]]))
    with pytest.raises(ValueError, match="64 bits"):
        segment.top_rows(np.array([1 << 40]), 1)


@pytest.mark.parametrize(("bucket_rows", "focus"), [(16, 4), (100, 12), (8192, 4)])
def test_negatives_against_brute_force(spark, bucket_rows, focus):
    rows = edge_rows()
    got = hard_negatives.hard_negatives(table(spark, rows), bucket_rows=bucket_rows, focus=focus)
    want = sorted(brute_negatives(rows, 100), key=key)
    assert sorted((tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=key) == want
    assert len(want) > 100


def test_no_pruned_row_can_reach_the_score():
    """Candidates hold every row of the score asked for, at any score, and prune where vectors are concentrated."""
    rng = np.random.default_rng(2)
    axes = np.eye(16)[rng.integers(0, 16, 400)] * 200 + rng.normal(0, 12, (400, 16))
    cells = np.rint(axes * rng.uniform(0.5, 2, (400, 1))).astype(np.int64)
    bucket = hard_negatives.Bucket(np.arange(400), np.arange(400), np.zeros(400, np.int64), cells)
    pruned = 0
    for a in range(40):
        vector = cells[a]
        length = float(np.sqrt((vector.astype(float) ** 2).sum()))
        unit = vector / length
        scores = cells @ vector
        for least in np.quantile(scores, [0, 0.3, 0.9, 0.99, 1]).astype(np.int64):
            rows = bucket.candidates(unit, length, np.argsort(-np.abs(unit))[:4], least)
            inside = set(range(400)) if rows is None else set(rows.tolist())
            assert set(np.flatnonzero(scores >= least).tolist()) <= inside
            pruned += 400 - len(inside)
    assert pruned > 20_000


def test_empty_tables_and_no_queries(spark):
    for rows in ([], [(1, [0.5, 0.5], 1), (2, [0.5, 0.1], 2)], [(None, None, None)]):
        assert bit_sliced.top_k(table(spark, rows)).collect() == []
        assert hard_negatives.hard_negatives(table(spark, rows)).collect() == []


def test_registered_label_move(spark, tmp_path):
    from pairlift.llm import queries

    rows = [r for r in edge_rows() if r[1] is None or len(r[1]) == 12]
    table(spark, rows).withColumn("embedding", F.col("embedding").cast("array<float>")).write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], (c + 1) % 10 if i is not None and i % 7 == 0 and c is not None else c) for i, v, c in rows]
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = queries.op13_hard_negatives(spark, str(tmp_path)).select(*cols).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_negatives(moved, 100), key=key)
