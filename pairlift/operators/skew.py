"""Joins that stay balanced when one key holds a large share of the rows.

Which keys are hot, and how many rows each has, is read from a mergeable top-k sketch: one
pruned scan, no shuffle of the keys. A hot key is cut into as many pieces as it has tasks'
worth of rows. The sketch only steers how rows are spread, so an approximate answer is
enough; results never depend on it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pairlift.session import shuffle_partitions
from pairlift.workspace import written

# Under this planned size a whole side fits one task, so looking for hot keys is not worth a scan.
SKEW_CHECK_BYTES = 1 << 30
# At most so many hot keys are told apart; each has more rows than an average task, so there are fewer than tasks.
HOT_KEYS = 1000
SKETCH_ITEMS = 65_536
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

# Hash of a hot key -> pieces.
Hot = Mapping[int, int]


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hot_hashes(df: DataFrame, keys: Sequence[str], check_bytes: int | None = None) -> dict[int, int]:
    """Hashes of the keys with more rows than an average shuffle task gets, and the pieces to cut each into.

    A key with a share of the rows gets that share of the shuffle tasks.
    """
    if planned_bytes(df) < (SKEW_CHECK_BYTES if check_bytes is None else check_bytes):
        return {}
    row = df.select(F.xxhash64(*keys).alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {HOT_KEYS}, {SKETCH_ITEMS})").alias("top")
    ).first()
    task = max(1.0, row["n"] / shuffle_partitions(df.sparkSession))
    return {r["item"]: math.ceil(r["count"] / task) for r in row["top"] or [] if r["count"] > task}


def reusable(df: DataFrame, label: str = "input") -> DataFrame:
    """``df``, written first if it is large enough for the hot-key scans to read it again."""
    return written(df, label) if planned_bytes(df) >= SKEW_CHECK_BYTES else df


def _cast_like(df: DataFrame, keys: Sequence[str], model: DataFrame) -> DataFrame:
    types = {f.name: f.dataType for f in model.schema.fields}
    have = {f.name: f.dataType for f in df.schema.fields}
    fix = {k: F.col(k).cast(types[k]) for k in keys if have[k] != types[k]}
    return df.withColumns(fix) if fix else df


SALT = "_salt"


def salted(df: DataFrame) -> DataFrame:
    """``df`` with a number that comes from the place of a row, not from what it holds, so that equal rows spread as well.

    The place is the same in every run over a table on disk: other inputs are written first.
    A chain of joins carries the column along.
    """
    return df if SALT in df.columns else written(df, "spread").withColumn(SALT, F.xxhash64(F.monotonically_increasing_id()))


def _with_pieces(df: DataFrame, keys: Sequence[str], hot: Hot, column: str, *, copy: bool) -> DataFrame:
    """A piece number for each row of a hot key, 0 for others: by its salt, or, with ``copy``, each row once per piece."""
    spark = df.sparkSession
    kept = [*df.columns, column]
    df = df if copy else salted(df)
    table = F.broadcast(spark.createDataFrame(list(hot.items()), "_hash long, _n int"))
    found = df.withColumn("_hash", F.xxhash64(*keys)).join(table, "_hash", "left")
    n = F.coalesce(F.col("_n"), F.lit(1))
    if copy:
        piece = F.explode(F.sequence(F.lit(0), n - 1))
    else:
        piece = F.pmod(F.col(SALT), n).cast("int")
    return found.withColumn(column, piece).select(*kept)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    *,
    null_safe: Sequence[str] = (),
    hot: Hot | None = None,
) -> DataFrame:
    """Join ``left`` to ``right``, whose rows are unique by ``keys``.

    A small right side is broadcast by adaptive execution on its measured size. For
    hot keys of the left side, the left rows are spread over the key's pieces and the one
    matching right row is copied to each. ``hot`` lets a caller look for hot keys
    in the table a longer chain of joins starts from.
    """
    keys = list(keys)
    right = _cast_like(right, keys, left)
    hot = hot_hashes(left, keys) if hot is None else hot
    on = list(keys)
    if hot:
        left = _with_pieces(left, keys, hot, "_piece", copy=False)
        right = _with_pieces(right, keys, hot, "_piece", copy=True)
        on.append("_piece")
    if not null_safe:
        out = left.join(right, on, how)
    else:
        right = right.withColumnsRenamed({k: f"_right_{k}" for k in on})
        tests = [
            F.col(k).eqNullSafe(F.col(f"_right_{k}")) if k in null_safe else F.col(k) == F.col(f"_right_{k}")
            for k in on
        ]
        out = left.join(right, reduce(lambda a, b: a & b, tests), how).drop(*[f"_right_{k}" for k in on])
    return out.drop("_piece")


def grid_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    left_hot: Hot | None = None,
    right_hot: Hot | None = None,
) -> DataFrame:
    """Inner equi-join of two non-unique sides; hot keys become a grid of smaller keys.

    A row of a key that is hot on its own side goes to one piece; the rows of that key
    on the other side are copied to every piece, so each pair still meets exactly once.
    """
    keys = list(keys)
    right = _cast_like(right, keys, left)
    left_hot = hot_hashes(left, keys) if left_hot is None else left_hot
    right_hot = hot_hashes(right, keys) if right_hot is None else right_hot
    on = list(keys)
    # A key that is hot on both sides makes a square of pieces, or rows would be copied too often.
    both = set(left_hot or ()) & set(right_hot or ())
    left_hot, right_hot = ({h: math.ceil(math.sqrt(n)) if h in both else n for h, n in dict(hot or {}).items()} for hot in (left_hot, right_hot))
    # Own pieces first: they are given out by the row's place in its table.
    if left_hot:
        left = _with_pieces(left, keys, left_hot, "_lp", copy=False)
    if right_hot:
        right = _with_pieces(right, keys, right_hot, "_rp", copy=False)
    if left_hot:
        right = _with_pieces(right, keys, left_hot, "_lp", copy=True)
        on.append("_lp")
    if right_hot:
        left = _with_pieces(left, keys, right_hot, "_rp", copy=True)
        on.append("_rp")
    return left.join(right, on).drop("_lp", "_rp")


def small_or_plain(df: DataFrame, max_rows: int | None = None, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` if it has at most ``max_rows`` (BROADCAST_ROWS) rows and ``max_bytes``, else leave the join to Spark.

    Meant for narrow aggregated tables. The rows are read once: a small table comes
    back as literal rows, a larger one is returned unchanged and joins by shuffle.
    """
    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows or rows.nbytes > max_bytes:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
