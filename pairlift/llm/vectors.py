"""What the vector searches share: whole-number vectors, and queries that meet an index tile by tile."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairlift.session import shuffle_partitions

SCALE = 256


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and each component is a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & finite


def tile_counts(df: DataFrame, n_left: int, left_rows: int, least_left: int, right_tiles: int) -> int:
    """Tiles of ``n_left`` queries: at most ``left_rows`` a tile, and enough of them that every task slot gets cells of the grid.

    Tiles of fewer than ``least_left`` queries aren't made for the sake of parallel work.
    """
    wanted = 2 * max(shuffle_partitions(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism)
    tiles = max(-(-n_left // left_rows), min(-(-wanted // max(1, right_tiles)), n_left // least_left))
    return max(1, tiles)


def meet(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_tiles: int,
    right_tiles: int,
    kernel: Callable[[pa.Table, pa.Table], Iterator[pa.Table] | pa.Table],
    ddl: str,
) -> DataFrame:
    """``kernel`` over each cell of the grid of left and right tiles (columns ``_lt`` and ``_rt``) of equal ``keys``.

    A row of one side is copied once for each tile of the other, so every left row meets every
    right row once; a cell holds one tile of each side and no more, whatever the values are.
    """
    cells = left_tiles * right_tiles
    spread = min(cells, 8 * max(shuffle_partitions(left.sparkSession), left.sparkSession.sparkContext.defaultParallelism))
    on = [*keys, "_lt", "_rt"]
    a = left.withColumn("_rt", F.explode(F.sequence(F.lit(0), F.lit(right_tiles - 1)))).repartition(spread, *on)
    b = right.withColumn("_lt", F.explode(F.sequence(F.lit(0), F.lit(left_tiles - 1)))).repartition(spread, *on)
    return a.groupBy(*on).cogroup(b.groupBy(*on)).applyInArrow(kernel, ddl)
