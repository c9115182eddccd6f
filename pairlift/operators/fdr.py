"""Benjamini-Hochberg false discovery rate at scale.

q of rank i is the minimum over j >= i of n * p_j / j, at most 1: a step function of p. So it
is computed on the narrow table of distinct p-values with their counts, and joined back to
the rows, which are scanned once for it. A p that very many rows share is one counted row
from the first combine on.

A window over all p-values would put them into one task. They are cut into buckets of about
equal size; ranks and minima are taken inside a bucket, and one row per bucket carries the
count before it and the minimum behind it. Any bucket edges give the exact result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairlift.operators.skew import lookup_join, small_or_plain
from pairlift.session import shuffle_partitions
from pairlift.workspace import stable, written

# Cells of the histogram for each power of two; parts of a crowded cell per bucket that it should fill.
CELLS, FINENESS = 32, 8


def _cell(p: Column) -> Column:
    """A whole number that rises with ``p``; doubles have about 70,000 such cells of either sign."""
    size = F.floor(F.log2(F.least(F.abs(p), F.lit(1e308))) * CELLS) + 2000 * CELLS
    return F.when(p > 0, size).when(p < 0, -size).otherwise(F.lit(0))


def quantile_edges(values: DataFrame, column: str, buckets: int) -> list[float]:
    """Values that cut a column into about ``buckets`` parts of like counts.

    A histogram of two levels, both combined before they are shuffled: fixed cells on a log
    scale, then, if there are any, equal parts of the cells that hold more than two buckets'
    share. Its size is that of the cells and some ``buckets``, whatever the number of values.
    Edges are values of the column. A value that many rows share can't be cut.
    """
    p = F.col(column)
    facts = [F.count(F.lit(1)).alias("n"), F.min(p).alias("low"), F.max(p).alias("high")]
    cells = values.select(p, _cell(p).alias("_cell")).groupBy("_cell").agg(*facts).orderBy("_cell").collect()
    share = max(1.0, sum(c["n"] for c in cells) / max(1, buckets))
    crowded = [(c["_cell"], c["low"], c["high"], int(FINENESS * c["n"] / share)) for c in cells if c["n"] > 2 * share and -float("inf") < c["low"] < c["high"] < float("inf")]
    parts = {}
    if crowded:
        shape = F.broadcast(values.sparkSession.createDataFrame(crowded, "_cell long, _low double, _high double, _m long"))
        part = F.least(F.floor((p - F.col("_low")) / (F.col("_high") - F.col("_low")) * F.col("_m")), F.col("_m") - 1)
        finer = values.select(p, _cell(p).alias("_cell")).join(shape, "_cell").select(p, "_cell", part.alias("_part"))
        for row in finer.groupBy("_cell", "_part").agg(*facts).orderBy("_cell", "_part").collect():
            parts.setdefault(row["_cell"], []).append(row)
    edges, held = [], 0
    for cell in cells:
        for piece in parts.get(cell["_cell"], [cell]):
            if held and held + piece["n"] > share:
                edges.append(float(piece["low"]))
                held = 0
            held += piece["n"]
    return edges


def _bucketed(df: DataFrame, edges: list[float]) -> DataFrame:
    inner = sorted({e for e in edges if abs(e) != float("inf")}) or [0.0]
    cut = Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol="_p", outputCol="_bucket")
    return cut.transform(df).withColumn("_bucket", F.col("_bucket").cast("int"))


def bh_adjust(
    df: DataFrame,
    p_col: str = "p_value",
    *,
    by: Sequence[str] = (),
    n_tests: int | None = None,
    log10: bool = False,
    out: str = "fdr",
    alpha: float | None = None,
    digits: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """``df`` plus the adjusted value ``out``. Rows without a p-value are no tests and are left out.

    by: adjust within groups. n_tests: number of tests done, when ``df`` holds only the
    reported ones. log10: ``p_col`` holds -log10(p); ranks and minima are then taken in
    log space. alpha: adds a ``significant`` flag. digits: rounds the result.
    """
    by = list(by)
    # Zero has one sign here, so that it is one value.
    rows = written(df, "tests").withColumn("_p", F.col(p_col).cast("double") + 0.0)
    rows = rows.where(F.col("_p").isNotNull() & ~F.isnan("_p"))
    narrow = rows.select(*by, "_p")
    # More buckets than tasks, so that hashing them to tasks comes out even.
    edges = quantile_edges(narrow, "_p", buckets or 8 * shuffle_partitions(df.sparkSession))

    # One row per (group, bucket): tests up to its end.
    per_bucket = _bucketed(narrow, edges).groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_in"))
    earlier = Window.partitionBy(*by).orderBy(F.desc("_bucket") if log10 else F.asc("_bucket"))
    total = F.lit(n_tests) if n_tests is not None else F.sum("_in").over(Window.partitionBy(*by))
    offsets = small_or_plain(
        per_bucket.select(
            *by,
            "_bucket",
            F.sum("_in").over(earlier.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
            total.cast("double").alias("_n"),
        )
    )

    # From the largest p down, one sort serves the rank and the running minimum: a rank is
    # what the bucket's end has, less the tests with a larger p.
    down = Window.partitionBy(*by, "_bucket").orderBy(F.asc("_p") if log10 else F.desc("_p"))
    upto_here = down.rowsBetween(Window.unboundedPreceding, 0)
    counts = _bucketed(narrow.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_c")), edges)
    table = lookup_join(counts, offsets, [*by, "_bucket"], null_safe=by, hot=[])
    ranked = table.withColumn("_rank", F.col("_upto") - (F.sum("_c").over(upto_here) - F.col("_c")))
    raw = F.log10("_n") - F.col("_p") - F.log10("_rank") if log10 else F.col("_n") * F.col("_p") / F.col("_rank")
    inside = stable(ranked.withColumn("_raw", raw).select(*by, "_p", "_bucket", F.min("_raw").over(upto_here).alias("_run")), "p-minima")

    minima = inside.groupBy(*by, "_bucket").agg(F.min("_run").alias("_m"))
    behind = Window.partitionBy(*by).orderBy(F.asc("_bucket") if log10 else F.desc("_bucket"))
    tails = small_or_plain(
        minima.select(*by, "_bucket", F.min("_m").over(behind.rowsBetween(Window.unboundedPreceding, -1)).alias("_tail"))
    )
    value = F.least(F.lit(0.0 if log10 else 1.0), "_run", "_tail")
    if log10:
        value = F.pow(F.lit(10.0), value)
    steps = lookup_join(inside, tails, [*by, "_bucket"], null_safe=by, hot=[]).select(*by, "_p", value.alias(out))
    if dict(df.dtypes).get(p_col) == "double":
        # The column itself is the key, where both zeros are equal: one number less to move for each row.
        steps, rows, key = steps.withColumnRenamed("_p", p_col), rows.drop("_p"), p_col
    else:
        key = "_p"
    result = lookup_join(rows, steps, [*by, key], null_safe=by).select(*df.columns, out)
    if alpha is not None:
        result = result.withColumn("significant", F.col(out) <= alpha)
    # Rounded last: a value just above alpha must not become significant by its printed form.
    return result if digits is None else result.withColumn(out, F.round(out, digits))
