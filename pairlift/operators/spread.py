"""Parallelism for inputs that arrive in very few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pairlift.operators.skew import planned_bytes

# A small file of one row group is one task whatever the number of cores.
SMALL_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a small, coarsely split input over all cores; larger ones are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = planned_bytes(df)
    splits = max(1, size // (16 << 20))
    if size < SMALL_BYTES and splits < cores:
        return df.repartition(cores)
    return df
