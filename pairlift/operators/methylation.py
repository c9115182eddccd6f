"""Methylation matrix from variant calls of bisulfite reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairlift.functions.scalars import fixed_decimals
from pairlift.operators.spread import spread


def methylation_ratios(cells: Column, context: str = r"\w+") -> Column:
    """C / (C + T) to five decimals per sample cell; NULL for a missing call or no reads.

    Each step binds its value once: expressions inside a lambda are evaluated as often
    as they are written.
    """
    pattern = rf":\d+:(?:{context}):\d+:"
    parts = F.transform(cells, lambda cell: F.split(F.regexp_extract(cell, pattern, 0), ":"))
    reads = F.transform(
        parts,
        lambda p: F.struct(
            F.get(p, F.lit(1)).try_cast("double").alias("c"), F.get(p, F.size(p) - 2).try_cast("double").alias("t")
        ),
    )
    ratios = F.transform(reads, lambda r: F.try_divide(r["c"], r["c"] + r["t"]))
    return F.transform(ratios, lambda x: F.when(x.isNotNull(), fixed_decimals(x, 5)))


def methylation_matrix(calls: DataFrame, context: str = r"\w+") -> DataFrame:
    """(id, values) for calls that pass the filter; ids are ``cg:<chrom>-<pos>``."""
    return spread(calls).where(F.col("filter") == "PASS").select(
        F.concat(F.lit("cg:"), "chrom", F.lit("-"), F.col("pos").cast("string")).alias("id"),
        methylation_ratios(F.col("samples"), context).alias("values"),
    )
