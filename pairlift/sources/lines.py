"""Text lines with their position in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairlift.operators.skew import small_or_plain
from pairlift.workspace import stable


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) with 0-based contiguous numbers in file order; files follow in path order.

    Each file split keeps its own running ids; splits are put in order by one small row
    each. The text is written once first, so both passes see the same splits.
    """
    lines = stable(
        spark.read.text(path).select(
            "value",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_at"),
            F.monotonically_increasing_id().alias("_id"),
        ),
        "lines",
    )
    splits = lines.groupBy("_file", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = small_or_plain(
        splits.select("_file", "_at", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return lines.join(starts, ["_file", "_at"]).select(
        (F.col("_id") - F.col("_first") + F.col("_offset")).alias("line"), "value"
    )
