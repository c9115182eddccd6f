"""Range joins and signal averages over genomic coordinates.

Equality on the chromosome alone would make every join quadratic per chromosome, so
coordinates are cut into fixed-width bins and the bin joins the equality key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairlift.functions.scalars import fixed_decimals
from pairlift.operators.skew import Hot, grid_join, hot_hashes, lookup_join, salted, small_or_plain
from pairlift.workspace import stable, written

SIGNAL_BIN = 100_000
# Narrower bins would copy a long region too often.
MIN_PAIR_BIN = 5_000


def _bin(pos: Column, width: int) -> Column:
    return F.floor(pos / F.lit(width))


def near_pairs(
    points: DataFrame,
    regions: DataFrame,
    distance: int,
    *,
    bin_width: int | None = None,
    point_hot: Hot | None = None,
    region_hot: Hot | None = None,
) -> DataFrame:
    """Pairs of a point (chr, pos, ...) and a region (chr, start, end, ...) at most ``distance`` apart.

    A point has exactly one bin and a region one copy per bin it reaches, so no pair
    can come out twice. Both bounds are inclusive. Few regions are broadcast: then no point moves.
    """
    width = bin_width or max(int(distance), MIN_PAIR_BIN)
    left = points.withColumn("_bin", _bin(F.col("pos"), width))
    right = regions.withColumn(
        "_bin",
        F.explode(F.sequence(_bin(F.col("start") - distance, width), _bin(F.col("end") + distance, width))),
    )
    if point_hot is None and region_hot is None:
        few = small_or_plain(right)
        # Points stay where they are, so no bin is too large for a task.
        point_hot = region_hot = None if few is right else {}
        right = few
    pairs = grid_join(left, right, ["chr", "_bin"], left_hot=point_hot, right_hot=region_hot)
    return pairs.where(F.col("pos").between(F.col("start") - distance, F.col("end") + distance)).drop("_bin")


def overlap_pairs(
    left: DataFrame,
    right: DataFrame,
    *,
    bin_width: int = SIGNAL_BIN,
    left_hot: Hot | None = None,
    right_hot: Hot | None = None,
) -> DataFrame:
    """Pairs of half-open intervals that share at least one base, plus the ``overlap`` length.

    ``left`` has chr, start, end; ``right`` has chr, start2, end2. Both sides are copied
    to every bin they touch and a pair is kept in the one bin that holds the larger start.
    """

    def bins(start: str, end: str) -> Column:
        last = F.greatest(F.col(start), F.col(end) - 1)
        return F.explode(F.sequence(_bin(F.col(start), bin_width), _bin(last, bin_width)))

    a = left.withColumn("_bin", bins("start", "end"))
    b = right.withColumn("_bin", bins("start2", "end2"))
    first = F.greatest("start", "start2")
    last = F.least("end", "end2")
    joined = grid_join(a, b, ["chr", "_bin"], left_hot=left_hot, right_hot=right_hot)
    return (
        joined.where((first < last) & (_bin(first, bin_width) == F.col("_bin")))
        .withColumn("overlap", last - first)
        .drop("_bin")
    )


def signal_summary(queries: DataFrame, signal: DataFrame, *, bin_width: int = SIGNAL_BIN) -> DataFrame:
    """Per query interval: size, covered bases, sum, mean0 (over all bases) and mean (over covered).

    ``signal`` (chr, start, end, value) must be free of overlaps, as a genome signal
    track is; an overlap stops the job. No query-signal pair is formed: the signal is integrated once, the
    integral is read at the distinct query ends, and a query is the difference of two
    readings. Window groups are single bins, which hold at most one row per base
    and kind whatever the number of queries; totals of whole bins carry over.
    """
    queries, signal = written(queries, "queries"), written(signal, "signal")
    start, end, value = F.col("start"), F.col("end"), F.col("value")
    pieces = (
        signal.where((end > start) & value.isNotNull() & ~F.isnan(value))
        .select(
            "chr",
            start,
            end,
            value,
            F.explode(F.sequence(_bin(start, bin_width), _bin(end - 1, bin_width))).alias("_bin"),
        )
        .select(
            "chr",
            "_bin",
            F.greatest(start, F.col("_bin") * bin_width).alias("pos"),
            F.least(end, (F.col("_bin") + 1) * bin_width).alias("stop"),
            value,
        )
        .withColumn("len", F.col("stop") - F.col("pos"))
    )
    ends = (
        queries.select("chr", F.explode(F.array(start, end)).alias("pos"))
        .distinct()
        .withColumn("_bin", _bin(F.col("pos"), bin_width))
    )

    # Totals before each bin. The table has one row per bin, so its size follows the
    # length of the genome and not the number of rows.
    bin_totals = (
        pieces.select("chr", "_bin", "len", (F.col("len") * value).alias("area"))
        .unionByName(ends.select("chr", "_bin", F.lit(0).cast("long").alias("len"), F.lit(0.0).alias("area")))
        .groupBy("chr", "_bin")
        .agg(F.sum("len").alias("len"), F.sum("area").alias("area"))
    )
    before = Window.partitionBy("chr").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = bin_totals.select(
        "chr",
        "_bin",
        F.coalesce(F.sum("len").over(before), F.lit(0)).alias("_cov0"),
        F.coalesce(F.sum("area").over(before), F.lit(0.0)).alias("_sum0"),
    )

    # Readings inside a bin: pieces that begin before the position, less what reaches past it.
    null_long, null_double = F.lit(None).cast("long"), F.lit(None).cast("double")
    marks = pieces.select(
        "chr", "_bin", F.col("pos").cast("long").alias("pos"), F.lit(1).alias("_kind"),
        F.col("len").cast("long").alias("len"), (F.col("len") * value).alias("area"),
        F.col("stop").cast("long").alias("stop"), value,
    ).unionByName(
        ends.select(
            "chr", "_bin", F.col("pos").cast("long").alias("pos"), F.lit(0).alias("_kind"),
            null_long.alias("len"), null_double.alias("area"), null_long.alias("stop"), null_double.alias("value"),
        )
    )
    run = Window.partitionBy("chr", "_bin").orderBy("pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    # Pieces are cut at bin edges, so two that overlap do so inside a bin.
    reached = F.max("stop").over(run.rowsBetween(Window.unboundedPreceding, -1))
    overlap = (F.col("_kind") == 1) & F.coalesce(F.col("_reached") > F.col("pos"), F.lit(False))
    stop = F.raise_error(F.concat(F.lit("signal intervals overlap at "), "chr", F.lit(":"), F.col("pos").cast("string")))
    past = F.greatest(F.lit(0), F.last("stop", ignorenulls=True).over(run) - F.col("pos"))
    readings = (
        marks.select(
            "chr", "_bin", "pos", "_kind",
            F.coalesce(F.sum("len").over(run) - past, F.lit(0)).alias("_cov"),
            F.coalesce(
                F.sum("area").over(run) - past * F.last("value", ignorenulls=True).over(run), F.lit(0.0)
            ).alias("_sum"),
            reached.alias("_reached"),
        )
        .where(F.when(overlap, stop).otherwise(F.col("_kind") == 0))
        .join(carried, ["chr", "_bin"])
        .select("chr", "pos", "_cov0", "_sum0", "_cov", "_sum")
    )

    # Read once per query end, so the integration is not run twice.
    readings = stable(readings, "readings")

    def at(side: str, col: str) -> DataFrame:
        names = {c: f"{c}_{side}" for c in ("_cov0", "_sum0", "_cov", "_sum")}
        return readings.withColumnRenamed("pos", col).withColumnsRenamed(names)

    hot = {col: hot_hashes(queries, ["chr", col]) for col in ("start", "end")}
    both = salted(queries) if any(hot.values()) else queries
    for side, col in (("a", "start"), ("b", "end")):
        both = lookup_join(both, at(side, col), ["chr", col], hot=hot[col])

    def between(name: str) -> Column:
        # Whole bins and in-bin parts are subtracted apart, so short queries lose no digits.
        return (F.col(f"{name}0_b") - F.col(f"{name}0_a")) + (F.col(f"{name}_b") - F.col(f"{name}_a"))

    covered = between("_cov")
    total = F.when(covered > 0, between("_sum")).otherwise(F.lit(0.0))
    size = end - start
    return both.select(
        *queries.columns,
        size.alias("size"),
        covered.alias("covered"),
        total.alias("sum"),
        F.try_divide(total, size).alias("mean0"),
        F.try_divide(total, covered).alias("mean"),
    )


def attach_signal(
    queries: DataFrame,
    signal: DataFrame,
    *,
    out: str = "recomb",
    min_data: int = 1,
    use_mean0: bool = False,
    na_as: float | None = None,
    digits: int | None = None,
    bin_width: int = SIGNAL_BIN,
) -> DataFrame:
    """``queries`` plus their mean signal; ``na_as`` where fewer than ``min_data`` bases are covered."""
    summary = signal_summary(queries, signal, bin_width=bin_width)
    mean = F.col("mean0" if use_mean0 else "mean")
    if digits is not None:
        mean = fixed_decimals(mean, digits)
    value = F.when(F.col("covered") >= min_data, mean).otherwise(F.lit(na_as).cast("double"))
    return summary.select(*queries.columns, value.alias(out))


def in_region(df: DataFrame, chrom: str, start: int | None = None, end: int | None = None, pos: str = "pos") -> DataFrame:
    """Rows of one chromosome, optionally within [start, end]."""
    df = df.where(F.col("chr") == chrom)
    if start is not None:
        df = df.where(F.col(pos) >= start)
    if end is not None:
        df = df.where(F.col(pos) <= end)
    return df


def parse_region(text: str) -> tuple[str, int | None, int | None]:
    """``chr1`` or ``chr1:100-200``."""
    chrom, _, span = text.partition(":")
    if not span:
        return chrom, None, None
    low, _, high = span.replace(",", "").partition("-")
    return chrom, int(low), int(high) if high else None
