"""Analytics inputs derived from whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairlift.functions.scalars import composite_key
from pairlift.operators.intervals import near_pairs

LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
DISTANCE = 600
SAMPLES = [f"s{i}" for i in range(64)]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def line_pvalues(spark: SparkSession, sf: str) -> DataFrame:
    """(key, grp, p) per line item."""
    return table(spark, sf, "lineitem").select(
        composite_key(LINE_KEY).alias("key"), F.col("l_returnflag").alias("grp"), (F.col("l_extendedprice") / 200000).alias("p")
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("values"), "vec_id", "label"
    )


def variant_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("id", "values")


def trait_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The same vectors read backwards, so that no trait equals its variant."""
    return vectors(spark, sf).select("id", F.reverse("values").alias("values"))


def mean_covariate(spark: SparkSession, sf: str) -> DataFrame:
    """One covariate: the mean over all vectors at each position."""
    means = (
        variant_matrix(spark, sf)
        .select(F.posexplode("values").alias("i", "v"))
        .groupBy("i")
        .agg(F.avg("v").alias("v"))
    )
    return means.agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("cells")).select(
        F.lit("mean").alias("id"), F.col("cells.v").alias("values")
    )


# The downsampling experiment: sizes drawn, and the chromosomes that take part.
DRAWS, DRAW_CHROMS = [40, 53, None], ["c0", "c1", "c2", "c3", "c4"]


def with_gaps(matrix: DataFrame, every: int) -> DataFrame:
    """Without the cells whose position, moved on by the row's id, is divisible by ``every``."""
    gap = lambda v, i: F.when((i + F.col("id").cast("long")) % every != 0, v)
    return matrix.withColumn("values", F.transform("values", gap))


def three_covariates(spark: SparkSession, sf: str) -> DataFrame:
    """Lines c, a, b: the mean of all vectors at each position, of those with an even label, and of those with an id divisible by 3."""
    kept = {"c": F.lit(True), "a": F.col("label") % 2 == 0, "b": F.col("vec_id") % 3 == 0}
    long = vectors(spark, sf).select("vec_id", "label", F.posexplode("values").alias("i", "v"))
    means = long.groupBy("i").agg(*[F.avg(F.when(cond, F.col("v"))).alias(c) for c, cond in kept.items()])
    rows = means.agg(*[F.array_sort(F.collect_list(F.struct("i", F.col(c).alias("v"))))["v"].alias(c) for c in kept])
    return rows.select(F.posexplode(F.array(*[F.struct(F.lit(c).alias("id"), F.col(c).alias("values")) for c in kept])).alias("line", "r")).select(
        "line", "r.id", "r.values"
    )


def variant_locations(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return v.select(F.col("id").alias("snp"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("chr"), (F.col("vec_id") * 1000).alias("pos"))


def trait_locations(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    low = F.col("vec_id") * 1000 + 200
    return v.select(
        F.col("id").alias("gene"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("chr"), low.alias("start"), (low + 500).alias("end")
    )


def _seconds():
    return F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")


def event_points(spark: SparkSession, sf: str) -> DataFrame:
    """(snp, chr, pos, value): every event as a point on its type's time line."""
    return table(spark, sf, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("snp"),
        F.col("event_type").alias("chr"),
        _seconds().alias("pos"),
        "value",
        "user_id",
    )


def user_regions(spark: SparkSession, sf: str) -> DataFrame:
    """(gene, chr, start, end): the hour after each user's first event of a type."""
    first = event_points(spark, sf).groupBy("chr", "user_id").agg(F.min("pos").alias("start"))
    return first.select(
        F.concat_ws("_u", "chr", F.col("user_id").cast("string")).alias("gene"), "chr", "start", (F.col("start") + 3600).alias("end")
    )


def event_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return near_pairs(
        event_points(spark, sf).select("snp", "chr", "pos", "value"), user_regions(spark, sf), DISTANCE
    )


def event_results(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in association result: statistics follow from the event value."""
    p = F.lit(1.0) / (F.lit(1.0) + F.abs("value"))
    return event_pairs(spark, sf).select(
        "snp", "gene", F.col("value").alias("beta"), (F.col("value") / 10).alias("t_stat"),
        p.alias("p_value"), F.least(F.lit(1.0), p * 2).alias("fdr"),
    )


def event_signal(spark: SparkSession, sf: str) -> DataFrame:
    """Partly covered ten-minute steps; the root keeps means clear of decimal ties."""
    steps = event_points(spark, sf).groupBy("chr", F.floor(F.col("pos") / 600).alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(1 + F.avg("value")).alias("value")
    )
    return steps.select(
        "chr", (F.col("b") * 600).alias("start"), (F.col("b") * 600 + F.least(F.lit(600), F.col("n") * 150)).alias("end"), "value"
    )


def event_contacts(spark: SparkSession, sf: str) -> DataFrame:
    bin1 = F.floor(F.col("pos") / 1000)
    return event_points(spark, sf).groupBy("chr", bin1.alias("bin1"), (bin1 + 3 + F.col("user_id") % 3).alias("bin2")).agg(
        F.round(F.sum("value"), 4).alias("value")
    )


def event_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Ground truth with repeated keys: larger events have a second, later line."""
    r = event_results(spark, sf).select(composite_key(["snp", "gene"]).alias("key"), "p_value", "beta")
    once = r.select("key", (F.col("p_value") / 2).alias("raw_p"), F.col("p_value").alias("fdr"), F.lit(1).alias("line"))
    again = r.where(F.col("beta") > 20).select(
        "key", (F.col("p_value") / 3).alias("raw_p"), (F.col("p_value") / 4).alias("fdr"), F.lit(2).alias("line")
    )
    return once.unionByName(again)


def raw_contacts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("chr"), (F.col("l_suppkey") * 1000).alias("pos1"), (F.col("l_partkey") * 1000).alias("pos2")
    ).agg(F.count(F.lit(1)).alias("count"))


def norm_vector(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("chr"), (F.col("l_partkey") + 1).alias("idx")).agg(
        F.when(F.min("l_discount") > 0, F.avg("l_quantity") / 10).alias("value")
    )


def expected_vector(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("chr"), (F.col("l_partkey") + 1).alias("idx")).agg(
        (F.avg("l_tax") + 0.5).alias("value")
    )


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Variant calls with three sample cells built from line items."""
    s = lambda c: F.col(c).cast("bigint").cast("string")
    cells = F.array(
        F.concat(F.lit("0/1:"), s("l_quantity"), F.lit(":CG:"), s("l_linenumber"), F.lit(":x")),
        F.when(F.col("l_discount") == 0, "./.").otherwise(
            F.concat(F.lit("0/0:"), s("l_suppkey"), F.lit(":CH:"), s("l_partkey"), F.lit(":q"))
        ),
        F.when(F.col("l_linenumber") == 1, "0/0:0:CG:0:x").otherwise("bad"),
    )
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("chr"), F.col("l_returnflag")).alias("chrom"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.when(F.col("l_linestatus") == "F", "PASS").otherwise("LOW").alias("filter"),
        cells.alias("samples"),
    )


def line_features(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric and text features of line items for the tree models; some values are missing."""
    return table(spark, sf, "lineitem").select(
        composite_key(LINE_KEY).alias("key"),
        "l_quantity",
        F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("l_discount"),
        "l_tax",
        "l_linestatus",
        "l_returnflag",
        (F.col("l_extendedprice") / 1000).alias("label"),
    )
