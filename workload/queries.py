"""One query per operator: (spark, folder of driver tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairlift.functions.scalars import composite_key, from_neg_log10, neg_log10
from pairlift.functions.tdist import t_pvalue
from pairlift.operators import annotate, association, contacts, dedup, intervals, matrices, models, quality, ratios, sampling
from pairlift.operators.fdr import bh_adjust
from pairlift.operators.methylation import methylation_matrix
from pairlift.plans import rescoring
from pairlift.plans.downsample import downsample_association
from pairlift.sinks import tables as sink
from pairlift.sources import delimited, genomics as g
from pairlift.workspace import scratch_path, stable
from workload import inputs as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Fixed decimals (and no negative zero), so that summation order cannot show."""
    return df.withColumns({c: F.round(c, n) + F.lit(0.0) for c, n in digits.items()})


# --- false discovery rate ---------------------------------------------------------


@query
def bh_fdr(spark, sf):
    return rounded(bh_adjust(t.line_pvalues(spark, sf).select("key", "p"), "p"), {"p": 8, "fdr": 8})


@query
def bh_fdr_log10p(spark, sf):
    rows = t.line_pvalues(spark, sf).select("key", neg_log10(F.col("p")).alias("neg_log10_p"))
    return rounded(bh_adjust(rows, "neg_log10_p", log10=True), {"neg_log10_p": 8, "fdr": 8})


@query
def bh_fdr_by_group(spark, sf):
    return rounded(bh_adjust(t.line_pvalues(spark, sf), "p", by=["grp"]), {"p": 8, "fdr": 8})


@query
def bh_fdr_flagged(spark, sf):
    out = bh_adjust(t.line_pvalues(spark, sf).select("key", "p"), "p", n_tests=1_000_000, alpha=0.5, digits=4)
    return out.select("key", "fdr", F.col("significant").cast("int").alias("significant"))


@query
def pvalue_transforms(spark, sf):
    rows = t.table(spark, sf, "lineitem").select(
        composite_key(t.LINE_KEY).alias("key"),
        neg_log10(F.col("l_extendedprice") / 200000).alias("neg_log10_p"),
        from_neg_log10(F.col("l_tax")).alias("p_of_tax"),
    )
    return rounded(rows, {"neg_log10_p": 8, "p_of_tax": 8})


# --- association ------------------------------------------------------------------


def _assoc_out(df: DataFrame) -> DataFrame:
    out = df.select("snp", "gene", "beta", "t_stat", "p_value", "fdr")
    return rounded(out, {"beta": 6, "t_stat": 6, "p_value": 6, "fdr": 6})


@query
def assoc_linear(spark, sf):
    return _assoc_out(association.all_pairs_association(t.variant_matrix(spark, sf), t.trait_matrix(spark, sf), p_max=1.0))


@query
def assoc_linear_cov(spark, sf):
    return _assoc_out(
        association.all_pairs_association(t.variant_matrix(spark, sf), t.trait_matrix(spark, sf), t.mean_covariate(spark, sf), p_max=1.0)
    )


@query
def assoc_interaction(spark, sf):
    return _assoc_out(
        association.interaction_association(t.variant_matrix(spark, sf), t.trait_matrix(spark, sf), t.mean_covariate(spark, sf), p_max=1.0)
    )


@query
def assoc_all_pairs_pruned(spark, sf):
    return _assoc_out(association.all_pairs_association(t.variant_matrix(spark, sf), t.trait_matrix(spark, sf), p_max=0.001))


def _located(spark, sf):
    return t.variant_matrix(spark, sf), t.trait_matrix(spark, sf), t.variant_locations(spark, sf), t.trait_locations(spark, sf)


@query
def assoc_cis(spark, sf):
    return _assoc_out(association.cis_association(*_located(spark, sf), distance=20_000))


@query
def assoc_trans(spark, sf):
    return _assoc_out(association.trans_association(*_located(spark, sf), distance=20_000, p_max=0.01))


@query
def assoc_trans_tight(spark, sf):
    """A threshold that few pairs reach: tiles that can't are skipped, their pairs counted as tests all the same."""
    return _assoc_out(association.trans_association(*_located(spark, sf), distance=20_000, p_max=1e-4, prune=True, tile_rows=64))


@query
def assoc_covariates(spark, sf):
    """Three covariates, an interaction with the first, and missing cells in both matrices."""
    snps, genes = t.with_gaps(t.variant_matrix(spark, sf), 7), t.with_gaps(t.trait_matrix(spark, sf), 11)
    out = association.interaction_association(snps, genes, t.three_covariates(spark, sf), interact="a", p_max=1.0)
    return rounded(out.select("snp", "gene", "beta", "t_stat"), {"beta": 6, "t_stat": 6})


@query
def downsample_assoc(spark, sf):
    snps, genes, snp_loc, gene_loc = _located(spark, sf)
    both = g.Matrix(snps, t.SAMPLES), g.Matrix(genes, t.SAMPLES)
    out = downsample_association(*both, snp_loc, gene_loc, sizes=t.DRAWS, chroms=t.DRAW_CHROMS, distance=20_000, p_cis=0.5, p_trans=0.01)
    cols = ["subset", "kind", "snp", "gene", "beta", "t_stat", "p_value", "fdr"]
    return rounded(out.select(*cols), {c: 6 for c in cols[4:]})


@query
def assoc_complete_cells(spark, sf):
    snps, genes, snp_loc, gene_loc = _located(spark, sf)
    pairs = intervals.near_pairs(snp_loc, gene_loc, 20_000).select("snp", "gene")
    out = association.pairwise_regression(matrices.melt(snps), matrices.melt(genes), pairs)
    return rounded(out.withColumn("n", F.col("n").cast("int")), {"r": 6, "beta": 6, "t_stat": 6})


@query
def assoc_pvalue(spark, sf):
    rows = t.table(spark, sf, "lineitem").select(
        composite_key(t.LINE_KEY).alias("key"), t_pvalue((F.col("l_quantity") - 25) / 5, 10.0).alias("s")
    )
    return rounded(rows.select("key", "s.p_value"), {"p_value": 8})


# --- intervals --------------------------------------------------------------------


@query
def cis_pairs(spark, sf):
    return t.event_pairs(spark, sf).select("snp", "gene", "chr", "pos", "start", "end")


@query
def region_filter(spark, sf):
    chrom, low, high = intervals.parse_region("click:1704500000-1705500000")
    return intervals.in_region(t.event_points(spark, sf), chrom, low, high).select("snp", "chr", "pos")


def _event_located(spark, sf):
    points = t.event_points(spark, sf).select("snp", "chr", "pos")
    return annotate.add_coordinates(t.event_results(spark, sf), points, t.user_regions(spark, sf))


def _event_spans(spark, sf):
    rows = _event_located(spark, sf).select("chr", "start", "end", "snp", "gene", "p_value")
    return dedup.first_per_key(rows, order_by=["p_value", "snp", "gene"])


@query
def pair_span(spark, sf):
    return rounded(annotate.pair_bed(_event_located(spark, sf)), {"beta": 6, "t_stat": 6, "p_value": 8, "fdr": 8})


def _two_beds(located):
    cols = ["chr", "start", "end", "name", "snp", "gene"]
    snps = annotate.snp_bed(located).select(F.lit("snp").alias("kind"), *cols)
    return snps.unionByName(annotate.gene_bed(located).select(F.lit("gene").alias("kind"), *cols))


@query
def pair_beds(spark, sf):
    return _two_beds(_event_located(spark, sf))


@query
def dedup_first(spark, sf):
    return rounded(_event_spans(spark, sf), {"p_value": 8})


@query
def dedup_first_line(spark, sf):
    rows = t.table(spark, sf, "lineitem").select(*t.LINE_KEY, "l_extendedprice")
    return dedup.first_per_key(rows, ["l_orderkey"], ["l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber"])


@query
def dedup_adjacent(spark, sf):
    rows = t.table(spark, sf, "events").select("event_id", "ts", "event_type", "user_id")
    return dedup.adjacent_distinct(rows, ["event_type"], ["ts", "event_id"]).drop("ts")


@query
def overlap_pairs(spark, sf):
    signal = t.event_signal(spark, sf).select("chr", F.col("start").alias("start2"), F.col("end").alias("end2"))
    out = intervals.overlap_pairs(t.user_regions(spark, sf), signal, bin_width=5000)
    return out.select("gene", "chr", "start", "end", "start2", "end2", "overlap")


@query
def interval_signal(spark, sf):
    spans = _event_spans(spark, sf).select("chr", "start", "end")
    out = intervals.signal_summary(spans, t.event_signal(spark, sf))
    return rounded(out, {"sum": 6, "mean0": 6, "mean": 6})


@query
def interval_signal_mean0(spark, sf):
    spans = _event_spans(spark, sf).select("chr", "start", "end")
    return intervals.attach_signal(spans, t.event_signal(spark, sf), use_mean0=True, min_data=1000, na_as=-1.0, digits=3)


# --- contacts and ratios ----------------------------------------------------------


@query
def contact_lookup(spark, sf):
    spans = _event_spans(spark, sf).drop("p_value")
    return contacts.contact_lookup(spans, t.event_contacts(spark, sf))


@query
def contact_norm(spark, sf):
    return rounded(contacts.normalise_contacts(t.raw_contacts(spark, sf), t.norm_vector(spark, sf)), {"value": 8})


@query
def contact_oe(spark, sf):
    out = contacts.normalise_contacts(t.raw_contacts(spark, sf), t.norm_vector(spark, sf), expected=t.expected_vector(spark, sf))
    return rounded(out, {"value": 8})


@query
def signal_oe(spark, sf):
    spans = _event_spans(spark, sf).select("chr", "start", "end")
    seen = stable(intervals.attach_signal(spans, t.event_signal(spark, sf), out="o"), "signal")
    groups = seen.groupBy("chr", (F.col("end") - F.col("start")).alias("len")).agg(F.count(F.lit(1)).alias("n"), F.avg("o").alias("a"))
    summary = groups.where("n <> 4").select(
        "chr", "len", F.when(F.col("n") == 2, 0.0).when(F.col("n") > 2, F.col("a")).alias("expected")
    )
    out = ratios.observed_expected(seen, summary, "o").drop("o")
    return rounded(out, {"observed": 6, "expected": 6, "ratio": 6, "difference": 6})


# --- matrices and calls -----------------------------------------------------------


def _methylation_columns(rows: DataFrame, n: int) -> DataFrame:
    return rows.select("id", *[F.get("values", F.lit(i)).alias(f"m{i + 1}") for i in range(n)])


@query
def vcf_methylation(spark, sf):
    return _methylation_columns(methylation_matrix(t.calls(spark, sf)), 3)


@query
def vcf_methylation_cg(spark, sf):
    return _methylation_columns(methylation_matrix(t.calls(spark, sf), "CG"), 3)


@query
def matrix_melt(spark, sf):
    return matrices.melt(t.variant_matrix(spark, sf), t.SAMPLES)


@query
def matrix_subset(spark, sf):
    picked = matrices.take_samples(t.variant_matrix(spark, sf), matrices.pick_samples(t.SAMPLES, 20))
    located = t.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("snp"))
    return matrices.melt(matrices.keep_located(picked, located, "snp"))


# --- features, sampling, metrics --------------------------------------------------


def _features(spark, sf):
    points = t.event_points(spark, sf).select("snp", "chr", "pos")
    return rescoring.pair_features(
        t.event_results(spark, sf), points, t.user_regions(spark, sf), t.event_contacts(spark, sf), t.event_signal(spark, sf)
    )


@query
def feature_matrix(spark, sf):
    return rounded(rescoring.model_input(_features(spark, sf)), {"neg_log10": 8, "recomb": 6})


@query
def class_counts(spark, sf):
    return sampling.class_counts(t.event_truth(spark, sf), 0.05)


@query
def training_set(spark, sf):
    out = rescoring.training_set(_features(spark, sf), t.event_truth(spark, sf), threshold=0.05, positives=400, negatives=900)
    return rounded(out, {"neg_log10": 8, "recomb": 6, "label": 8})


@query
def fold_split(spark, sf):
    rows = t.table(spark, sf, "lineitem").select(composite_key(t.LINE_KEY).alias("key"))
    return sampling.with_fold(rows, ["key"])


@query
def train_valid_split(spark, sf):
    rows = t.table(spark, sf, "lineitem").select(composite_key(t.LINE_KEY).alias("key"))
    flagged = sampling.with_validation(rows, ["key"])
    return flagged.select("key", F.col("is_validation").cast("int").alias("is_validation"))


@query
def pvalue_histogram(spark, sf):
    return rounded(quality.pvalue_histogram(t.line_pvalues(spark, sf), "p"), {"neg_log10_expected": 8})


def _line_predictions(spark, sf):
    return t.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("grp"), (F.col("l_extendedprice") / 1000).alias("label"), (F.col("l_quantity") * 1.5).alias("prediction")
    )


@query
def regression_metrics(spark, sf):
    out = quality.regression_metrics(_line_predictions(spark, sf), by=["grp"])
    return rounded(out, {"mse": 6, "rmse": 6, "r2": 6, "explained_variance": 6})


@query
def fold_summary(spark, sf):
    out = quality.fold_summary(quality.regression_metrics(_line_predictions(spark, sf), by=["grp"]))
    return rounded(out, {"best_r2": 6, "best_mse": 6, "mean_mse": 6})


@query
def run_counters(spark, sf):
    """Rows in and rows kept, both counted while the de-duplicated table is written."""
    rows, total = quality.counted(t.table(spark, sf, "lineitem").select(*t.LINE_KEY), "lines_in", total=F.count(F.lit(1)))
    kept, unique = quality.counted(dedup.first_per_key(rows, ["l_orderkey"], t.LINE_KEY[1:]), "lines_out", kept=F.count(F.lit(1)))
    stable(kept, "counted")
    return spark.createDataFrame([(total.get["total"], unique.get["kept"])], "total long, kept long")


# --- models -----------------------------------------------------------------------

SMALL = {"trees": 5, "depth": 3, "bins": 32}
NUMERIC = ["l_quantity", "l_discount", "l_tax"]


@query
def gbt_regression(spark, sf):
    rows = sampling.with_validation(t.line_features(spark, sf), ["key"])
    model = models.fit_regression(rows, NUMERIC, categorical=["l_linestatus"], validation_col="is_validation", **SMALL)
    return models.score(model, rows).select("key", "label", "prediction")


@query
def rf_regression(spark, sf):
    rows = t.line_features(spark, sf)
    model = models.fit_regression(rows, NUMERIC, kind="rf", **SMALL)
    return models.score(model, rows).select("key", "label", "prediction")


@query
def gbt_classification(spark, sf):
    rows = t.line_features(spark, sf).drop("label")
    model = models.fit_classifier(rows, NUMERIC, "l_linestatus", kind="gbt", **SMALL)
    return models.score(model, rows).select("key", "l_linestatus", "prediction")


@query
def rf_classification(spark, sf):
    rows = t.line_features(spark, sf).drop("label")
    model = models.fit_classifier(rows, NUMERIC, "l_returnflag", **SMALL)
    return models.score(model, rows).select("key", "l_returnflag", "prediction")


@query
def kfold_cv(spark, sf):
    rows = sampling.with_fold(t.line_features(spark, sf), ["key"], k=3)
    return models.cross_validate(rows, NUMERIC, k=3, **SMALL)[1]


@query
def feature_importance(spark, sf):
    model = models.fit_regression(t.line_features(spark, sf), NUMERIC, kind="rf", **SMALL)
    return models.feature_importance(model, spark)


@query
def model_save_load(spark, sf):
    rows = t.line_features(spark, sf)
    path = scratch_path(spark, "model")
    models.save_model(models.fit_regression(rows, NUMERIC, kind="rf", **SMALL), path)
    return models.score(models.load_model(path), rows.drop("label")).select("key", "prediction")


@query
def detect_plan(spark, sf):
    features = stable(_features(spark, sf), "features")
    rows = rescoring.training_set(features, t.event_truth(spark, sf), threshold=0.05)
    model = models.fit_regression(rows, rescoring.FEATURES, **SMALL)
    return rescoring.detect(features, model).select("key", "snp", "gene", "prediction", "adjusted")


@query
def train_plan(spark, sf):
    rows = rescoring.training_set(_features(spark, sf), t.event_truth(spark, sf), threshold=0.05)
    return rescoring.train(rows, k=2, **SMALL).validation


# Fits whose answer is known: a category decides the label, alone or up to noise that has its own mean.
# All settings are the operators' defaults: 100 trees of depth 5, 100 bins.


def _known(spark, sf):
    """(key, c, zero, level, noisy): ``level`` follows from c, ``noisy`` scatters around a mean per c; ``zero`` tells nothing."""
    rows = t.table(spark, sf, "lineitem")
    level = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 2.5).otherwise(4.0)
    return rows.select(
        composite_key(t.LINE_KEY).alias("key"), F.col("l_returnflag").alias("c"), F.lit(0.0).alias("zero"), level.alias("level"),
        (level + F.col("l_quantity") % 7).alias("noisy"),
    )


@query
def gbt_group_means(spark, sf):
    rows = _known(spark, sf)
    model = models.fit_regression(rows, ["zero"], "noisy", categorical=["c"])
    return rounded(models.score(model, rows.drop("noisy")).select("key", "c", "prediction"), {"prediction": 6})


@query
def gbt_early_stop(spark, sf):
    """Held-out rows end the boosting once nothing improves: here the first tree is right."""
    rows = sampling.with_validation(_known(spark, sf), ["key"])
    model = models.fit_regression(rows, ["zero"], "level", categorical=["c"], validation_col="is_validation")
    scored = rounded(models.score(model, rows), {"prediction": 6}).select("key", "is_validation", "prediction")
    return scored.withColumn("few_trees", F.lit(model.stages[-1].getNumTrees < 10))


@query
def rf_levels(spark, sf):
    rows = _known(spark, sf)
    model = models.fit_regression(rows, [], "level", kind="rf", categorical=["c"])
    return rounded(models.score(model, rows.drop("level")).select("key", "c", "prediction"), {"prediction": 6})


@query
def classes_by_category(spark, sf):
    """Both classifiers on classes that the category decides; a missing category is a category of its own."""
    rows = _known(spark, sf).withColumns({"three": F.concat(F.lit("is-"), F.col("c")), "two": F.when(F.col("c") == "N", "new").otherwise("old")})
    rows = rows.withColumn("c", F.when(F.col("c") != "R", F.col("c")))
    forest = models.fit_classifier(rows, ["zero"], "three", categorical=["c"])
    boosted = models.fit_classifier(rows, ["zero"], "two", categorical=["c"], kind="gbt", trees=20)
    three = models.score(forest, rows).withColumnRenamed("prediction", "forest")
    return models.score(boosted, three).select("key", "forest", F.col("prediction").alias("boosted"))


@query
def kfold_levels(spark, sf):
    """Ten folds: each row is held out once, and each fit on the nine others is right."""
    rows = sampling.with_fold(_known(spark, sf), ["key"])
    metrics = models.cross_validate(rows, [], "level", categorical=["c"], kind="rf", trees=20)[1]
    return rounded(metrics.select("fold", "n", "mse", "r2"), {"mse": 6, "r2": 6})


@query
def importance_of_category(spark, sf):
    model = models.fit_regression(_known(spark, sf), ["zero"], "level", kind="rf", categorical=["c"])
    return rounded(models.feature_importance(model, spark), {"importance": 6})


@query
def missing_is_a_value(spark, sf):
    """A feature that is NULL or NaN tells by being missing."""
    rows = _known(spark, sf).withColumn("gone", F.when(F.col("c") == "A", None).when(F.col("c") == "N", float("nan")).otherwise(3.0))
    rows = rows.withColumn("level", F.when(F.col("c") == "R", 4.0).otherwise(1.0))
    model = models.fit_regression(rows, ["gone"], "level", kind="rf", trees=10)
    return rounded(models.score(model, rows).select("key", "prediction"), {"prediction": 6})


@query
def model_round_trip(spark, sf):
    """A saved model replaces an older one and scores as before it was saved; ids and other columns stay."""
    rows = t.line_features(spark, sf)
    path = scratch_path(spark, "model")
    models.save_model(models.fit_regression(rows, NUMERIC, kind="rf", trees=2, depth=2), path)
    model = models.fit_regression(rows, NUMERIC, kind="rf", trees=10)
    models.save_model(model, path)
    before = models.score(model, rows).withColumnRenamed("prediction", "before")
    return models.score(models.load_model(path), before).select("key", "l_quantity", (F.col("prediction") == F.col("before")).alias("same"))


@query
def detect_levels(spark, sf):
    """Scores and their false discovery rate where the score of each row is known."""
    rows = _known(spark, sf)
    model = models.fit_regression(rows, [], "level", kind="rf", categorical=["c"], trees=10)
    return rounded(rescoring.detect(rows.drop("level"), model).select("key", "prediction", "adjusted"), {"prediction": 6, "adjusted": 6})


# --- files: written from the driver tables, read back -----------------------------


@query
def io_columns(spark, sf):
    path = scratch_path(spark, "columns")
    rows = t.table(spark, sf, "lineitem").select(composite_key(t.LINE_KEY), "l_quantity", "l_tax", "l_returnflag", "l_extendedprice")
    sink.write_table(rows, path)
    return delimited.read_columns(spark, path, index=[1], features=[3, 2], categorical=[4], label=5)


@query
def io_vectors(spark, sf):
    path = scratch_path(spark, "vectors")
    sink.write_table(t.table(spark, sf, "lineitem").select("l_quantity", "l_tax", "l_extendedprice"), path)
    rows = delimited.read_vectors(spark, path, features=[1, 2], label=3)
    f = vector_to_array("features")
    return rows.select(f[0].alias("f1"), f[1].alias("f2"), "label")


@query
def io_inferred(spark, sf):
    path = scratch_path(spark, "inferred")
    sink.write_table(t.table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice"), path, header=True)
    return delimited.read_inferred(spark, path).withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query
def io_matrix(spark, sf):
    path = scratch_path(spark, "matrix")
    sink.write_matrix(t.variant_matrix(spark, sf), t.SAMPLES, path)
    matrix = g.read_matrix(spark, path)
    return matrices.melt(matrix.rows, matrix.samples)


@query
def io_locations(spark, sf):
    snps, genes = scratch_path(spark, "snps"), scratch_path(spark, "genes")
    sink.write_table(t.event_points(spark, sf).select("snp", "chr", "pos"), snps, header=True)
    sink.write_table(t.user_regions(spark, sf), genes, header=True)
    points = g.read_snp_locations(spark, snps).select(F.col("snp").alias("id"), "chr", F.col("pos").alias("start"), F.col("pos").alias("end"))
    return points.unionByName(g.read_gene_locations(spark, genes).withColumnRenamed("gene", "id"))


@query
def io_results(spark, sf):
    path = scratch_path(spark, "results")
    sink.write_table(t.event_results(spark, sf), path, header=True, compression="gzip")
    return rounded(g.read_results(spark, path), {"beta": 6, "t_stat": 6, "p_value": 8, "fdr": 8})


@query
def io_beds(spark, sf):
    path = scratch_path(spark, "beds")
    sink.write_beds(_event_located(spark, sf), path, compression="gzip")
    cols = ["kind", "chr", "start", "end", "name", "snp", "gene"]
    stats = "beta double, t_stat double, p_value double, fdr double"
    out = g.read_bed(spark, f"{path}/pairs", f"snp string, gene string, {stats}").withColumns({"kind": F.lit("pair"), "name": F.lit(None).cast("string")})
    out = out.select(*cols)
    for kind in ("snp", "gene"):
        bed = g.read_bed(spark, f"{path}/{kind}s", f"name string, snp string, gene string, {stats}")
        out = out.unionByName(bed.withColumn("kind", F.lit(kind)).select(*cols))
    return out


@query
def io_truth(spark, sf):
    path = scratch_path(spark, "truth")
    rows = t.event_results(spark, sf).withColumnRenamed("snp", "SNP")
    sink.write_table(rows, path, header=True, compression="gzip")
    return rounded(g.read_truth(spark, path).drop("line"), {"raw_p": 8, "fdr": 8})


@query
def io_permutation_summary(spark, sf):
    path = scratch_path(spark, "summary")
    rows = t.table(spark, sf, "lineitem").select("l_returnflag", "l_partkey", "l_tax").orderBy("l_tax")
    key = F.concat(F.col("l_returnflag"), F.lit(":0-"), F.col("l_partkey").cast("string"))
    sink.write_table(rows.select(key.alias("key"), "l_tax"), path)
    return rounded(g.read_permutation_summary(spark, path), {"expected": 6})


@query
def io_sparse_contacts(spark, sf):
    path = scratch_path(spark, "sparse")
    rows = t.table(spark, sf, "lineitem").orderBy("l_extendedprice")
    key = F.concat_ws(":", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"))
    sink.write_table(rows.select(key.alias("key"), "l_extendedprice"), path)
    return g.read_sparse_contacts(spark, path, "A")


@query
def io_dense_contacts(spark, sf):
    path = scratch_path(spark, "dense")
    line = F.array_join(F.transform("values", lambda v: F.format_string("%.6f", v)), " ")
    t.vectors(spark, sf).orderBy("vec_id").select(line.alias("value")).write.text(path, compression="gzip")
    return g.read_dense_contacts(spark, path, "E")


@query
def io_bin_vector(spark, sf):
    path = scratch_path(spark, "vector")
    value = F.when(F.col("p_size") == 1, "NaN").otherwise(F.col("p_retailprice").cast("string"))
    t.table(spark, sf, "part").orderBy("p_partkey").select(value.alias("value")).write.text(path)
    return g.read_bin_vector(spark, path, "P")


@query
def io_triplets(spark, sf):
    path = scratch_path(spark, "triplets")
    rows = t.raw_contacts(spark, sf).groupBy("pos1", "pos2").agg(F.sum("count").cast("double").alias("count"))
    sink.write_table(rows, path)
    return g.read_contact_triplets(spark, path, "A")


@query
def io_signal(spark, sf):
    path = scratch_path(spark, "signal")
    sink.write_table(t.event_signal(spark, sf), path)
    return rounded(g.read_signal(spark, path), {"value": 6})


@query
def io_vcf(spark, sf):
    """A call file with meta and header lines; samples 2 to 3 of 3."""
    path = scratch_path(spark, "vcf")
    fixed = [F.col("chrom"), F.col("pos").cast("string"), *[F.lit(".")] * 4, F.col("filter"), F.lit("."), F.lit("GT")]
    body = t.calls(spark, sf).select(F.concat_ws("\t", *fixed, "samples").alias("value"))
    names = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "a", "b", "c"]
    head = spark.createDataFrame([("##fileformat=VCFv4.1",), ("\t".join(names),)], "value string")
    head.coalesce(1).unionByName(body).write.text(path)
    return _methylation_columns(methylation_matrix(g.read_vcf(spark, path, 2, 3).rows), 2)


@query
def io_scored(spark, sf):
    path = scratch_path(spark, "scored")
    sink.write_table(t.line_features(spark, sf).select("key", F.col("l_discount").alias("hic"), F.col("l_tax").alias("prediction")), path)
    return g.read_scored(spark, path, "key string, hic double, prediction double")


@query
def io_predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    rows = t.table(spark, sf, "lineitem").select("l_quantity", "l_tax", F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction"))
    rows = VectorAssembler(inputCols=["l_quantity", "l_tax"], outputCol="features").transform(rows)
    sink.write_predictions(rows, path)
    return g.read_scored(spark, path, "f0 double, f1 double, label double, prediction double")


@query
def io_fdr(spark, sf):
    path = scratch_path(spark, "fdr")
    sink.write_fdr(bh_adjust(t.line_pvalues(spark, sf).select("key", "p"), "p"), path, "p")
    return rounded(g.read_scored(spark, path, "key string, p double, fdr double"), {"p": 8, "fdr": 8})


@query
def io_by_chromosome(spark, sf):
    path = scratch_path(spark, "by-chr")
    sink.write_by_chromosome(t.event_points(spark, sf).select("snp", "chr", "pos"), path)
    return delimited.read_table(spark, path, "snp string, pos long, chr string", header=True).select("snp", "chr", "pos")


@query
def io_matrix_by_chromosome(spark, sf):
    path = scratch_path(spark, "matrix-by-chr")
    rows = matrices.by_chromosome(t.with_gaps(t.variant_matrix(spark, sf), 7), t.variant_locations(spark, sf), "snp")
    sink.write_matrix_by_chromosome(rows, t.SAMPLES, path)
    matrix = g.read_matrices_by_chromosome(spark, path)
    names = F.array(*map(F.lit, matrix.samples))
    return matrix.rows.select("chr", "id", F.posexplode("values").alias("i", "value")).select(
        "chr", "id", F.element_at(names, F.col("i") + 1).alias("sample"), "value"
    )


@query
def io_covariates(spark, sf):
    path = scratch_path(spark, "covariates")
    sink.write_matrix(t.three_covariates(spark, sf).coalesce(1), t.SAMPLES, path)
    cells = g.read_covariates(spark, path).select("line", "id", F.posexplode("values").alias("i", "value"))
    # The order of the file is that of its lines.
    place = F.dense_rank().over(Window.partitionBy("i").orderBy("line"))
    return rounded(cells.select("id", place.alias("place"), "i", "value"), {"value": 6})


@query
def io_contacts(spark, sf):
    path = scratch_path(spark, "contacts")
    sink.write_contacts(contacts.normalise_contacts(t.raw_contacts(spark, sf), t.norm_vector(spark, sf)), path)
    chroms = [r["chr"] for r in t.raw_contacts(spark, sf).select("chr").distinct().collect()]
    return rounded(g.read_contact_maps(spark, {c: f"{path}/chr={c}" for c in chroms}), {"value": 8})


@query
def io_cis_trans(spark, sf):
    path = scratch_path(spark, "cis-trans")
    both = association.cis_trans_association(*_located(spark, sf), distance=20_000, p_trans=0.001)
    sink.write_cis_trans(both.select("kind", "snp", "gene", "beta", "t_stat", "p_value", "fdr"), path)
    schema = "snp string, gene string, beta double, t_stat double, p_value double, fdr double, kind string"
    rows = delimited.read_table(spark, path, schema, header=True)
    return rounded(rows.select("kind", "snp", "gene", "beta", "t_stat", "p_value", "fdr"), {c: 6 for c in ("beta", "t_stat", "p_value", "fdr")})
