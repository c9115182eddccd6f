"""File-to-file jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairlift.functions.scalars import composite_key
from pairlift.operators.contacts import contact_lookup, normalise_contacts
from pairlift.operators.fdr import bh_adjust
from pairlift.operators.intervals import attach_signal, in_region, parse_region
from pairlift.operators.matrices import by_chromosome, pick_samples, take_samples
from pairlift.operators.methylation import methylation_matrix
from pairlift.operators.models import load_model, save_model
from pairlift.operators.ratios import observed_expected
from pairlift.plans.downsample import downsample_association
from pairlift.plans.rescoring import associate_region, complete_features, detect, pair_features, pair_spans, train, training_set
from pairlift.plans.stages import Stages
from pairlift.sinks.tables import write_by_chromosome, write_contacts, write_fdr, write_matrix, write_matrix_by_chromosome, write_table
from pairlift.sources import genomics as g

# Beyond this, names of chromosomes are no chromosomes.
MAX_CHROMOSOMES = 100_000


def fdr_job(
    spark: SparkSession, source: str, target: str, *, key_cols: Sequence[int] = (1,), p_col: int = 2,
    sep: str = r"\t", log10: bool = False,
) -> None:
    """Adjust the p-values of a text table."""
    cells = F.split("value", sep)
    rows = spark.read.text(source).select(
        composite_key([F.element_at(cells, n) for n in key_cols]).alias("key"),
        F.element_at(cells, p_col).cast("double").alias("p"),
    )
    write_fdr(bh_adjust(rows, "p", log10=log10), target, "p", log10=log10)


def contact_job(
    spark: SparkSession, raw: str, norm: str, target: str, chrom: str, *, resolution: int = 1000, expected: str | None = None
) -> None:
    """Normalise one chromosome's contact counts."""
    table = normalise_contacts(
        g.read_contact_triplets(spark, raw, chrom),
        g.read_bin_vector(spark, norm, chrom),
        resolution=resolution,
        expected=g.read_bin_vector(spark, expected, chrom) if expected else None,
    )
    write_contacts(table, target)


def methylation_job(
    spark: SparkSession, vcf: str, target: str, *, context: str = r"\w+", first_sample: int | None = None, last_sample: int | None = None
) -> None:
    """Methylation matrix of a call file."""
    calls = g.read_vcf(spark, vcf, first_sample, last_sample)
    write_matrix(methylation_matrix(calls.rows, context), calls.samples, target)


def ratio_job(spark: SparkSession, intervals: DataFrame, summary: str, target: str, observed: str) -> None:
    """Observed over permuted signal."""
    table = observed_expected(intervals, g.read_permutation_summary(spark, summary), observed)
    write_table(table.select("observed", "expected", "ratio", "difference"), target)


def downsample_job(
    spark: SparkSession, snps: str, genes: str, target: str, *, size: int | None = None, covariates: str | None = None, seed: int = 2015
) -> list[str]:
    """The same sample subset of every matrix; returns the chosen names."""
    first = g.read_matrix(spark, snps)
    positions = pick_samples(first.samples, size, seed)
    chosen = [first.samples[i] for i in positions]
    for name, path in (("snps", snps), ("genes", genes), ("covariates", covariates)):
        if path:
            matrix = g.read_matrix(spark, path)
            own = [matrix.samples.index(s) for s in chosen]
            write_matrix(take_samples(matrix.rows, own), chosen, f"{target}/{name}")
    return chosen


def downsample_association_job(
    spark: SparkSession,
    target: str,
    *,
    snps: str,
    genes: str,
    snp_loc: str,
    gene_loc: str,
    sizes: Sequence[int | None],
    seeds: Sequence[int] = (2015,),
    covariates: str | None = None,
    chroms: Sequence[str] | None = None,
    distance: int = 1_000_000,
    p_cis: float = 1.0,
    p_trans: float = 1e-80,
) -> None:
    """Cis and trans associations of several draws of the samples, a folder per draw and kind."""
    table = downsample_association(
        g.read_matrix(spark, snps), g.read_matrix(spark, genes), g.read_snp_locations(spark, snp_loc), g.read_gene_locations(spark, gene_loc),
        g.read_covariates(spark, covariates), sizes=sizes, seeds=seeds, chroms=chroms, distance=distance, p_cis=p_cis, p_trans=p_trans,
    )
    write_table(table.drop("neg_log10_p"), target, header=True, partition_by=["subset", "kind"])


def split_job(
    spark: SparkSession, target: str, *, snps: str, genes: str, snp_loc: str, gene_loc: str, covariates: str | None = None,
    size: int | None = None, seed: int = 2015,
) -> None:
    """Matrices, locations and covariates by chromosome, of all samples or of ``size`` of them: the inputs of one run per chromosome."""
    variants, traits = g.read_matrix(spark, snps), g.read_matrix(spark, genes)
    positions = pick_samples(variants.samples, size, seed)
    chosen = [variants.samples[i] for i in positions]
    snp_places, gene_places = g.read_snp_locations(spark, snp_loc), g.read_gene_locations(spark, gene_loc)
    for name, matrix, places, key in (("snps", variants, snp_places, "snp"), ("genes", traits, gene_places, "gene")):
        own = take_samples(matrix.rows, [matrix.samples.index(s) for s in chosen])
        write_matrix_by_chromosome(by_chromosome(own, places, key), chosen, f"{target}/{name}")
        write_by_chromosome(places, f"{target}/{key}_loc")
    if covariates:
        rows = g.read_covariates(spark, covariates)
        # As many rows as a model has covariates, once for each chromosome.
        chroms = [r["chr"] for r in snp_places.select("chr").unionByName(gene_places.select("chr")).distinct().limit(MAX_CHROMOSOMES + 1).collect()]
        if len(chroms) > MAX_CHROMOSOMES:
            raise ValueError(f"more than {MAX_CHROMOSOMES} chromosomes")
        each = take_samples(rows, positions).select("id", "values", F.explode(F.array(*map(F.lit, chroms))).alias("chr"))
        write_matrix_by_chromosome(each, chosen, f"{target}/covariates")


def _features(
    spark: SparkSession,
    *,
    snps: str | None,
    genes: str | None,
    snp_loc: str | None,
    gene_loc: str | None,
    contacts: str | Mapping[str, str] | None,
    signal: str | None,
    covariates: str | None,
    results: str | None,
    features: str | None,
    region: str | None,
    distance: int,
    kb: int,
    features_to: str | None,
    stages: Stages,
) -> DataFrame:
    """Feature rows, from the latest stage that is given: ``features``, a kept stage, ``results``, or the matrices."""
    if features:
        return spark.read.parquet(features)
    given = stages.given
    spans_given = "spans" in given or {"contacts", "signal"} <= given and "features" in given
    if not ((snp_loc and gene_loc) or spans_given) or not (contacts or "contacts" in given) or not (signal or "signal" in given):
        raise ValueError("give locations, contacts and signal, or features made earlier")
    if isinstance(contacts, str):
        if not region:
            raise ValueError("one contact file is of one chromosome: name it in region, or give a file per chromosome")
        contacts = {region.partition(":")[0]: contacts}
    if contacts is None:
        contacts = {}

    def found() -> DataFrame:
        where_snps, where_genes = g.read_snp_locations(spark, snp_loc), g.read_gene_locations(spark, gene_loc)
        if results:
            rows = g.read_results(spark, results)
            if region:
                chrom, low, high = parse_region(region)
                rows = rows.join(in_region(where_snps, chrom, low, high).select("snp"), "snp", "left_semi")
                rows = rows.join(in_region(where_genes, chrom).select("gene"), "gene", "left_semi")
            return rows
        if not snps or not genes:
            raise ValueError("give both matrices or an existing result")
        return associate_region(
            g.read_matrix(spark, snps).rows, g.read_matrix(spark, genes).rows, where_snps, where_genes,
            g.read_covariates(spark, covariates), region=region, distance=distance,
        ).drop("neg_log10_p")

    def spans() -> DataFrame:
        return pair_spans(stages.table("associations"), g.read_snp_locations(spark, snp_loc), g.read_gene_locations(spark, gene_loc))

    span = ["chr", "start", "end"]

    def with_contacts() -> DataFrame:
        rows = stages.table("spans")
        return contact_lookup(rows.select(*span), g.read_contact_maps(spark, contacts), kb=kb, mapped=list(contacts))

    def with_signal() -> DataFrame:
        return attach_signal(stages.table("spans").select(*span), g.read_signal(spark, signal))

    def joined() -> DataFrame:
        # Spans are unique, so no key can be hot.
        return complete_features(stages.table("spans").join(stages.table("contacts"), span).join(stages.table("signal"), span))

    places = {"snp_loc": snp_loc, "gene_loc": gene_loc}
    start = {"results": results} if results else {"snps": snps, "genes": genes, **({"covariates": covariates} if covariates else {})}
    stages.add("associations", found, sources={**start, **places}, params={"region": region, "distance": distance})
    stages.add("spans", spans, sources=places, after=["associations"])
    stages.add("contacts", with_contacts, sources={"contacts": list(contacts.values()) or None}, params={"kb": kb, "mapped": sorted(contacts)} if contacts else {"kb": kb}, after=["spans"])
    stages.add("signal", with_signal, sources={"signal": signal}, after=["spans"])
    stages.add("features", joined, after=["spans", "contacts", "signal"])
    if stages.folder:
        table = stages.table("features")
    else:
        table = pair_features(
            found(), g.read_snp_locations(spark, snp_loc), g.read_gene_locations(spark, gene_loc),
            g.read_contact_maps(spark, contacts), g.read_signal(spark, signal), kb=kb, mapped=list(contacts),
        )
    if not features_to:
        return table
    table.write.mode("overwrite").parquet(features_to)
    return spark.read.parquet(features_to)


def detect_job(
    spark: SparkSession,
    target: str,
    *,
    model: str,
    snps: str | None = None,
    genes: str | None = None,
    snp_loc: str | None = None,
    gene_loc: str | None = None,
    contacts: str | Mapping[str, str] | None = None,
    signal: str | None = None,
    covariates: str | None = None,
    results: str | None = None,
    features: str | None = None,
    features_to: str | None = None,
    region: str | None = "chr1",
    distance: int = 1_000_000,
    kb: int = 1,
    stages: str | None = None,
    given: Sequence[str] = (),
) -> None:
    """From matrices, an existing result or existing features to re-scored, adjusted pairs.

    ``contacts`` is the file of the region's chromosome or a file per chromosome; pairs on
    a chromosome without one have no contact value (NULL, not 0). ``region`` limits an
    existing result as well; None takes all chromosomes. ``features_to`` keeps the features
    as Parquet for a later run with ``features``; those are taken whole.

    ``stages`` is a folder that keeps the stages ``associations``, ``spans``, ``contacts``,
    ``signal`` and ``features``: a later run takes those whose files, parameters and
    predecessors are unchanged. Stages named in ``given`` are taken without being made; files
    that only they need can be left out, and a stale one stops the job.
    """
    kept = Stages(spark, stages, given)
    table = _features(
        spark, snps=snps, genes=genes, snp_loc=snp_loc, gene_loc=gene_loc, contacts=contacts, signal=signal, covariates=covariates,
        results=results, features=features, region=region, distance=distance, kb=kb, features_to=features_to, stages=kept,
    )
    write_fdr(detect(table, load_model(model)), target, "prediction", fdr="adjusted", log10=True)


def train_job(
    spark: SparkSession,
    target: str,
    *,
    truth: str | None = None,
    snps: str | None = None,
    genes: str | None = None,
    snp_loc: str | None = None,
    gene_loc: str | None = None,
    contacts: str | Mapping[str, str] | None = None,
    signal: str | None = None,
    covariates: str | None = None,
    results: str | None = None,
    features: str | None = None,
    features_to: str | None = None,
    region: str | None = "chr1",
    distance: int = 1_000_000,
    kb: int = 1,
    stages: str | None = None,
    given: Sequence[str] = (),
    key_cols: Sequence[int] = (1, 2),
    p_col: int = 5,
    fdr_col: int = 6,
    threshold: float = 0.01,
    positives: int = 10_000,
    negatives: int = 10_000,
    k: int = 10,
    seed: int = 12345,
    **settings,
) -> None:
    """Train from files: ``target`` gets ``model``, ``importance``, ``validation`` and, for k > 1, ``folds``.

    The stages before are given as for detect_job, with ``truth`` as one more; ``settings``
    go to the boosted trees.
    """
    kept = Stages(spark, stages, given)
    table = _features(
        spark, snps=snps, genes=genes, snp_loc=snp_loc, gene_loc=gene_loc, contacts=contacts, signal=signal, covariates=covariates,
        results=results, features=features, region=region, distance=distance, kb=kb, features_to=features_to, stages=kept,
    )
    columns = {"key_cols": list(key_cols), "p_col": p_col, "fdr_col": fdr_col}
    kept.add("truth", lambda: g.read_truth(spark, truth, **columns), sources={"truth": truth}, params=columns)
    if truth is None and "truth" not in kept.given:
        raise ValueError("give the truth, or name it as a given stage")
    rows = training_set(table, kept.table("truth"), threshold=threshold, positives=positives, negatives=negatives, seed=seed)
    trained = train(rows, k=k, seed=seed, **settings)
    save_model(trained.model, f"{target}/model")
    write_table(trained.importance, f"{target}/importance", header=True)
    write_table(trained.validation, f"{target}/validation", header=True)
    if trained.cross_validation is not None:
        write_table(trained.cross_validation, f"{target}/folds", header=True)
