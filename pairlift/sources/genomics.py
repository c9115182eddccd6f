"""Scans of the matrix, location, result, interval, contact, signal and call files."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairlift.functions.scalars import composite_key, number_or_null
from pairlift.sources.delimited import read_table
from pairlift.sources.lines import numbered_lines


class Matrix(NamedTuple):
    """Rows (id, values) and the sample names in order."""

    rows: DataFrame
    samples: list[str]


def read_matrix(spark: SparkSession, path: str, sep: str = "\t") -> Matrix:
    """Wide table of any width: a header, an id column, one column per sample; NA or nothing is missing.

    Every part file begins with the header. A bad cell or a row of another length stops the job.
    """
    head = _header(spark, path)
    names = head.split(sep)
    return Matrix(_matrix_rows(spark.read.text(path), head, len(names), sep).select("id", "values"), names[1:])


def read_matrices_by_chromosome(spark: SparkSession, path: str, sep: str = "\t") -> Matrix:
    """The matrices of all chromosomes below ``path`` (folders chr=...) as rows (id, values, chr); they share one header."""
    lines = spark.read.schema("value string, chr string").text(path)
    head = lines.where(F.col("value") != "").select("value").first()
    if head is None:
        raise ValueError(f"no header in {path}")
    names = head["value"].split(sep)
    return Matrix(_matrix_rows(lines, head["value"], len(names), sep).select("id", "values", "chr"), names[1:])


def _header(spark: SparkSession, path: str) -> str:
    first = spark.read.text(path).where(F.col("value") != "").first()
    if first is None:
        raise ValueError(f"no header in {path}")
    return first["value"]


def _matrix_rows(lines: DataFrame, head: str, width: int, sep: str) -> DataFrame:
    """``lines`` but headers, with the cells as ``id`` and one array, so that the width is no number of columns."""
    cells = F.split("value", re.escape(sep), -1)
    number = lambda c: F.when(~c.isin("", "NA"), c.cast("double"))
    bad = F.raise_error(F.concat(F.lit(f"a matrix row has not {width} cells: "), F.substring("value", 1, 40)))
    skipped = F.col("value").isin("", head)
    values = F.when(F.size(cells) == width, F.transform(F.slice(cells, 2, width - 1), number)).otherwise(bad)
    # A later filter may be evaluated before this one, so skipped lines are not parsed either.
    return lines.where(~skipped).withColumns({"id": F.element_at(cells, 1), "values": F.when(~skipped, values)})


def read_covariates(spark: SparkSession, path: str | None, sep: str = "\t") -> DataFrame | None:
    """Covariate rows (line, id, values), ``line`` being their order in the file; none for an intercept-only model."""
    if path is None:
        return None
    head = _header(spark, path)
    return _matrix_rows(numbered_lines(spark, path), head, len(head.split(sep)), sep).select("line", "id", "values")


def read_snp_locations(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    return read_table(spark, path, "snp string, chr string, pos long", header=header)


def read_gene_locations(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    return read_table(spark, path, "gene string, chr string, start long, end long", header=header)


def read_results(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """An association result made earlier; stands in for the regression stage."""
    schema = "snp string, gene string, beta double, t_stat double, p_value double, fdr double"
    return read_table(spark, path, schema, header=header)


def read_bed(spark: SparkSession, path: str, payload: str = "") -> DataFrame:
    """Intervals with optional payload columns; lines that begin with # are skipped."""
    schema = "chr string, start long, end long" + (f", {payload}" if payload else "")
    return read_table(spark, path, schema, comment="#")


def read_truth(
    spark: SparkSession, path: str, *, key_cols: Sequence[int] = (1, 2), p_col: int = 5, fdr_col: int = 6
) -> DataFrame:
    """(key, raw_p, fdr, line): every ground-truth row but header rows, with its line number."""
    lines = numbered_lines(spark, path).withColumn("_c", F.split("value", "\t"))
    cell = lambda n: F.element_at("_c", n)
    return lines.where(cell(1) != "SNP").select(
        composite_key([cell(n) for n in key_cols]).alias("key"),
        cell(p_col).cast("double").alias("raw_p"),
        cell(fdr_col).cast("double").alias("fdr"),
        "line",
    )


def read_permutation_summary(spark: SparkSession, path: str) -> DataFrame:
    """(chr, len, expected) from keys ``chr:0-len``; the last row of a key counts."""
    cells = F.split("value", "\t")
    span = F.split(F.element_at(cells, 1), ":0-")
    return (
        numbered_lines(spark, path)
        .select(
            span[0].alias("chr"),
            span[1].cast("long").alias("len"),
            number_or_null(F.element_at(cells, 2)).alias("expected"),
            "line",
        )
        .groupBy("chr", "len")
        .agg(F.max_by(F.struct("expected"), "line").alias("_v"))
        .select("chr", "len", "_v.expected")
    )


def read_sparse_contacts(spark: SparkSession, path: str, chrom: str) -> DataFrame:
    """(chr, bin1, bin2, value) from lines ``bin1:bin2<TAB>value``; the last line of a key counts."""
    cells = F.split("value", "\t")
    bins = F.split(cells[0], ":")
    return (
        numbered_lines(spark, path)
        .select(bins[0].cast("long").alias("bin1"), bins[1].cast("long").alias("bin2"), cells[1].cast("double").alias("v"), "line")
        .groupBy("bin1", "bin2")
        .agg(F.max_by("v", "line").alias("value"))
        .select(F.lit(chrom).alias("chr"), "bin1", "bin2", "value")
    )


def read_contact_maps(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """The sparse contact files of several chromosomes as one table."""
    if not paths:
        raise ValueError("give the contact file of one chromosome at least")
    return reduce(DataFrame.unionByName, [read_sparse_contacts(spark, path, chrom) for chrom, path in paths.items()])


def read_dense_contacts(spark: SparkSession, path: str, chrom: str) -> DataFrame:
    """(chr, bin1, bin2, value) of the positive cells of a whitespace matrix, plain or gzip."""
    rows = numbered_lines(spark, path).select("line", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("bin2", "cell"))
    return rows.select(
        F.lit(chrom).alias("chr"),
        F.col("line").alias("bin1"),
        F.col("bin2").cast("long").alias("bin2"),
        number_or_null(F.col("cell")).alias("value"),
    ).where(F.col("value") > 0)


def read_bin_vector(spark: SparkSession, path: str, chrom: str) -> DataFrame:
    """(chr, idx, value): one number per line, idx is the line number from 1, NaN lines are left out."""
    return (
        numbered_lines(spark, path)
        .select(F.lit(chrom).alias("chr"), (F.col("line") + 1).alias("idx"), number_or_null(F.trim("value")).alias("value"))
        .where(F.col("value").isNotNull())
    )


def read_contact_triplets(spark: SparkSession, path: str, chrom: str) -> DataFrame:
    """(chr, pos1, pos2, count)."""
    raw = read_table(spark, path, "pos1 long, pos2 long, count double")
    return raw.select(F.lit(chrom).alias("chr"), "*")


def read_signal(spark: SparkSession, path: str) -> DataFrame:
    """Genome signal as (chr, start, end, value) intervals, half-open and without overlaps."""
    return read_table(spark, path, "chr string, start long, end long, value double", comment="#")


class Calls(NamedTuple):
    """Variant calls (chrom, pos, filter, samples) and the sample names in order."""

    rows: DataFrame
    samples: list[str]


def read_vcf(spark: SparkSession, path: str, first_sample: int | None = None, last_sample: int | None = None) -> Calls:
    """Calls with the chosen samples, counted from 1; all of them by default."""
    lines = spark.read.text(path)
    header = lines.where(F.col("value").startswith("#CHROM")).first()
    if header is None:
        raise ValueError("no #CHROM header line")
    names = header["value"].split("\t")[9:]
    low = first_sample or 1
    high = last_sample or len(names)
    cells = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(
        cells[0].alias("chrom"),
        cells[1].cast("long").alias("pos"),
        cells[6].alias("filter"),
        F.slice(cells, 9 + low, high - low + 1).alias("samples"),
    )
    return Calls(rows, names[low - 1 : high])


def read_scored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_table(spark, path, schema)
