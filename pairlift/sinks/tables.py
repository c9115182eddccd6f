"""Writers: tab text with NA for NULL. A result is a directory of part files and replaces an older one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from pairlift.operators.annotate import gene_bed, pair_bed, snp_bed
from pairlift.workspace import written


def write_table(
    df: DataFrame, path: str, *, header: bool = False, partition_by: Sequence[str] = (), compression: str | None = None
) -> None:
    """Plain text, or with ``compression="gzip"`` part files that all readers here take as well, at a fraction of the disk."""
    df.write.mode("overwrite").partitionBy(*partition_by).csv(
        path, sep="\t", header=header, nullValue="NA", emptyValue="", compression=compression
    )


def write_beds(located: DataFrame, path: str, *, compression: str | None = None) -> None:
    """Pair spans, SNP points and gene intervals below ``path``."""
    located = written(located, "located")
    for name, view in (("pairs", pair_bed), ("snps", snp_bed), ("genes", gene_bed)):
        write_table(view(located), f"{path}/{name}", compression=compression)


def write_fdr(df: DataFrame, path: str, p_col: str = "p_value", *, key: str = "key", fdr: str = "fdr", log10: bool = False, ordered: bool = True) -> None:
    """key, p (or -log10 p), fdr with the largest p first; the sort is range partitioned."""
    table = df.select(key, p_col, fdr)
    if ordered:
        table = table.orderBy(F.asc(p_col) if log10 else F.desc(p_col), F.desc(key))
    write_table(table, path)


def _vector_size(df: DataFrame, features: str) -> int:
    """Size of a vector column: from its ML attributes, else from a row; 0 if the table has neither."""
    known = df.schema[features].metadata.get("ml_attr", {}).get("num_attrs")
    if known is not None:
        return int(known)
    row = df.select(vector_to_array(features).alias("f")).first()
    return len(row["f"]) if row else 0


def write_predictions(
    df: DataFrame, path: str, features: str = "features", label: str = "label", prediction: str = "prediction", size: int | None = None
) -> None:
    """Features, label and prediction, one value per column; ``size``: how many features, if the column doesn't say so."""
    size = _vector_size(df, features) if size is None else size
    cells = vector_to_array(features)
    wide = [cells[i].alias(f"f{i}") for i in range(size)]
    write_table(df.select(*wide, *[F.col(c) for c in (label, prediction) if c in df.columns]), path)


def write_by_chromosome(df: DataFrame, path: str) -> None:
    """One subdirectory per chromosome, so a reader of one chromosome skips the others."""
    write_table(df, path, header=True, partition_by=["chr"])


def write_matrix(rows: DataFrame, samples: Sequence[str], path: str) -> None:
    """(id, values) back to a header and one cell per sample, whatever their number.

    The row is one text column named by the header line, as columns are limited in number.
    """
    _write_lines(rows.select(_matrix_line(samples)), path)


def write_matrix_by_chromosome(rows: DataFrame, samples: Sequence[str], path: str) -> None:
    """(id, values, chr) as a matrix per chromosome; every part file begins with the header."""
    _write_lines(rows.select(_matrix_line(samples), "chr"), path, "chr")


def _matrix_line(samples: Sequence[str]) -> Column:
    cells = F.transform("values", lambda v: F.coalesce(v.cast("string"), F.lit("NA")))
    line = F.concat_ws("\t", F.coalesce(F.col("id").cast("string"), F.lit("NA")), cells)
    return line.alias("\t".join(["id", *samples]))


def _write_lines(lines: DataFrame, path: str, *by: str) -> None:
    lines.write.mode("overwrite").partitionBy(*by).csv(
        path, sep="\x01", quote="", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_contacts(contacts: DataFrame, path: str) -> None:
    """``bin1:bin2<TAB>value`` lines, one subdirectory per chromosome."""
    key = F.concat_ws(":", F.col("bin1").cast("string"), F.col("bin2").cast("string"))
    write_table(contacts.select("chr", key.alias("key"), "value"), path, partition_by=["chr"])


def write_cis_trans(results: DataFrame, path: str) -> None:
    """Cis and trans results in their own subdirectories."""
    write_table(results, path, header=True, partition_by=["kind"])
