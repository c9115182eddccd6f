"""Readers and writers on small files."""

import gzip

import pytest
from pyspark.sql import functions as F

from pairlift.operators.matrices import keep_located, pick_samples, take_samples
from pairlift.plans import jobs
from pairlift.sinks import tables as sink
from pairlift.sources import delimited, genomics as g
from pairlift.sources.lines import numbered_lines


def put(path, text):
    path.write_text(text)
    return str(path)


def lines(path):
    return sorted(line for f in path.rglob("part-*") for line in f.read_text().splitlines())


def test_numbered_lines_span_splits(spark, tmp_path):
    text = "".join(f"line {i}\n" for i in range(5000))
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.txt", text)
    put(tmp_path / "in" / "b.txt", "last\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = numbered_lines(spark, str(tmp_path / "in")).orderBy("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["line"] for r in got] == list(range(5001))
    assert [r["value"] for r in got] == [f"line {i}" for i in range(5000)] + ["last"]


def test_columns_by_position(spark, rows, tmp_path):
    path = put(tmp_path / "t.txt", "k1;; 1.5;x;2\nk2;; 2.5;y;3\n")
    table = delimited.read_columns(spark, path, index=[1], features=[2], categorical=[3], label=4, sep=";+")
    assert table.columns == ["I1", "C2", "C3", "label"]
    assert rows(table) == [("k1", 1.5, "x", 2.0), ("k2", 2.5, "y", 3.0)]
    text = delimited.read_columns(spark, path, features=[2, 2], label=3, text_label=True, sep=";+")
    assert rows(text) == [(1.5, "x"), (2.5, "y")]


def test_bad_number_stops(spark, tmp_path):
    path = put(tmp_path / "t.txt", "1\tNA\t3\t4\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        delimited.read_columns(spark, path, label=4).collect()
    assert delimited.read_columns(spark, path, label=4, null_value="NA").first()["C2"] is None


def test_column_rules():
    assert delimited.check_columns(None, 4) == ([1, 2, 3], [])
    assert delimited.check_columns([3, 1, 3], 2) == ([1, 3], [])
    for features, label in (([1, 2], 2), ([1], 0), ([0], None)):
        with pytest.raises(ValueError):
            delimited.check_columns(features, label)


def test_matrix_and_samples(spark, rows, tmp_path):
    path = put(tmp_path / "m.tab", "id\tp1\tp2\tp3\nr1\t1\tNA\t3\nr2\t4\t5\t6\n")
    matrix = g.read_matrix(spark, path)
    assert matrix.samples == ["p1", "p2", "p3"]
    assert rows(matrix.rows) == [("r1", [1.0, None, 3.0]), ("r2", [4.0, 5.0, 6.0])]
    chosen = pick_samples(matrix.samples, 2, seed=1)
    assert len(chosen) == 2 and chosen == sorted(chosen) == pick_samples(matrix.samples, 2, seed=1)
    assert pick_samples(matrix.samples) == [0, 1, 2]
    assert rows(take_samples(matrix.rows, [0, 2])) == [("r1", [1.0, 3.0]), ("r2", [4.0, 6.0])]
    where = spark.createDataFrame([("r2",)], "snp string")
    assert rows(keep_located(matrix.rows, where, "snp"), "id") == [("r2",)]
    assert g.read_covariates(spark, None) is None
    sink.write_matrix(matrix.rows, matrix.samples, str(tmp_path / "out"))
    assert rows(g.read_matrix(spark, str(tmp_path / "out")).rows) == rows(matrix.rows)


def test_contact_files(spark, rows, tmp_path):
    sparse = put(tmp_path / "s.txt", "0:3\t1.5\n2:9\t4\n0:3\t7.5\n")
    assert rows(g.read_sparse_contacts(spark, sparse, "c")) == [("c", 0, 3, 7.5), ("c", 2, 9, 4.0)]
    dense = tmp_path / "d.gz"
    with gzip.open(dense, "wt") as f:
        f.write("0 1.5 0\n2 NaN -1\n")
    assert rows(g.read_dense_contacts(spark, str(dense), "c")) == [("c", 0, 1, 1.5), ("c", 1, 0, 2.0)]
    vector = put(tmp_path / "v.txt", "1.5\nNaN\n2.5\n")
    assert rows(g.read_bin_vector(spark, vector, "c")) == [("c", 1, 1.5), ("c", 3, 2.5)]
    raw = put(tmp_path / "r.txt", "0\t2000\t15\n")
    assert rows(g.read_contact_triplets(spark, raw, "c")) == [("c", 0, 2000, 15.0)]
    jobs.contact_job(spark, raw, vector, str(tmp_path / "out"), "c")
    assert lines(tmp_path / "out") == ["0:2\t4.0"]


def test_location_result_and_bed_files(spark, rows, tmp_path):
    snps = put(tmp_path / "s.txt", "id\tchr\tpos\ns-1\tchr1\t5\n")
    genes = put(tmp_path / "g.txt", "id\tchr\ts\te\ng1\tchr1\t5\t9\n")
    assert rows(g.read_snp_locations(spark, snps)) == [("s-1", "chr1", 5)]
    assert rows(g.read_gene_locations(spark, genes)) == [("g1", "chr1", 5, 9)]
    result = put(tmp_path / "r.txt", "SNP\tgene\tbeta\tt-stat\tp-value\tFDR\ns1\tg1\t1\t2\t0.5\t1\n")
    assert rows(g.read_results(spark, result)) == [("s1", "g1", 1.0, 2.0, 0.5, 1.0)]
    bed = put(tmp_path / "b.bed", "#head\nchr1\t1\t2\tn\n")
    assert rows(g.read_bed(spark, bed, "name string")) == [("chr1", 1, 2, "n")]
    signal = put(tmp_path / "x.bg", "chr1\t0\t9\t1.5\n")
    assert rows(g.read_signal(spark, signal)) == [("chr1", 0, 9, 1.5)]


def test_truth_and_summary_files(spark, rows, tmp_path):
    truth = put(tmp_path / "t.txt", "SNP\tgene\tb\tt\tp\tq\ns1\tg1\t1\t1\t0.1\t0.2\ns1\tg1\t1\t1\t0.3\t0.4\n")
    assert rows(g.read_truth(spark, truth)) == [("s1-g1", 0.1, 0.2, 1), ("s1-g1", 0.3, 0.4, 2)]
    summary = put(tmp_path / "p.txt", "chr1:0-10\t2\nchr1:0-10\t3\nchr2:0-5\tNA\n")
    assert rows(g.read_permutation_summary(spark, summary)) == [("chr1", 10, 3.0), ("chr2", 5, None)]
    df = spark.createDataFrame([("chr1", 0, 10, 6.0), ("chr2", 0, 5, 1.0), ("chr3", 0, 5, 1.0)], "chr string, start long, end long, o double")
    jobs.ratio_job(spark, df, summary, str(tmp_path / "oe"), "o")
    assert lines(tmp_path / "oe") == ["1.0\tNA\tNA\tNA", "6.0\t3.0\t2.0\t3.0"]


VCF = """##meta
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc
chr1\t10\t.\tC\tT\t.\tPASS\t.\tGT\t0/1:30:CG:10:x\t./.\t0/0:1:CG:2:x
chr1\t11\t.\tC\tT\t.\tLowQ\t.\tGT\t0/1:1:CG:1:x\t./.\t./.
"""


def test_vcf(spark, rows, tmp_path):
    path = put(tmp_path / "in.vcf", VCF)
    calls = g.read_vcf(spark, path, 2, 3)
    assert calls.samples == ["b", "c"]
    assert rows(calls.rows, "pos", "filter", "samples")[0] == (10, "PASS", ["./.", "0/0:1:CG:2:x"])
    jobs.methylation_job(spark, path, str(tmp_path / "out"))
    # Every part file carries the header.
    assert set(lines(tmp_path / "out")) == {"cg:chr1-10\t0.75\tNA\t0.33333", "id\ta\tb\tc"}
    assert rows(g.read_matrix(spark, str(tmp_path / "out")).rows) == [("cg:chr1-10", [0.75, None, 0.33333])]


def test_fdr_job(spark, tmp_path):
    path = put(tmp_path / "p.txt", "a\tx\t0.01\nb\ty\t0.04\nc\tz\t0.03\nd\tw\t0.005\n")
    jobs.fdr_job(spark, path, str(tmp_path / "out"), key_cols=[1, 2], p_col=3)
    assert lines(tmp_path / "out") == ["a-x\t0.01\t0.02", "b-y\t0.04\t0.04", "c-z\t0.03\t0.04", "d-w\t0.005\t0.02"]
    ordered = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    assert [line.split("\t")[1] for line in ordered] == ["0.04", "0.03", "0.01", "0.005"]
    jobs.fdr_job(spark, put(tmp_path / "v.txt", "a\t2\n"), str(tmp_path / "out"), log10=True)
    assert lines(tmp_path / "out") == ["a\t2.0\t0.01"]


def test_downsample_job(spark, tmp_path):
    snps = put(tmp_path / "s.tab", "id\tp1\tp2\tp3\nr1\t1\t2\t3\n")
    genes = put(tmp_path / "g.tab", "id\tp3\tp2\tp1\nr1\t30\t20\t10\n")
    names = jobs.downsample_job(spark, snps, genes, str(tmp_path / "out"), size=2, seed=3)
    a = g.read_matrix(spark, str(tmp_path / "out" / "snps"))
    b = g.read_matrix(spark, str(tmp_path / "out" / "genes"))
    assert a.samples == b.samples == names and len(names) == 2
    assert [10 * v for v in a.rows.first()["values"]] == b.rows.first()["values"]


def test_null_is_na_and_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(None, 1.0), ("x", None)], "a string, b double")
    for _ in range(2):
        sink.write_table(df, str(tmp_path / "o"))
    assert lines(tmp_path / "o") == ["NA\t1.0", "x\tNA"]


def test_compressed_tables_are_read_like_plain_ones(spark, rows, tmp_path):
    """Results, truth lines and BED views as gzip: the same rows, in fewer bytes."""
    data = [("r%d" % i, "g%d" % (i % 3), i / 7, None if i % 5 == 0 else 0.5, 0.25, 0.5) for i in range(300)]
    results = spark.createDataFrame(data, "snp string, gene string, beta double, t_stat double, p_value double, fdr double")
    folders = {c: str(tmp_path / str(c)) for c in (None, "gzip")}
    for c, path in folders.items():
        sink.write_table(results, f"{path}/results", header=True, compression=c)
        sink.write_table(results.withColumnRenamed("snp", "SNP"), f"{path}/truth", header=True, compression=c)
        located = results.selectExpr("'c' chr", "1L start", "9L end", "*", "5L snp_pos", "1L gene_start", "9L gene_end")
        sink.write_beds(located, f"{path}/beds", compression=c)
    plain, packed = folders.values()
    assert rows(g.read_results(spark, f"{packed}/results")) == rows(g.read_results(spark, f"{plain}/results")) == rows(results)
    truths = [rows(g.read_truth(spark, f"{path}/truth").drop("line")) for path in (plain, packed)]
    assert truths[0] == truths[1] and len(truths[0]) == 300
    payload = "snp string, gene string, beta double, t_stat double, p_value double, fdr double"
    for view in ("pairs", "snps", "genes"):
        columns = payload if view == "pairs" else f"name string, {payload}"
        beds = [rows(g.read_bed(spark, f"{path}/beds/{view}", columns)) for path in (plain, packed)]
        assert beds[0] == beds[1] and len(beds[0]) == 300
    size = lambda path: sum(f.stat().st_size for f in (tmp_path / path).rglob("part-*"))
    assert size("gzip") < size("None") / 2


def test_partitioned_writers(spark, rows, tmp_path):
    df = spark.createDataFrame([("a", "cis", 1.0), ("b", "trans", 2.0)], "snp string, kind string, beta double")
    sink.write_cis_trans(df, str(tmp_path / "ct"))
    assert {p.name for p in (tmp_path / "ct").iterdir() if p.is_dir()} == {"kind=cis", "kind=trans"}
    sink.write_by_chromosome(df.withColumnRenamed("kind", "chr"), str(tmp_path / "bc"))
    read = delimited.read_table(spark, str(tmp_path / "bc"), "snp string, beta double, chr string", header=True)
    picked = read.where(F.col("chr") == "cis")
    assert rows(picked, "snp") == [("a",)]
    assert "PartitionFilters: [isnotnull(chr" in picked._jdf.queryExecution().executedPlan().toString()


def test_matrix_of_any_width(spark, rows, tmp_path):
    n = 21_000
    path = put(tmp_path / "wide", "\t".join(["id", *map(str, range(n))]) + "\n" + "\t".join(["r", "NA", *["1.5"] * (n - 1)]) + "\n")
    matrix = g.read_matrix(spark, path)
    assert len(matrix.samples) == n
    sink.write_matrix(matrix.rows, matrix.samples, str(tmp_path / "again"))
    again = g.read_matrix(spark, str(tmp_path / "again"))
    assert again.samples == matrix.samples
    assert again.rows.collect()[0]["values"] == [None, *[1.5] * (n - 1)]
    short = put(tmp_path / "short", "id\ta\tb\nr\t1\n")
    with pytest.raises(Exception, match="not 3 cells"):
        g.read_matrix(spark, short).rows.collect()
