"""Small cases with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from pairlift.functions.scalars import fixed_decimals, from_neg_log10, neg_log10
from pairlift.functions.tdist import two_sided
from pairlift.operators.annotate import add_coordinates, gene_bed, snp_bed
from pairlift.operators.contacts import contact_lookup, normalise_contacts
from pairlift.operators.dedup import adjacent_distinct, first_per_key
from pairlift.operators.fdr import bh_adjust
from pairlift.operators.intervals import attach_signal, signal_summary
from pairlift.operators.methylation import methylation_matrix
from pairlift.operators.ratios import observed_expected


def test_bh(spark, rows):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.005)], "k int, p double")
    assert rows(bh_adjust(df, "p"), "k", "fdr") == [(1, 0.02), (2, 0.04), (3, 0.04), (4, 0.02)]


def test_bh_cap(spark, rows):
    df = spark.createDataFrame([(1, 0.9), (2, 0.95), (3, 1.0)], "k int, p double")
    assert [q for _, q in rows(bh_adjust(df, "p"), "k", "fdr")] == [1.0, 1.0, 1.0]


@pytest.mark.parametrize(
    "snp, low, high, want",
    [(100, 200, 201, (99, 201)), (300, 200, 201, (200, 300)), (250, 200, 400, (200, 400)), (200, 200, 400, (200, 400))],
)
def test_pair_span(spark, rows, snp, low, high, want):
    results = spark.createDataFrame([("s", "g", 0.5)], "snp string, gene string, p_value double")
    snps = spark.createDataFrame([("s", "chr1", snp)], "snp string, chr string, pos long")
    genes = spark.createDataFrame([("g", "chr1", low, high)], "gene string, chr string, start long, end long")
    located = add_coordinates(results, snps, genes)
    assert rows(located, "start", "end") == [want]
    assert rows(snp_bed(located), "start", "end", "name") == [(snp - 1, snp, f"chr1:{want[0]}-{want[1]}")]
    assert rows(gene_bed(located), "start", "end") == [(low, high)]


def test_cross_chromosome_pair_drops(spark):
    results = spark.createDataFrame([("s", "g", 0.5)], "snp string, gene string, p_value double")
    snps = spark.createDataFrame([("s", "chr1", 1)], "snp string, chr string, pos long")
    genes = spark.createDataFrame([("g", "chr2", 1, 2)], "gene string, chr string, start long, end long")
    assert add_coordinates(results, snps, genes).count() == 0


def test_first_per_key(spark, rows):
    df = spark.createDataFrame(
        [("chr1", 1, 5, "a"), ("chr1", 1, 5, "b"), ("chr1", 2, 5, "c")], "chr string, start int, end int, name string"
    )
    assert rows(first_per_key(df), "name") == [("a",), ("c",)]


def test_adjacent_distinct(spark, rows):
    df = spark.createDataFrame(list(enumerate("AABA")), "line int, k string")
    assert rows(adjacent_distinct(df, ["k"], ["line"], buckets=3)) == [(0, "A"), (2, "B"), (3, "A")]


def test_contact_lookup(spark, rows):
    spans = spark.createDataFrame(
        [("chr1", 99, 201), ("chr1", 500, 3500), ("chr1", 500, 5500)], "chr string, start long, end long"
    )
    contacts = spark.createDataFrame([("chr1", 0, 3, 7.5)], "chr string, bin1 long, bin2 long, value double")
    assert rows(contact_lookup(spans, contacts), "start", "end", "hic") == [
        (99, 201, None), (500, 3500, 7.5), (500, 5500, 0.0),
    ]


def test_contact_normalisation(spark, rows):
    raw = spark.createDataFrame(
        [("chr1", 0, 2000, 16.0), ("chr1", 0, 1000, 5.0), ("chr1", 500, 2000, 5.0)], "chr string, pos1 long, pos2 long, count double"
    )
    norm = spark.createDataFrame([("chr1", 1, 2.0), ("chr1", 3, 4.0)], "chr string, idx long, value double")
    expected = spark.createDataFrame([("chr1", 3, 0.5)], "chr string, idx long, value double")
    assert rows(normalise_contacts(raw, norm)) == [("chr1", 0, 2, 2.0)]
    assert rows(normalise_contacts(raw, norm, expected=expected)) == [("chr1", 0, 2, 4.0)]


def test_signal(spark, rows):
    signal = spark.createDataFrame([("c", 0, 10, 1.0), ("c", 10, 20, 3.0)], "chr string, start long, end long, value double")
    queries = spark.createDataFrame([("c", 5, 15), ("c", 15, 25), ("c", 30, 40)], "chr string, start long, end long")
    got = rows(signal_summary(queries, signal), "start", "size", "covered", "sum", "mean0", "mean")
    assert got == [(5, 10, 10, 20.0, 2.0, 2.0), (15, 10, 5, 15.0, 1.5, 3.0), (30, 10, 0, 0.0, 0.0, None)]
    assert rows(attach_signal(queries, signal), "start", "recomb") == [(5, 2.0), (15, 3.0), (30, None)]
    assert rows(attach_signal(queries, signal, min_data=6, na_as=-9.0), "start", "recomb") == [(5, 2.0), (15, -9.0), (30, -9.0)]


def test_observed_expected(spark, rows):
    df = spark.createDataFrame([("a", 0, 1, 4.0), ("a", 0, 2, 4.0), ("a", 0, 3, None), ("a", 0, 9, 1.0)], "chr string, start long, end long, o double")
    summary = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 0.0), ("a", 3, 2.0)], "chr string, len long, expected double")
    got = rows(observed_expected(df, summary, "o"), "end", "ratio", "difference")
    assert got == [(1, 2.0, 2.0), (2, 100.0, 4.0), (3, None, None)]


def test_methylation(spark):
    calls = spark.createDataFrame(
        [("chr1", 7, "PASS", ["0/1:30:CG:10:x", "./.", "0/0:0:CG:0:x", "1/1:23:CH:297:y"]), ("chr1", 8, "LOW", ["x"] * 4)],
        "chrom string, pos long, filter string, samples array<string>",
    )
    (row,) = methylation_matrix(calls).collect()
    assert row["id"] == "cg:chr1-7"
    assert row["values"] == [0.75, None, None, float("%.5f" % (23 / 320))]
    assert methylation_matrix(calls, "CG").first()["values"] == [0.75, None, None, None]


def test_fixed_decimals_follow_printf(spark):
    values = [i / 320 for i in range(1, 320)] + [i / 64 for i in range(64)] + [2.675, 1e-9, 123456.789012345]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for v, got in df.select("v", fixed_decimals(F.col("v"), 5)).collect():
        assert got == float("%.5f" % v)


def test_log_round_trip(spark):
    row = spark.range(1).select(from_neg_log10(F.lit(2.0)).alias("p"), neg_log10(F.lit(0.01)).alias("v"), neg_log10(F.lit(0.0)).alias("z")).first()
    assert abs(row["p"] - 0.01) < 1e-15 and abs(row["v"] - 2) < 1e-15
    assert 320 < row["z"] < 330


def test_t_tail_closed_forms():
    import numpy as np

    t = np.array([0.0, 0.1, 1.0, 2.99, 3.01, 10.0, 1e4])
    assert np.allclose(two_sided(t, 1.0)[0], 1 - 2 / np.pi * np.arctan(t), rtol=1e-10, atol=1e-14)
    exact = 2 / ((2 + t * t) + t * np.sqrt(2 + t * t))
    p, nl = two_sided(t, 2.0)
    assert np.allclose(p, exact, rtol=1e-13)
    assert np.allclose(nl, -np.log10(exact), rtol=1e-12, atol=1e-14)
    p, nl = two_sided(np.array([5000.0]), 1000.0)
    assert p[0] == 0.0 and 2100 < nl[0] < 2300
