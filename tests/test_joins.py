"""Skew-safe joins and interval operators against direct definitions."""

import random

import pytest
from pyspark.sql import functions as F

from pairlift.operators.annotate import add_coordinates
from pairlift.operators.dedup import adjacent_distinct, first_per_key
from pairlift.operators.intervals import near_pairs, overlap_pairs, parse_region, signal_summary
from pairlift.operators.skew import _with_pieces, grid_join, hot_hashes, lookup_join, small_or_plain
from pairlift.workspace import stable, written


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 7 holds a third of the rows."""
    data = [(7 if i % 3 == 0 else i % 50, i) for i in range(3000)]
    return spark.createDataFrame(data, "k long, v int")


def test_hot_keys_are_found(spark, skewed):
    want = spark.createDataFrame([(7,)], "k long").select(F.xxhash64("k")).first()[0]
    assert want in hot_hashes(skewed, ["k"], check_bytes=0)
    assert hot_hashes(spark.range(10), ["id"]) == {}


def test_a_hot_key_gets_its_share_of_the_tasks(spark):
    """30 % of equal rows go to about 30 % of the tasks."""
    equal = spark.range(10_000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("k"), F.lit("same").alias("v"))
    equal = stable(equal)
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        hot = hot_hashes(equal, ["k"], check_bytes=0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert list(hot.values()) == [pytest.approx(30, abs=1)]
    sizes = [r["count"] for r in _with_pieces(equal.where("k = 1"), ["k"], hot, "_piece", copy=False).groupBy("_piece").count().collect()]
    assert len(sizes) == list(hot.values())[0] and max(sizes) < 2 * 3000 / len(sizes)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join(spark, rows, skewed, how):
    table = spark.createDataFrame([(k, f"n{k}") for k in range(0, 50, 2)] + [(7, "seven")], "k int, name string").dropDuplicates(["k"])
    hot = hot_hashes(skewed, ["k"], check_bytes=0)
    assert hot
    got = lookup_join(skewed, table, ["k"], how, hot=hot)
    assert rows(got, "k", "v", "name") == rows(skewed.join(table, "k", how), "k", "v", "name")


def test_lookup_join_null_safe(spark, rows):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "g string, v int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "g string, w int")
    assert rows(lookup_join(left, right, ["g"], null_safe=["g"], hot=[]), "v", "w") == [(1, 10), (2, 20)]


def test_grid_join(spark, rows, skewed):
    other = skewed.where("v < 300").select("k", F.col("v").alias("w"))
    hot = hot_hashes(skewed, ["k"], check_bytes=0)
    want = rows(skewed.join(other, "k"), "k", "v", "w")
    for left_hot, right_hot in ((hot, []), ([], hot), (hot, hot)):
        got = grid_join(skewed, other, ["k"], left_hot=left_hot, right_hot=right_hot)
        assert rows(got, "k", "v", "w") == want


def test_small_or_plain(spark, rows, skewed):
    assert rows(small_or_plain(skewed)) == rows(skewed)
    assert small_or_plain(skewed, max_rows=10) is skewed


def test_only_scans_are_read_twice(spark, skewed, tmp_path):
    skewed.write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    light = scan.where("v > 5").select("k")
    assert written(light) is light
    heavy = scan.groupBy("k").count()
    copy = written(heavy)
    assert copy is not heavy and "Aggregate" not in copy._jdf.queryExecution().optimizedPlan().toString()
    text = spark.read.text(str(tmp_path / "t"))
    assert written(text) is text


@pytest.fixture(scope="module")
def genome(spark):
    rng = random.Random(3)
    points = [(f"s{i}", rng.choice("ab"), 500 if i % 3 == 0 else rng.randrange(1, 5000)) for i in range(400)]
    regions = []
    for i in range(120):
        low = rng.randrange(0, 5000)
        regions.append((f"g{i}", rng.choice("ab"), low, low + rng.choice([1, 30, 700])))
    return points, regions


@pytest.mark.parametrize("distance, width", [(0, None), (100, None), (100, 37), (1000, 5000)])
@pytest.mark.parametrize("hot", [False, True])
def test_near_pairs(spark, genome, distance, width, hot):
    points, regions = genome
    p = spark.createDataFrame(points, "snp string, chr string, pos long")
    r = spark.createDataFrame(regions, "gene string, chr string, start long, end long")
    force = None
    if hot:
        w = width or max(distance, 5_000)
        keyed = p.withColumn("_bin", F.floor(F.col("pos") / w))
        force = hot_hashes(keyed, ["chr", "_bin"], check_bytes=0)
        assert force
    got = near_pairs(p, r, distance, bin_width=width, point_hot=force, region_hot=force)
    got = sorted((x["snp"], x["gene"]) for x in got.collect())
    want = sorted(
        (s, g) for s, c, x in points for g, d, lo, hi in regions if c == d and lo - distance <= x <= hi + distance
    )
    assert got == want


def test_few_regions_leave_points_and_results_in_place(spark, genome, monkeypatch, tmp_path):
    """Pairs with few regions, and their coordinates, come without a shuffle of points or pairs, and aren't written."""
    points, regions = genome
    folders = [str(tmp_path / name) for name in ("points", "regions")]
    spark.createDataFrame(points, "snp string, chr string, pos long").write.parquet(folders[0])
    spark.createDataFrame(regions, "gene string, chr string, start long, end long").write.parquet(folders[1])
    p, r = map(spark.read.parquet, folders)
    pairs = near_pairs(p, r, 100)
    assert "Exchange hashpartitioning" not in pairs._jdf.queryExecution().executedPlan().toString()
    results = pairs.selectExpr("snp", "gene", "pos / 10.0D p_value")
    assert written(results) is results
    located = add_coordinates(results, p, r)
    assert "Exchange hashpartitioning" not in located._jdf.queryExecution().executedPlan().toString()
    got = sorted((x["snp"], x["gene"], x["start"], x["end"], x["p_value"]) for x in located.collect())
    want = sorted(
        (s, g, x - 1 if x < lo else lo, x if x > hi else hi, x / 10)
        for s, c, x in points for g, d, lo, hi in regions if c == d and lo - 100 <= x <= hi + 100
    )
    assert got == want and got
    # Larger tables meet by shuffle, with the same rows.
    monkeypatch.setattr("pairlift.operators.skew.BROADCAST_ROWS", 10)
    assert "_bin" in str(near_pairs(p, r, 100)._jdf.queryExecution().optimizedPlan().toString())
    plain = add_coordinates(near_pairs(p, r, 100).selectExpr("snp", "gene", "pos / 10.0D p_value"), p, r)
    assert sorted((x["snp"], x["gene"], x["start"], x["end"], x["p_value"]) for x in plain.collect()) == want


def test_repeated_and_null_ids_keep_their_rows(spark, rows, monkeypatch):
    """A location that comes twice gives two rows and a null id none, broadcast or not."""
    results = spark.createDataFrame([("s1", "g1", 0.5), ("s1", "g2", 0.6), (None, "g1", 0.7), ("s2", None, 0.8)], "snp string, gene string, p_value double")
    snps = spark.createDataFrame([("s1", "a", 5), ("s1", "a", 9), (None, "a", 3), ("s2", None, 4)], "snp string, chr string, pos long")
    genes = spark.createDataFrame([("g1", "a", 1, 7), ("g2", None, 1, 7), (None, "a", 1, 7)], "gene string, chr string, start long, end long")
    want = [("s1", "g1", 1, 7), ("s1", "g1", 1, 9)]
    assert rows(add_coordinates(results, snps, genes), "snp", "gene", "start", "end") == want
    monkeypatch.setattr("pairlift.operators.skew.BROADCAST_ROWS", 0)
    assert rows(add_coordinates(results, snps, genes), "snp", "gene", "start", "end") == want


@pytest.mark.parametrize("width", [10, 250, 100_000])
def test_overlap_pairs(spark, genome, width):
    _, regions = genome
    a = spark.createDataFrame(regions, "gene string, chr string, start long, end long")
    b = a.select("chr", F.col("gene").alias("other"), F.col("start").alias("start2"), F.col("end").alias("end2"))
    got = sorted((x["gene"], x["other"], x["overlap"]) for x in overlap_pairs(a, b, bin_width=width).collect())
    want = sorted(
        (g, h, min(e, f) - max(s, t))
        for g, c, s, e in regions for h, d, t, f in regions
        if c == d and max(s, t) < min(e, f)
    )
    assert got == want


@pytest.mark.parametrize("width", [7, 100, 100_000])
def test_signal_summary(spark, genome, width):
    _, regions = genome
    rng = random.Random(8)
    signal, at = [], 0
    while at < 5600:
        at += rng.choice([0, 0, 3, 40, 300])
        size = rng.choice([1, 5, 60, 400])
        signal.append(("a", at, at + size, rng.random() * 9))
        at += size
    q = spark.createDataFrame(regions + regions[:5], "gene string, chr string, start long, end long")
    s = spark.createDataFrame(signal, "chr string, start long, end long, value double")
    got = signal_summary(q, s, bin_width=width).collect()
    assert len(got) == len(regions) + 5
    for row in got:
        hits = [
            (min(row["end"], e) - max(row["start"], b), v)
            for c, b, e, v in signal
            if c == row["chr"] and max(row["start"], b) < min(row["end"], e)
        ]
        covered, total = sum(n for n, _ in hits), sum(n * v for n, v in hits)
        assert row["covered"] == covered
        assert row["sum"] == pytest.approx(total, rel=1e-9, abs=1e-9)
        assert row["mean0"] == pytest.approx(total / row["size"], rel=1e-9, abs=1e-9)
        assert (row["mean"] is None) == (covered == 0)


def test_parse_region():
    assert parse_region("chr1") == ("chr1", None, None)
    assert parse_region("chr2:1,000-2000") == ("chr2", 1000, 2000)


@pytest.mark.parametrize("buckets", [1, 4, 50])
def test_adjacent_distinct_over_bucket_edges(spark, buckets):
    rng = random.Random(1)
    keys = [rng.choice("AB") for _ in range(500)] + ["C"] * 500
    df = spark.createDataFrame(list(enumerate(keys)), "line int, k string").repartition(6)
    got = sorted(r["line"] for r in adjacent_distinct(df, ["k"], ["line"], buckets=buckets).collect())
    assert got == [i for i, k in enumerate(keys) if i == 0 or keys[i - 1] != k]


def test_adjacent_distinct_takes_any_keys_in_one_exchange(spark, monkeypatch):
    """Null equals null and NaN equals NaN, lists compare, single rows and empty tables pass; the rows are shuffled once."""
    import math

    from pairlift.operators import dedup

    rng = random.Random(4)
    pool = [(None, 1.0, [1]), ("a", None, [1]), ("a", math.nan, None), ("a", math.nan, [1, 2]), ("b", 0.0, [1])]
    keys = [rng.choice(pool) for _ in range(400)]
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "line int, k string, x double, l array<int>").repartition(5)
    same = lambda a, b: repr(a) == repr(b)
    plans = []
    real = dedup.stable
    monkeypatch.setattr(dedup, "stable", lambda d, label: plans.append(d._jdf.queryExecution().executedPlan().toString()) or real(d, label))
    for cols in (["k"], ["x"], ["l"], ["k", "x", "l"]):
        at = [("k", "x", "l").index(c) for c in cols]
        got = sorted(r["line"] for r in adjacent_distinct(df, cols, ["line"], buckets=7).collect())
        assert got == [i for i, k in enumerate(keys) if i == 0 or not same([k[j] for j in at], [keys[i - 1][j] for j in at])]
    assert all(p.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in p for p in plans)
    assert adjacent_distinct(df.where("line = 3"), ["k"], ["line"]).count() == 1
    assert adjacent_distinct(df.where("line < 0"), ["k"], ["line"]).count() == 0


def test_first_per_key_does_not_depend_on_layout(spark, rows):
    rng = random.Random(2)
    data = [(rng.randrange(4) if i % 3 else 9, rng.random(), i) for i in range(2000)]
    df = spark.createDataFrame(data, "k int, p double, i int")
    a = rows(first_per_key(df.repartition(1), ["k"], ["p"]))
    b = rows(first_per_key(df.repartition(13, "i"), ["k"], ["p"]))
    best = {}
    for k, p, i in data:
        best[k] = min(best.get(k, (p, i)), (p, i))
    assert a == b == sorted((k, p, i) for k, (p, i) in best.items())


def test_overlapping_signal_stops(spark):
    queries = spark.createDataFrame([("c", 0, 45)], "chr string, start long, end long")
    schema = "chr string, start long, end long, value double"
    with pytest.raises(Exception, match="signal intervals overlap"):
        signal_summary(queries, spark.createDataFrame([("c", 0, 50, 1.0), ("c", 20, 40, 2.0)], schema)).collect()
    touching = spark.createDataFrame([("c", 0, 20, 1.0), ("c", 20, 40, 2.0)], schema)
    assert signal_summary(queries, touching).first()["covered"] == 40


def test_no_contact_map_is_no_zero(spark, rows):
    from pairlift.operators.contacts import contact_lookup

    spans = spark.createDataFrame([("c1", 0, 9000), ("c2", 0, 9000)], "chr string, start long, end long")
    contacts = spark.createDataFrame([("c1", 5, 9, 1.0)], "chr string, bin1 long, bin2 long, value double")
    assert rows(contact_lookup(spans, contacts, mapped=["c1"]), "chr", "hic") == [("c1", 0.0), ("c2", None)]
