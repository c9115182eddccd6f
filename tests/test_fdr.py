import numpy as np
import pytest

from pairlift.operators.fdr import bh_adjust, quantile_edges


def numpy_bh(p, n=None):
    p = np.asarray(p, dtype=float)
    n = n or len(p)
    order = np.argsort(p, kind="stable")
    raw = n * p[order] / np.arange(1, len(p) + 1)
    q = np.minimum(1.0, np.minimum.accumulate(raw[::-1])[::-1])
    out = np.empty_like(q)
    out[order] = q
    return out


@pytest.fixture(scope="module")
def tied():
    """A third of the p-values equal, the rest with many small ties."""
    rng = np.random.default_rng(5)
    p = np.round(rng.beta(0.4, 1.2, 6000), 4)
    p[:2000] = 0.25
    return np.maximum(p, 1e-6)


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_matches_numpy(spark, tied, buckets):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(tied)], "i int, p double").repartition(5)
    got = {r["i"]: r["fdr"] for r in bh_adjust(df, "p", buckets=buckets).collect()}
    want = numpy_bh(tied)
    assert len(got) == len(tied)
    assert np.allclose([got[i] for i in range(len(tied))], want, rtol=1e-14)


def test_rows_move_with_one_copy_of_their_p(spark, monkeypatch):
    """The p-value itself is the key of the q-values; zeros of both signs get the same one and stay as they are, hot or not."""
    p = [0.0, -0.0] * 400 + [0.5, 0.75]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double").repartition(3)
    want = numpy_bh(p)
    for check_bytes in (1 << 30, 0):
        monkeypatch.setattr("pairlift.operators.skew.SKEW_CHECK_BYTES", check_bytes)
        out = bh_adjust(df, "p")
        got = {r["i"]: (r["p"], r["fdr"]) for r in out.collect()}
        assert len(got) == len(p)
        assert all(str(got[i][0]) == str(v) and got[i][1] == pytest.approx(want[i]) for i, v in enumerate(p))
    join = out._jdf.queryExecution().optimizedPlan().toString()
    assert "AS _p#" not in join


def test_edges_cut_evenly(spark):
    """Buckets hold like counts though the values are crowded, huge, negative, zero or infinite."""
    rng = np.random.default_rng(9)
    p = np.concatenate([rng.uniform(0.7, 0.7001, 4000), 10.0 ** -rng.uniform(0, 300, 2000), -rng.exponential(5, 1000), np.zeros(5), [1e308, np.inf, -np.inf]])
    df = spark.createDataFrame([(float(v),) for v in p], "_p double").repartition(3)
    for buckets in (1, 10, 64):
        edges = quantile_edges(df, "_p", buckets)
        assert edges == sorted(edges) and set(edges) <= set(p)
        sizes = np.diff(np.searchsorted(np.sort(p), [-np.inf, *edges, np.inf], side="left"))
        assert len(edges) < 3 * buckets and sizes.max() <= 1.3 * len(p) / buckets + 1
    assert quantile_edges(df.limit(0), "_p", 8) == []


def test_groups_and_given_n(spark, tied):
    rows = [(i, "abc"[i % 3] if i % 7 else None, float(v)) for i, v in enumerate(tied)]
    df = spark.createDataFrame(rows, "i int, g string, p double")
    got = {r["i"]: r["fdr"] for r in bh_adjust(df, "p", by=["g"]).collect()}
    for g in ("a", "b", "c", None):
        idx = [i for i, gg, _ in rows if gg == g]
        assert np.allclose([got[i] for i in idx], numpy_bh(tied[idx]), rtol=1e-14)
    got = {r["i"]: r["fdr"] for r in bh_adjust(df, "p", n_tests=50_000).collect()}
    assert np.allclose([got[i] for i in range(len(tied))], numpy_bh(tied, 50_000), rtol=1e-14)


def test_log_space(spark, tied):
    v = -np.log10(tied)
    v[5] = 400.0
    v[6] = -0.5
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double")
    got = {r["i"]: r["q"] for r in bh_adjust(df, "v", log10=True, out="q").collect()}
    want = numpy_bh(10.0 ** -v)
    assert np.allclose([got[i] for i in range(len(v))], want, rtol=1e-10)


def test_properties(spark, tied):
    df = spark.createDataFrame([(float(v),) for v in tied], "p double")
    out = bh_adjust(df, "p", alpha=0.1, digits=6).orderBy("p").toPandas()
    assert out["fdr"].is_monotonic_increasing
    assert (out["fdr"] >= out["p"] - 1e-6).all()
    assert (out.groupby("p")["fdr"].nunique() == 1).all()
    assert (out["significant"] == (out["fdr"] <= 0.1)).all()


def test_nulls_are_no_tests_and_empty_is_empty(spark):
    df = spark.createDataFrame([(1, 0.02), (2, None), (3, float("nan"))], "i int, p double")
    assert [tuple(r) for r in bh_adjust(df, "p").collect()] == [(1, 0.02, 0.02)]
    assert bh_adjust(df.where("i > 9"), "p").count() == 0


def test_rows_are_scanned_once_and_never_in_one_task(spark, tmp_path):
    """The result reads the rows in one scan beside the narrow table of steps, and no window runs over them."""
    spark.range(1000).selectExpr("id / 1000 AS p", "repeat('x', 200) AS wide").write.parquet(f"{tmp_path}/t")
    plan = bh_adjust(spark.read.parquet(f"{tmp_path}/t"), "p")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    assert sum("wide" in line and "Scan parquet" in line for line in plan.split("\n")) == 1
