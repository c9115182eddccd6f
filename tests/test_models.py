import numpy as np
import pytest

from pairlift.operators import models, quality, sampling


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    out = []
    for i in range(1200):
        a, b = rng.random(), rng.random()
        c = rng.choice(["u", "v", "w"])
        y = 3 * (a > 0.5) + (2 if c == "v" else 0) + (5 if i % 4 == 0 else b) + 0.05 * rng.normal()
        out.append((f"k{i}", float(a), None if i % 4 == 0 else float(b), c, float(y)))
    df = spark.createDataFrame(out, "key string, a double, b double, c string, label double").repartition(4)
    return sampling.with_validation(df, ["key"]).cache()


def r2(df):
    return quality.regression_metrics(df).first()["r2"]


@pytest.mark.parametrize("kind", ["gbt", "rf"])
def test_regression_learns_missing_and_categories(spark, data, kind):
    model = models.fit_regression(
        data, ["a", "b"], categorical=["c"], kind=kind, trees=20, depth=4, step=0.3,
        validation_col="is_validation" if kind == "gbt" else None,
    )
    scored = models.score(model, data.drop("label"))
    assert scored.columns == ["key", "a", "b", "c", "is_validation", "prediction"]
    assert scored.count() == data.count()
    assert r2(models.score(model, data.where("is_validation"))) > 0.9
    importance = {r["feature"]: r["importance"] for r in models.feature_importance(model, spark).collect()}
    assert set(importance) == {"a__v", "a__na", "b__v", "b__na", "c__i"}
    assert sum(importance.values()) == pytest.approx(1.0) and importance["a__na"] == 0.0


def test_unseen_category_is_scored(spark, data):
    model = models.fit_regression(data, ["a"], categorical=["c"], kind="rf", trees=3)
    new = spark.createDataFrame([(0.2, "new")], "a double, c string")
    assert models.score(model, new).first()["prediction"] is not None


def test_save_and_load(spark, data, tmp_path, rows):
    model = models.fit_regression(data, ["a", "b"], kind="rf", trees=3)
    for _ in range(2):
        models.save_model(model, str(tmp_path / "m"))
    again = models.load_model(str(tmp_path / "m"))
    assert rows(models.score(again, data), "key", "prediction") == rows(models.score(model, data), "key", "prediction")


def test_cross_validation_keeps_the_best_fold(data):
    folds = sampling.with_fold(data.drop("is_validation"), ["key"], k=3)
    model, metrics, summary = models.cross_validate(folds, ["a", "b"], k=3, kind="rf", trees=5)
    per_fold = {r["fold"]: r for r in metrics.collect()}
    assert set(per_fold) == {0, 1, 2} and sum(r["n"] for r in per_fold.values()) == data.count()
    best = max(per_fold.values(), key=lambda r: r["r2"])
    assert summary.first()["best_r2"] == best["r2"] and summary.first()["best_mse"] == best["mse"]
    held = folds.where(f"fold = {best['fold']}")
    assert r2(models.score(model, held)) == pytest.approx(best["r2"])


def test_classifiers(data):
    from pyspark.sql import functions as F

    two = data.withColumn("y", F.when(F.col("a") > 0.5, "hi").otherwise("lo"))
    model = models.fit_classifier(two, ["a", "b"], "y", trees=3, kind="gbt")
    assert models.score(model, two).where("prediction <> y").count() < 20
    three = data.withColumn("y", F.when(F.col("a") > 0.7, "hi").when(F.col("a") > 0.3, "mid").otherwise("lo"))
    model = models.fit_classifier(three, ["a", "b"], "y", trees=10)
    assert models.score(model, three.drop("y")).select("prediction").distinct().count() == 3
    assert models.score(model, three).where("prediction <> y").count() < 60


def test_metrics_match_formulas(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(1e6, 1, 500)
    f = y + rng.normal(0, 0.5, 500)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, f)], "label double, prediction double")
    m = quality.regression_metrics(df).first()
    mse = np.mean((y - f) ** 2)
    assert m["mse"] == pytest.approx(mse) and m["rmse"] == pytest.approx(mse**0.5)
    assert m["r2"] == pytest.approx(1 - mse / np.var(y))
    assert m["explained_variance"] == pytest.approx(np.mean((f - y.mean()) ** 2))


def test_splits_depend_on_the_key_only(spark, rows):
    df = spark.range(2000).selectExpr("cast(id as string) key")
    a = rows(sampling.with_fold(df.repartition(1), ["key"]))
    assert a == rows(sampling.with_fold(df.repartition(9), ["key"]))
    sizes = np.bincount([f for _, f in a])
    assert len(sizes) == 10 and sizes.min() > 150
    share = sampling.with_validation(df, ["key"]).where("is_validation").count()
    assert 150 < share < 250


def test_balanced_sample(spark):
    df = spark.range(4000).selectExpr("cast(id as string) key", "if(id % 4 = 0, 1, 0) class")
    got = sampling.balanced_sample(df, {1: 1000, 0: 3000}, ["key"], targets={1: 5000, 0: 300})
    n = {r["class"]: r["count"] for r in got.groupBy("class").count().collect()}
    assert n[1] == 1000 and 230 < n[0] < 370


def test_counters(spark, tmp_path):
    df, seen = quality.counted(spark.range(17).toDF("id"), "seen")
    df.write.parquet(str(tmp_path / "x"))
    assert seen.get == {"rows": 17}


@pytest.mark.parametrize("kind", ["gbt", "rf"])
def test_trees_do_not_depend_on_the_layout(spark, data, kind, rows):
    """One partition or eight, planned small or large: the same trees."""
    how = dict(kind=kind, categorical=["c"], trees=6, depth=4, step=0.3, validation_col="is_validation" if kind == "gbt" else None)
    one, many = (models.fit_regression(data.repartition(n), ["a", "b"], **how) for n in (1, 8))
    assert one.stages[-1].toDebugString.split("\n")[1:] == many.stages[-1].toDebugString.split("\n")[1:]
    two = data.selectExpr("*", "if(a > 0.4, 'x', 'y') y")
    one, many = (models.fit_classifier(two.repartition(n), ["a", "b"], "y", trees=4, kind=kind) for n in (1, 8))
    assert rows(models.score(one, two), "key", "prediction") == rows(models.score(many, two), "key", "prediction")


@pytest.mark.parametrize("kind", ["gbt", "rf"])
def test_concurrent_folds_equal_folds_one_by_one(data, kind, rows):
    folds = sampling.with_fold(data.drop("is_validation"), ["key"], k=4)
    how = dict(k=4, kind=kind, categorical=["c"], trees=5, depth=3, step=0.3)
    one, metrics, summary = models.cross_validate(folds, ["a", "b"], concurrent=1, **how)
    two, again, _ = models.cross_validate(folds.repartition(7), ["a", "b"], concurrent=4, **how)
    got, want = ({r["fold"]: (r["n"], r["mse"], r["r2"]) for r in m.collect()} for m in (again, metrics))
    assert got.keys() == want.keys() and all(got[f] == pytest.approx(want[f], rel=1e-9) for f in want)
    assert rows(models.score(one, data), "key", "prediction") == rows(models.score(two, data), "key", "prediction")
    assert summary.first()["best_r2"] == max(v[2] for v in want.values())


def test_few_rows_a_leaf(data):
    deep = models.fit_regression(data, ["a"], kind="rf", trees=1, depth=8, min_rows=1)
    flat = models.fit_regression(data, ["a"], kind="rf", trees=1, depth=8, min_rows=300)
    assert flat.stages[-1].totalNumNodes < deep.stages[-1].totalNumNodes
