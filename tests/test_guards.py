"""Cases at the edge of a rule: values just above a bound, NaN, empty tables, folders that are not shared."""

import math
import os

import pytest

from pairlift import workspace
from pairlift.operators import models
from pairlift.operators.fdr import bh_adjust
from pairlift.operators.quality import pvalue_histogram
from pairlift.sinks.tables import write_predictions


def test_flag_is_set_before_rounding(spark):
    df = spark.createDataFrame([("a", 0.50004)], "key string, p_value double")
    row = bh_adjust(df, "p_value", digits=4, alpha=0.5).first()
    assert row["fdr"] == 0.5 and not row["significant"]


def test_histogram_leaves_nan_out(spark):
    df = spark.createDataFrame([(0.5,), (math.nan,), (None,), (0.01,)], "p_value double")
    assert sum(r["n"] for r in pvalue_histogram(df).collect()) == 2


def test_empty_predictions(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1.0, 2.0], 1.0, 2.0)], "f array<double>, label double, prediction double")
    df = df.select(array_to_vector(F.col("f")).alias("features"), "label", "prediction")
    write_predictions(df.limit(0), f"{tmp_path}/none", size=2)
    write_predictions(df.limit(0), f"{tmp_path}/unknown")
    write_predictions(df, f"{tmp_path}/one")
    assert os.path.isdir(f"{tmp_path}/none") and os.path.isdir(f"{tmp_path}/one")


def test_classifier_kind_is_chosen_not_guessed(spark):
    rows = [(float(i), "abc"[i % 3], "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, three string, two string")
    names = lambda m: [type(s).__name__ for s in m.stages]
    assert any("RandomForest" in n for n in names(models.fit_classifier(df, ["x"], "two", trees=2)))
    assert any("GBT" in n for n in names(models.fit_classifier(df, ["x"], "two", trees=2, kind="gbt")))
    with pytest.raises(ValueError):
        models.fit_classifier(df, ["x"], "three", trees=2, kind="gbt")
    with pytest.raises(ValueError):
        models.fit_classifier(df, ["x"], "three", trees=2, max_classes=2)


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.shared_dir(session)


def test_workspace_can_be_dropped(spark):
    table = workspace.stable(spark.range(3), "short-lived")
    path = table.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    assert workspace.drop_workspace(spark) and not os.path.exists(path)
