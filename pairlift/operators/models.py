"""Tree models on Spark ML: training, cross-validation, scoring, persistence.

Training rows are laid out by their own content into a fixed number of partitions before a
fit, so the same rows, seed and settings give the same trees whatever the size of the input,
its splits, or the number of cores.
"""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairlift.operators.quality import fold_summary, regression_metrics
from pairlift.workspace import shared_dir, stable

# Stands in for a missing feature value; features are non-negative, so it splits off cleanly.
MISSING = -1.0
MAX_CLASSES = 1000
# Partitions of training rows: a setting of the model, not of the cluster. Raise it with the rows.
PARTITIONS = 16
# Folds that are fitted at the same time.
CONCURRENT_FITS = 4


def laid_out(df: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """Rows dealt by the hash of all columns and sorted by them: a layout that follows from the rows alone."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    return df.repartition(partitions, F.xxhash64(*columns)).sortWithinPartitions(*columns)


def _feature_stages(features: Sequence[str], categorical: Sequence[str]) -> list:
    """Missing values become a flag and a constant (trees reject NaN); text becomes category codes."""
    parts = []
    for f in features:
        parts.append(f"CASE WHEN `{f}` IS NULL OR isnan(`{f}`) THEN {MISSING}D ELSE double(`{f}`) END AS `{f}__v`")
        parts.append(f"CASE WHEN `{f}` IS NULL OR isnan(`{f}`) THEN 1D ELSE 0D END AS `{f}__na`")
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")] if parts else []
    stages += [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep") for c in categorical]
    inputs = [f"{f}{end}" for f in features for end in ("__v", "__na")] + [f"{c}__i" for c in categorical]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


def _tree_settings(trees: int, depth: int, bins: int, seed: int, memory_mb: int, min_rows: int) -> dict:
    return dict(
        maxDepth=depth, maxBins=bins, seed=seed, maxMemoryInMB=memory_mb, minInstancesPerNode=min_rows,
        checkpointInterval=10, featuresCol="features",
    )


def _regressor(
    kind: str, label: str, validation_col: str | None, *, trees: int = 100, depth: int = 5, bins: int = 100, step: float = 0.1,
    seed: int = 12345, memory_mb: int = 256, min_rows: int = 10,
):
    shared = _tree_settings(trees, depth, bins, seed, memory_mb, min_rows)
    if kind == "gbt":
        model = GBTRegressor(labelCol=label, maxIter=trees, stepSize=step, **shared)
        return model.setValidationIndicatorCol(validation_col) if validation_col else model
    if kind == "rf":
        return RandomForestRegressor(labelCol=label, numTrees=trees, featureSubsetStrategy="auto", **shared)
    raise ValueError(f"unknown model kind {kind!r}")


def fit_regression(
    train: DataFrame,
    features: Sequence[str],
    label: str = "label",
    *,
    kind: str = "gbt",
    categorical: Sequence[str] = (),
    validation_col: str | None = None,
    partitions: int = PARTITIONS,
    **settings,
) -> PipelineModel:
    """Boosted trees (``gbt``) or a random forest (``rf``) as one pipeline.

    With ``validation_col`` boosting stops once the flagged rows no longer improve. Further
    settings, with their defaults: trees=100, depth=5, bins=100, step=0.1, seed=12345,
    memory_mb=256, and min_rows=10, the fewest rows of a leaf.
    """
    shared_dir(train.sparkSession)
    model = _regressor(kind, label, validation_col if kind == "gbt" else None, **settings)
    used = [c for c in (*features, *categorical, label, validation_col) if c]
    return Pipeline(stages=[*_feature_stages(features, categorical), model]).fit(laid_out(train.select(*dict.fromkeys(used)), partitions))


def _without_summaries(model: PipelineModel) -> PipelineModel:
    """Training summaries hold the session, which tasks that score would have to serialise."""
    for stage in model.stages:
        if getattr(stage, "hasSummary", False):
            stage._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


def fit_classifier(
    train: DataFrame,
    features: Sequence[str],
    label: str = "label",
    *,
    categorical: Sequence[str] = (),
    trees: int = 100,
    depth: int = 5,
    bins: int = 100,
    step: float = 0.1,
    seed: int = 12345,
    memory_mb: int = 256,
    kind: str = "rf",
    max_classes: int = MAX_CLASSES,
    min_rows: int = 10,
    partitions: int = PARTITIONS,
) -> PipelineModel:
    """Text labels: an entropy forest (``rf``) for any number of classes up to ``max_classes``, boosted trees (``gbt``) for two."""
    shared_dir(train.sparkSession)
    if kind not in ("rf", "gbt"):
        raise ValueError(f"unknown model kind {kind!r}")
    most = 2 if kind == "gbt" else max_classes
    if train.select(label).dropna().distinct().limit(most + 1).count() > most:
        raise ValueError(f"{kind} takes at most {most} classes")
    shared = _tree_settings(trees, depth, bins, seed, memory_mb, min_rows)
    names = StringIndexer(inputCol=label, outputCol="label__i", stringOrderType="alphabetAsc", handleInvalid="skip").fit(train)
    out = dict(labelCol="label__i", predictionCol="prediction__i")
    if kind == "gbt":
        model = GBTClassifier(maxIter=trees, stepSize=step, **out, **shared)
    else:
        model = RandomForestClassifier(numTrees=trees, impurity="entropy", **out, **shared)
    decode = IndexToString(inputCol="prediction__i", outputCol="prediction", labels=names.labels)
    prepared = names.transform(laid_out(train.select(*dict.fromkeys([*features, *categorical, label])), partitions))
    return _without_summaries(Pipeline(stages=[*_feature_stages(features, categorical), model, decode]).fit(prepared))


def score(model: PipelineModel, df: DataFrame, keep_features: bool = False) -> DataFrame:
    """All input columns plus ``prediction``; no label is needed."""
    scored = model.transform(df)
    extra = ["features"] if keep_features else []
    return scored.select(*df.columns, *extra, "prediction")


def cross_validate(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    *,
    fold: str = "fold",
    k: int = 10,
    kind: str = "gbt",
    categorical: Sequence[str] = (),
    partitions: int = PARTITIONS,
    concurrent: int = CONCURRENT_FITS,
    **settings,
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """(model of the best-R2 fold, metrics per fold, summary).

    Each model is trained on the other k-1 folds; boosting uses the held-out fold for early
    stopping. Features are made once, into a table that all fits read, and ``concurrent`` fits
    run at a time; the models don't depend on that number.
    """
    shared_dir(df.sparkSession)
    used = laid_out(df.select(*dict.fromkeys([*features, *categorical, label, fold])), partitions)
    prepare = Pipeline(stages=_feature_stages(features, categorical)).fit(used)
    # Laid out once more: reading the table must give every fit the same partitions.
    data = stable(prepare.transform(used).select("features", label, fold), "folds")
    rows = data.repartition(partitions, F.xxhash64("features", label, fold)).sortWithinPartitions(F.xxhash64("features", label, fold), label)

    def fit(i: int) -> PipelineModel:
        flagged = rows.withColumn("__held", F.col(fold) == i)
        if kind != "gbt":
            flagged = flagged.where(~F.col("__held"))
        trees = _regressor(kind, label, "__held" if kind == "gbt" else None, **settings).fit(flagged)
        return PipelineModel(stages=[*prepare.stages, trees])

    pool = ThreadPool(max(1, min(k, concurrent)))
    try:
        models = pool.map(inheritable_thread_target(df.sparkSession)(fit), range(k))
    finally:
        pool.close()
    scored = None
    for i, model in enumerate(models):
        held = model.stages[-1].transform(data.where(F.col(fold) == i)).select(fold, label, "prediction")
        scored = held if scored is None else scored.unionByName(held)
    metrics = stable(regression_metrics(scored, label, by=[fold]), "fold-metrics")
    # One row per fold.
    best = metrics.orderBy(F.desc_nulls_last("r2"), fold).first()[fold]
    return models[best], metrics, fold_summary(metrics)


def feature_importance(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """(feature, importance): one row per model input."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    trees = next(s for s in model.stages if hasattr(s, "featureImportances"))
    rows = [(name, float(v)) for name, v in zip(assembler.getInputCols(), trees.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
