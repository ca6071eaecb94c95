"""Supervised learning on ``pyspark.ml``: baselines, forests, boosted trees, stacking, calibration, bagging, PCA.

Models of other libraries have no exact counterpart here; these are the Spark ones, trained where
the data is. Features are given by name, so that a label can't slip in among them.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, Imputer, MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_FEATURES = ("row", "col", "x", "y", "cell_id", "fold", "label", "weight", "bx", "by")


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = NOT_FEATURES, prefixes: tuple[str, ...] = ("is_",)) -> list[str]:
    """Numeric columns that are no key, coordinate, fold, weight or label."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [n for n, t in df.dtypes if t in numeric and n not in exclude and not n.startswith(prefixes)]


#: Rows of a task of a fit, about.
TASK_ROWS = 50_000
#: Classes that weights are told for.
MOST_CLASSES = 1000


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows, dealt by their hash to tasks of ``TASK_ROWS`` and put in order there.

    A small file with much work a row would be one task. As the tasks depend on the rows alone, so do the draws that a fit makes in them, and reruns agree.
    """
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *df.columns).sortWithinPartitions(*df.columns)


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Append ``weight``: classes (``MOST_CLASSES`` at most, else an error) weigh the same in total. Rows without a label are left out.

    Rows are dealt to tasks (see ``fitted``). The weights are told to the tasks, as a join by class would send each class to one.
    """
    counts = df.groupBy(label).count().limit(MOST_CLASSES + 1).collect()
    if len(counts) > MOST_CLASSES:
        raise ValueError(f"{label} has over {MOST_CLASSES} values")
    total = sum(n for _, n in counts)
    weight = F.lit(None).cast("double")
    for value, n in counts:
        if value is not None:
            weight = F.when(F.col(label) == F.lit(value), float(total) / (len(counts) * n)).otherwise(weight)
    return dealt(df.where(F.col(label).isNotNull()), total).withColumn("weight", weight)


def fitted(pipelines: list[Pipeline], df: DataFrame, label: str) -> list[PipelineModel]:
    """The pipelines fitted on balanced rows. Fits pass over them many times, so they are kept (in memory, else on disk) until the last one is done."""
    train = balanced(df, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return [p.fit(train) for p in pipelines]
    finally:
        train.unpersist()


def _inputs(names: list[str], scale: bool) -> list:
    filled = [f"_f_{n}" for n in names]
    stages = [Imputer(inputCols=names, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_raw" if scale else "features")]
    return stages + ([StandardScaler(inputCol="_raw", outputCol="features", withMean=True)] if scale else [])


def baseline(names: list[str], label: str = "label") -> Pipeline:
    """Median, standard scale, balanced logistic regression."""
    return Pipeline(stages=[*_inputs(names, True), LogisticRegression(labelCol=label, weightCol="weight", regParam=1e-3)])


def forest(names: list[str], label: str = "label", trees: int = 100, seed: int = 0) -> Pipeline:
    return Pipeline(stages=[*_inputs(names, False), RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=8, featureSubsetStrategy="sqrt", minInstancesPerNode=2, seed=seed)])


def boosted(names: list[str], label: str = "label", rounds: int = 30, seed: int = 0) -> Pipeline:
    return Pipeline(stages=[*_inputs(names, False), GBTClassifier(labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=4, stepSize=0.1, seed=seed)])


def probability(model: PipelineModel, df: DataFrame, out: str = "p") -> DataFrame:
    """``df`` with the probability of the positive class."""
    made = model.transform(df)
    return made.withColumn(out, F.get(vector_to_array("probability"), F.lit(1))).select(*df.columns, out)


def out_of_fold(df: DataFrame, pipelines: dict[str, Pipeline], folds: int, keep: list[str]) -> DataFrame:
    """``keep``, ``fold`` and a probability per pipeline, each row scored by models that never saw its fold.

    The driver loops over folds, which are few; fits and scores are distributed. Folds without both classes in training are left out.
    Rows are dealt to tasks and written, and so are the scores, since each is read many times.
    """
    from ..plans.storage import materialize

    parts, df = [], materialize(dealt(df, df.count()))
    for f in range(folds):
        train, test = df.where(F.col("fold") != f), df.where(F.col("fold") == f)
        if train.select("label").distinct().count() < 2:
            continue
        scored = test
        for name, model in zip(pipelines, fitted(list(pipelines.values()), train, "label"), strict=True):
            scored = probability(model, scored, name)
        parts.append(scored.select(*keep, "fold", *pipelines))
    if not parts:
        raise ValueError("no fold leaves both classes to train on")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return materialize(out)


def stack(oof: DataFrame, names: list[str], label: str = "label") -> PipelineModel:
    """A logistic regression over out-of-fold probabilities."""
    pipe = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), LogisticRegression(labelCol=label, weightCol="weight")])
    return fitted([pipe], oof, label)[0]


def calibrate(df: DataFrame, p: str, label: str, out: str, least: int = 30) -> DataFrame:
    """Append ``out``: isotonic regression with at least ``least`` positives, else a logistic curve."""
    rows = df.withColumn("_w", F.lit(1.0)).withColumn("_y", F.col(label).cast("double"))
    if rows.agg(F.sum("_y")).first()[0] >= least:
        model = IsotonicRegression(featuresCol=p, labelCol="_y", weightCol="_w", predictionCol=out).fit(rows)
        return model.transform(rows).drop("_w", "_y")
    model = Pipeline(stages=[VectorAssembler(inputCols=[p], outputCol="features"), LogisticRegression(labelCol="_y")]).fit(rows)
    return probability(model, rows, out).drop("_w", "_y")


def pu_bagging(df: DataFrame, names: list[str], key: str, label: str, n_bags: int, seed: int) -> DataFrame:
    """``key``, ``p_pu``: mean out-of-bag probability over forests on the positives and equally many unlabelled rows."""
    from ..plans.storage import materialize
    from .sampling import bags, out_of_bag_mean

    rows = df.select(key, F.col(label).alias("label"), *names)
    every = materialize(bags(dealt(rows, rows.count()), key, "label", n_bags, seed))  # draws are hashed once
    scored = None
    for b in range(n_bags):
        own = every.where(F.col("bag") == b)
        (model,) = fitted([forest(names, trees=20, seed=seed + b)], own.where("in_bag"), "label")
        # only what the mean takes is scored
        part = probability(model, own.where(~F.col("in_bag") | (F.col("label") == 1))).select(key, "label", "in_bag", "p")
        scored = part if scored is None else scored.unionByName(part)
    return out_of_bag_mean(scored, key, "label", "p")


def importances(model: PipelineModel, names: list[str]) -> list[tuple[str, float]]:
    """Features by importance, the largest first."""
    got = model.stages[-1].featureImportances.toArray()
    return sorted(zip(names, map(float, got), strict=True), key=lambda x: (-x[1], x[0]))


def importance_pivot(importances: DataFrame, models: list[str]) -> DataFrame:
    """``feature`` and a column per model with its mean importance."""
    return importances.groupBy("feature").pivot("model", models).agg(F.avg("importance"))


def min_max(df: DataFrame, names: list[str]) -> DataFrame:
    """Median-filled columns scaled to 0..1 as the vector ``scaled``."""
    filled = [f"_f_{n}" for n in names]
    pipe = Pipeline(stages=[Imputer(inputCols=names, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_raw"), MinMaxScaler(inputCol="_raw", outputCol="scaled")])
    return pipe.fit(df).transform(df).drop("_raw", *filled)


def group_pca(df: DataFrame, groups: dict[str, list[str]], k: int = 5) -> DataFrame:
    """Append ``<group>_pc<i>``: principal components of each group of (standardised) columns."""
    for name, columns in groups.items():
        n = min(k, len(columns))
        pipe = Pipeline(stages=[*_inputs(columns, True), PCA(inputCol="features", outputCol="_pc", k=n)])
        made = pipe.fit(df).transform(df).withColumn("_a", vector_to_array("_pc"))
        df = made.select(*df.columns, *[F.get("_a", F.lit(i)).alias(f"{name}_pc{i + 1}") for i in range(n)])
    return df


def ilr(columns: list[str]) -> list[Column]:
    """Isometric log-ratios of positive parts (null where a part isn't positive)."""
    logs = [F.when(F.col(c) > 0, F.ln(c)) for c in columns]
    out = []
    for i in range(1, len(columns)):
        mean = sum(logs[:i], F.lit(0.0)) / i
        out.append((F.sqrt(F.lit(i / (i + 1.0))) * (mean - logs[i])).alias(f"ilr_{i}"))
    return out


def mahalanobis(df: DataFrame, names: list[str], out: str = "anomaly") -> DataFrame:
    """Append the squared Mahalanobis distance from the mean: a Gaussian stand-in for density models."""
    import numpy as np

    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    got = df.agg(*[F.avg(n) for n in names], *[F.covar_samp(a, b) for a, b in pairs]).first()
    mean, cov = np.array(got[: len(names)], float), np.zeros((len(names),) * 2)
    for (a, b), v in zip(pairs, got[len(names) :], strict=True):
        i, j = names.index(a), names.index(b)
        cov[i, j] = cov[j, i] = v
    inverse = np.linalg.pinv(cov)
    d = [F.col(n) - float(m) for n, m in zip(names, mean, strict=True)]
    return df.withColumn(out, sum((d[i] * d[j] * float(inverse[i, j]) for i in range(len(names)) for j in range(len(names))), F.lit(0.0)))
