"""Walk-forward models: train-only scaling, logistic regression, prediction, penalty choice, assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import sigmoid
from tidemark.operators.metrics import probability_metrics
from tidemark.sources.folders import new_folder

EPOCHS = 120
RATE = 0.1


def scaler(train: DataFrame, names: list[str], by: str = "fold") -> DataFrame:
    """Per fold the mean and population deviation of each feature of the training rows; no spread counts as 1."""
    std = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0)
    return train.groupBy(by).agg(*[x for c in names for x in (F.avg(c).alias(f"{c}_mean"), std(c).alias(f"{c}_std"))])


def scaled(rows: DataFrame, scale: DataFrame, names: list[str], by: str = "fold") -> DataFrame:
    """``rows`` with the features scaled by their fold's figures; ``scale`` has a row a fold."""
    joined = rows.join(F.broadcast(scale), by)
    return joined.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in names}).drop(*[f"{c}_{x}" for c in names for x in ("mean", "std")])


def fit_descent(train: DataFrame, names: list[str], penalties: list[float], by: str = "fold", epochs: int = EPOCHS) -> DataFrame:
    """fold, penalty, intercept, weights by full-batch gradient descent from zero: ``epochs`` steps of RATE on mean log-loss + penalty / 2 * |w|^2.

    Each step is one aggregation over all training rows of all folds and penalties; only the weights, a row for each
    fold and penalty, go round. Nothing gathers a fold's rows. The training rows are written once, so a step that loses
    an executor reads them again.
    """
    spark = train.sparkSession
    k = len(names)
    path = new_folder(spark, "train")
    train.select(by, F.col("y").cast("double").alias("y"), *names).write.parquet(path)
    rows = spark.read.parquet(path)
    kind = rows.schema[by].dataType.simpleString()
    grid = [(r[by], float(p)) for r in rows.select(by).distinct().orderBy(by).collect() for p in penalties]  # a row a fold
    state = {g: [0.0] * (k + 1) for g in grid}
    table = lambda: spark.createDataFrame([(f, p, x) for (f, p), x in state.items()], f"`{by}` {kind}, penalty double, w array<double>")
    for _ in range(epochs):
        joined = rows.join(F.broadcast(table()), by)  # a row a fold and penalty
        score = reduce(lambda a, i: a + F.col("w")[i + 1] * F.col(names[i]), range(k), F.col("w")[0])
        error = sigmoid(score) - F.col("y")
        grads = joined.groupBy(by, "penalty").agg(F.avg(error).alias("g0"), *[F.avg(error * F.col(c)).alias(f"g{i + 1}") for i, c in enumerate(names)]).collect()
        for g in grads:
            x, p = state[(g[by], g["penalty"])], g["penalty"]
            state[(g[by], p)] = [x[0] - RATE * g["g0"]] + [x[i] - RATE * (g[f"g{i}"] + p * x[i]) for i in range(1, k + 1)]
    return table().select(by, "penalty", F.col("w")[0].alias("intercept"), F.slice("w", 2, k).alias("weights"))


def fit_logistic(train: DataFrame, names: list[str], penalty: float) -> tuple[float, list[float]]:
    """The same objective's optimum for one fold, by Spark's own distributed solver."""
    rows = VectorAssembler(inputCols=names, outputCol="_x").transform(train.select(F.col("y").cast("double").alias("label"), *names))
    model = LogisticRegression(featuresCol="_x", regParam=penalty, elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-11).fit(rows)
    return float(model.intercept), [float(c) for c in model.coefficients]


def predict(rows: DataFrame, names: list[str], intercept: Column, weights: Column) -> DataFrame:
    score = reduce(lambda a, i: a + weights[i] * F.col(names[i]), range(len(names)), intercept)
    return rows.withColumn("p", sigmoid(score))


def best_penalty(validation: DataFrame) -> DataFrame:
    """fold, penalty of the least validation log-loss; ties go to the smaller penalty. ``validation``: fold, penalty, p, y."""
    losses = probability_metrics(validation, ["fold", "penalty"])
    return losses.groupBy("fold").agg(F.min_by("penalty", F.struct("log_loss", "penalty")).alias("penalty"), F.min("log_loss").alias("log_loss"))


def out_of_sample(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """fold, predictions, scored, unscored, and the reference metrics of a constant 0.5."""
    joined = predictions.join(labels, ["session", "symbol"], "left")
    counts = joined.groupBy("fold").agg(F.count(F.lit(1)).alias("predictions"), F.count("y").alias("scored"), F.count_if(F.col("y").isNull()).alias("unscored"))
    half = probability_metrics(joined.where("y IS NOT NULL").select("fold", F.lit(0.5).alias("p"), "y"), ["fold"])
    return counts.join(half.select("fold", F.col("accuracy").alias("reference_accuracy"), F.col("brier_score").alias("reference_brier"), F.col("log_loss").alias("reference_log_loss")), "fold", "left")


def signal_weights(predictions: DataFrame) -> DataFrame:
    """session, entity, weight: 1/m over the m predictions of 0.5 or more."""
    chosen = predictions.where(F.col("p") >= 0.5)
    return chosen.select("session", "entity", (1 / F.count(F.lit(1)).over(W.partitionBy("session"))).alias("weight"))
