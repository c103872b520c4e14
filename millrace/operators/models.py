"""Distributed baselines over feature tables and embeddings; pyspark.ml fits, expressions score."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import class_name, confidence_bucket, error_type, sanitized
from millrace.operators.scores import roc_auc


def vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    clean = df.select(*[c for c in df.columns if c not in columns], *[sanitized(F.col(c)).alias(c) for c in columns])
    return VectorAssembler(inputCols=columns, outputCol="raw").transform(clean)


def baseline(train: DataFrame, columns: list[str], c: float = 1.0):
    """Standardised logistic regression with L2 strength 1 / C a row. Returns (scaler, model)."""
    rows = vectors(train, columns)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(rows)
    n = rows.count()
    return scaler, LogisticRegression(regParam=1.0 / (c * max(1, n)), standardization=False, maxIter=200).fit(scaler.transform(rows))


def scored(df: DataFrame, columns: list[str], scaler, model) -> DataFrame:
    """df's other columns, and p: the probability of class 1."""
    out = model.transform(scaler.transform(vectors(df, columns)))
    return out.withColumn("p", F.get(vector_to_array("probability"), F.lit(1))).drop("raw", "features", "rawPrediction", "probability", "prediction")


def weights(model, columns: list[str]) -> list[tuple[str, float]]:
    """(column, weight), largest magnitude first."""
    return sorted(zip(columns, map(float, model.coefficients), strict=True), key=lambda x: (-abs(x[1]), x[0]))


def probe(train: DataFrame, held: DataFrame, strengths: tuple[float, ...] = (1e-4, 1e-3, 1e-2, 1e-1)) -> tuple[float, float, DataFrame]:
    """Linear probe over `v` (array) for `y`: the strength of the best held-out AUC, that AUC, and the held-out scores."""
    best: tuple[float, float, DataFrame] | None = None
    rows, out = (df.withColumn("features", array_to_vector("v")) for df in (train, held))
    for s in strengths:
        model = LogisticRegression(labelCol="y", regParam=s, maxIter=100).fit(rows)
        p = model.transform(out).select("id", "y", F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
        auc = roc_auc(p.withColumn("tag", F.lit("probe")), ["tag"]).first()["auc"] or 0.0
        if best is None or auc > best[1]:
            best = (s, auc, p)
    return best


def perceptron(train: DataFrame, stop: DataFrame, layers: list[int], seed: int = 1, rounds: int = 8, iterations: int = 8, patience: int = 2):
    """(model, round, AUC): a perceptron over `features` for `y`, fitted in rounds that each go on from the last one's weights, until `stop` has seen no better AUC for `patience` rounds; the best round's model.

    A round is a few full-batch steps, each one aggregate over the rows, so no task holds more than its own.
    """
    best, weights, worse = None, None, 0
    for k in range(1, rounds + 1):
        trainer = MultilayerPerceptronClassifier(labelCol="y", layers=layers, seed=seed, maxIter=iterations)
        model = (trainer.setInitialWeights(weights) if weights is not None else trainer).fit(train)
        weights = model.weights
        p = model.transform(stop).select("y", F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
        auc = roc_auc(p.withColumn("tag", F.lit("stop")), ["tag"]).first()
        auc = (auc["auc"] if auc else None) or 0.0
        if best is None or auc > best[2]:
            best, worse = (model, k, float(auc)), 0
        else:
            worse += 1
            if worse == patience:
                break
    return best


def heads(train: DataFrame, stop: DataFrame, held: DataFrame, width: int, extra: int, hidden: int, seed: int = 1) -> DataFrame:
    """(id, y, head, best_round, p) of held, by three heads over `v` and `f` (arrays): linear, mlp (the control), and mlp over both joined. The mlp heads have one width and seed, and end where `stop` says."""
    out = None
    for head, column, size in (("linear", "v", width), ("mlp", "v", width), ("fusion", "w", width + extra)):
        rows, watch, rest = (df.withColumn("w", F.concat("v", "f")).select("id", "y", array_to_vector(column).alias("features")) for df in (train, stop, held))
        if head == "linear":
            model, k = LogisticRegression(labelCol="y", regParam=1e-3, maxIter=60).fit(rows), 1
        else:
            rows, watch = rows.persist(), watch.persist()
            model, k, _ = perceptron(rows, watch, [size, hidden, 2], seed)
            rows.unpersist()
            watch.unpersist()
        p = model.transform(rest).select("id", "y", F.lit(head).alias("head"), F.lit(k).alias("best_round"), F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
        out = p if out is None else out.unionByName(p)
    return out


def projection(df: DataFrame, k: int = 2) -> DataFrame:
    """(id, x1..xk): centred PCA of `v`; no rows give none, one row gives zeros."""
    if len(df.select("id").head(2)) < 2:
        return df.select("id", *[F.lit(0.0).alias(f"x{i + 1}") for i in range(k)])
    rows = df.withColumn("raw", array_to_vector("v"))
    centred = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=False).fit(rows).transform(rows)
    p = PCA(k=k, inputCol="features", outputCol="p").fit(centred).transform(centred).withColumn("p", vector_to_array("p"))
    return p.select("id", *[F.get("p", F.lit(i)).alias(f"x{i + 1}") for i in range(k)])


def prediction_table(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Scores (id, y, p) with names, confidence, bucket and error type."""
    pred = (F.col("p") >= threshold).cast("int")
    conf = F.greatest("p", 1 - F.col("p"))
    return df.select("id", "y", class_name(F.col("y")).alias("label_name"), pred.alias("pred"), class_name(pred).alias("predicted_name"), F.col("p").alias("ai_probability"), conf.alias("confidence"), confidence_bucket(conf).alias("bucket"), error_type(F.col("y"), pred).alias("error_type"))


def batch_scores(df: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], width: int, batch: int = 1024) -> DataFrame:
    """(id, y, p) by any model over `v`, an array of `width` numbers: `load` runs once a Python worker and returns a function of a matrix of at most `batch` rows.

    Rows whose `v` is null, of another width or holds a null have a null p. A model that is no function of Spark's can be
    brought in this way.
    """
    score = predict_batch_udf(load, return_type=T.DoubleType(), batch_size=batch, input_tensor_shapes=[[width]])
    sound = F.coalesce((F.size("v") == width) & F.forall("v", lambda x: x.isNotNull()), F.lit(False))
    filled = F.when(sound, F.col("v").cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), width))
    return df.select("id", "y", sound.alias("sound"), score(filled).alias("p")).select("id", "y", F.when(F.col("sound"), F.col("p")).alias("p"))


def loader(model) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A fitted logistic regression as a batch model: its numbers alone go to the workers."""
    w, b = np.array(model.coefficients.toArray()), float(model.intercept)
    return lambda: lambda m: 1.0 / (1.0 + np.exp(-(np.asarray(m, dtype=np.float64) @ w + b)))
