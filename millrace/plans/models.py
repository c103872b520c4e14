"""Queries that fit models. Their solvers are not expressible in SQL; tests hold them to properties."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import features as X
from millrace.operators import models as M
from millrace.operators import scores as S
from millrace.operators.splits import hash_rank
from millrace.plans import bindings as B
from millrace.plans.bindings import FEATURES
from millrace.sources.scratch import cut

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def stratified(spark, d) -> DataFrame:
    f = cut(B.features(spark, d))
    sizes = f.groupBy("label").agg(F.count("*").alias("n"))
    return hash_rank(f, ["label"], "uid", 7).join(F.broadcast(sizes), "label").withColumn("train", F.col("rank") < F.expr("n * 80 div 100")).drop("rank", "n")


@query
def m1_standardized_lr(spark, d):
    rows = cut(stratified(spark, d))
    scaler, model = M.baseline(rows.where("train"), FEATURES)
    p = M.scored(rows.where("not train"), FEATURES, scaler, model).select(F.lit("lr").alias("tag"), F.col("label").alias("y"), "p")
    top = ",".join(c for c, _ in M.weights(model, FEATURES)[:3])
    return S.threshold_metrics(S.confusion(p, ["tag"])).join(S.roc_auc(p, ["tag"]), "tag").withColumn("top_features", F.lit(top))


def features_only(spark, d):
    """Features clipped to ten deviations of the training rows, by split, and the model fitted on these."""
    part = F.when(F.col("doc_id") % 5 == 0, "val").when(F.col("doc_id") % 5 == 1, "logo").otherwise("train")
    f = cut(B.features(spark, d).withColumn("split", part))
    z = cut(X.standardized(f, X.fit_scaler(f.where("split = 'train'"), FEATURES, 1e-8), FEATURES, 10.0))
    return z, *M.baseline(z.where("split = 'train'"), FEATURES)


@query
def m2_features_only(spark, d):
    z, scaler, model = features_only(spark, d)
    p = M.scored(z, FEATURES, scaler, model).select("split", F.col("label").alias("y"), "p")
    return S.ranking(p, ["split"]).join(S.threshold_metrics(S.confusion(p, ["split"])), "split")


@query
def m2_weights(spark, d):
    """The model's weights, largest magnitude first."""
    _, _, model = features_only(spark, d)
    rows = [(k, c.removeprefix("f_"), w) for k, (c, w) in enumerate(M.weights(model, FEATURES), 1)]
    return spark.createDataFrame(rows, "rank int, feature string, weight double")


def embedded(spark, d) -> DataFrame:
    e = B.read(spark, d, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    return e.select(F.col("vec_id").alias("id"), (F.col("label") % 2).cast("int").alias("y"), v.alias("v"), (F.col("vec_id") % 5 == 0).alias("held"))


@query
def m3_linear_probe(spark, d):
    e = embedded(spark, d)
    strength, auc, p = M.probe(e.where("not held"), e.where("held"))
    return p.withColumn("strength", F.lit(strength)).withColumn("held_auc", F.lit(float(auc)))


@query
def m4_three_heads(spark, d):
    """Ranking of three heads, the perceptrons 384 wide, and what the features add to the control."""
    f = cut(B.features(spark, d))
    z = X.standardized(f, X.fit_scaler(f, FEATURES), FEATURES).select(F.col("doc_id").alias("id"), F.array(*FEATURES).alias("f"))
    e = cut(embedded(spark, d).join(z, "id"))
    stop = (F.col("id") % 5 == 1) & ~F.col("held")
    p = cut(M.heads(e.where(~F.col("held") & ~stop), e.where(stop), e.where("held"), 64, len(FEATURES), 384).withColumnRenamed("head", "tag"))
    r = S.ranking(p, ["tag"]).join(p.groupBy("tag").agg(F.max("best_round").alias("best_round")), "tag")
    of = lambda t: F.max(F.when(F.col("tag") == t, F.col("auc")))
    return r.crossJoin(F.broadcast(r.agg(F.round(of("fusion") - of("mlp"), 6).alias("fusion_minus_control"))))


@query
def m5_projection(spark, d):
    return M.projection(embedded(spark, d))


@query
def m6_batch_scoring(spark, d):
    """All embeddings scored by a model fitted on those not held out, loaded once a worker."""
    e = embedded(spark, d)
    rows = e.where("not held").select("y", array_to_vector("v").alias("features"))
    model = LogisticRegression(labelCol="y", regParam=1e-2, maxIter=100).fit(rows)
    return M.prediction_table(M.batch_scores(e, M.loader(model), 64))
