"""Nulls, ties, repeated rows, empty tables and clashing names in the operators over tables."""

import math

from pyspark.sql import functions as F

from millrace.functions import columns
from millrace.operators import dedup, features, history, paths, raster, running, scores, splits
from millrace.plans.corpus import FAMILIES


def test_ranks_keep_every_row(spark):
    rows = [("a", "k1", 1), ("a", "k1", 1), ("a", None, 2), (None, "k2", 3), (None, "k2", 3), (None, None, 4)] + [("b", f"u{i}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "label string, uid string, n int").withColumn("_h", F.lit("x")).withColumn("_b", F.lit(1)).repartition(5)
    out = splits.hash_rank(df, ["label"], "uid", 3).collect()
    assert len(out) == len(rows) and {r["_h"] for r in out} == {"x"}
    for label, n in (("a", 3), (None, 3), ("b", 300)):
        assert sorted(r["rank"] for r in out if r["label"] == label) == list(range(n))
    assert [r["rank"] for r in out if r["label"] == "a" and r["uid"] is None] == [2]
    assert splits.hash_rank(df.limit(0), ["label"], "uid", 3).count() == 0 and splits.hash_rank(df, [], "uid", 3).agg(F.max("rank")).first()[0] == len(rows) - 1


def test_caps_and_balance(spark):
    rows = [(f"u{i}", i % 3 and 1, "g" if i % 2 else None, 7, 8) for i in range(200)] + [("n1", None, "g", 7, 8), ("n2", None, "g", 7, 8)]
    df = spark.createDataFrame(rows, "uid string, label int, generator string, rank int, `cap of group` int").drop("cap of group").withColumn("_cap", F.lit(1))
    capped = splits.capped(df, "generator", "uid", 50, "cap").collect()
    assert len(capped) == 202 and {r["rank"] for r in capped} == {7}
    assert sum(not r["over"] for r in capped if r["generator"] is None) == 4 and sum(not r["over"] for r in capped if r["generator"] == "g") == 4
    even = splits.balanced(df, "label", "uid", "b").collect()
    assert [sum(not r["over"] for r in even if r["label"] == v) for v in (0, 1, None)] == [67, 67, 2]
    none = df.limit(0)
    assert splits.capped(none, "generator", "uid", 50, "c").count() == splits.balanced(none, "label", "uid", "b").count() == splits.allocated(none, "generator", 15, "g").count() == 0
    job = splits.split_corpus(none.select("uid", "label", "generator", F.lit(True).alias("kept")), FAMILIES)
    assert job.count() == 0 and splits.leakage(job.withColumn("sig", F.lit(1))).count() == 6


def test_scores_without_a_value_count_nowhere(spark):
    odd = [("m", 1, 0.9), ("m", 0, 0.2), ("m", 1, 0.2), ("m", 0, 0.2)]
    more = [("m", None, 0.5), ("m", 1, None), ("m", 0, float("nan"))]
    kind = "tag string, y int, p double"
    whole, sound = spark.createDataFrame(odd + more, kind), spark.createDataFrame(odd, kind)
    for f in (scores.roc_auc, scores.average_precision, scores.ranking, scores.best_f1, scores.roc_points, scores.pr_points):
        assert sorted(map(str, f(whole, ["tag"]).collect())) == sorted(map(str, f(sound, ["tag"]).collect()))
    c = scores.confusion(spark.createDataFrame(odd + more[:2], kind), ["tag"]).first()
    assert (c["tn"], c["fp"], c["fn"], c["tp"]) == (2, 0, 1, 1)
    twice = sound.union(sound)
    assert scores.roc_auc(twice, ["tag"]).first()["auc"] == scores.roc_auc(sound, ["tag"]).first()["auc"]
    clash = sound.withColumn("h", F.lit("x")).withColumn("n", F.lit(3)).withColumn("pos", F.lit(9))
    assert scores.ranking(clash, ["tag"]).first() == scores.ranking(sound, ["tag"]).first()
    null_key = sound.withColumn("tag", F.lit(None).cast("string"))
    assert scores.ranking(null_key, ["tag"]).first()["auc"] == scores.ranking(sound, ["tag"]).first()["auc"]


def test_histories_with_gaps(spark):
    rows = [("a", 1, None), ("a", 2, 0.5), ("a", 3, None), ("a", 4, 0.5), ("a", 5, 0.7), ("b", 1, None), (None, 1, 0.1)]
    df = spark.createDataFrame(rows, "tag string, epoch int, m double").withColumn("best", F.lit(1))
    best = {r["tag"]: (r["best_epoch"], r["best"]) for r in history.best_epoch(df.drop("best"), "m").collect()}
    assert best == {"a": (5, 0.7), "b": (None, None), None: (1, 0.1)}
    ran = {(r["tag"], r["epoch"]): r["improved"] for r in history.running_best(df, "m").collect()}
    assert ran == {("a", 1): False, ("a", 2): True, ("a", 3): False, ("a", 4): False, ("a", 5): True, ("b", 1): False, (None, 1): True}
    chosen = {r["tag"]: r["val_selected_epoch"] for r in history.selection_stats(df.withColumn("v", F.col("m")), "v", "m").collect()}
    assert chosen["a"] is None and chosen["b"] is None
    none = df.limit(0)
    assert history.best_epoch(none, "m").count() == history.early_stop(none, "m", 2).count() == history.last_k(none, "m").count() == history.selection_stats(none, "m", "m").count() == 0


def test_features_with_odd_values(spark):
    rows = [(1, 1.0, 5.0), (1, None, 5.0), (0, float("nan"), 5.0), (0, float("inf"), 5.0), (None, 3.0, None), (None, 3.0, None)]
    df = spark.createDataFrame(rows, "label int, a double, b double").withColumn("feature", F.lit("x")).withColumn("lo", F.lit(1))
    s = features.fit_scaler(df, ["a", "b"]).first()
    assert s["mu_a"] == 7 / 6 and s["sd_a"] > 1
    z = features.standardized(df, features.fit_scaler(df, ["a", "b"]), ["a", "b"], 1.0).collect()
    assert len(z) == 6 and all(-1 <= r["a"] <= 1 and math.isfinite(r["b"]) for r in z)
    empty = features.fit_scaler(df.limit(0), ["a"])
    assert features.standardized(df.limit(0), empty, ["a"]).count() == 0
    finite = df.where("a is null or a < 10")
    bins = {(r["feature"], r["label"], r["bin"]): r["n"] for r in features.class_histograms(finite, ["a", "b"], 4).collect()}
    assert bins == {("a", 1, 1): 1, ("a", None, 1): 2, ("b", 1, 1): 2}
    assert features.class_histograms(df.limit(0), ["a"], 4).count() == 0
    assert {r["feature"]: r["n"] for r in features.described(finite, ["a", "b"]).collect()} == {"a": 3, "b": 2}
    assert features.correlations(df.limit(0), ["a", "b"]).where("r is not null").count() == 0


def test_paths_that_are_null_or_bare(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (4, "/a/b.c/x"), (5, "/a/.hidden"), (6, "/Real/y.PNG"), (7, "/Real/y.PNG")], "page_id long, path string")
    p = F.col("path")
    out = {r["page_id"]: r for r in df.select("page_id", columns.basename(p).alias("b"), columns.extension(p).alias("e"), columns.stem(p).alias("s"), columns.parent(p, 1).alias("f")).collect()}
    assert (out[1]["b"], out[1]["e"]) == (None, None) and (out[2]["b"], out[2]["e"], out[2]["f"]) == ("", "", "")
    assert (out[3]["b"], out[3]["f"]) == ("x", "") and (out[4]["e"], out[4]["s"], out[4]["f"]) == ("", "x", "b.c") and out[6]["e"] == ".png"
    links = {r["page_id"]: r["link"] for r in paths.collision_names(df.withColumn("class", F.lit(0)), "class").collect()}
    assert links[6] == "y.PNG" and links[7] == "y__1.PNG" and links[1] is None and len(links) == 7
    assert paths.collision_names(df.limit(0).withColumn("class", F.lit(0)), "class").count() == 0
    assert paths.listed(df, (".png",)).count() == 2


def test_tiles_and_signatures_of_nothing(spark):
    none = spark.createDataFrame([], "img long, y int, x int, v int")
    t = raster.tile_rows(none)
    for f in (raster.spectrum, raster.cooccurrence, raster.gradients, raster.signature, raster.moments, raster.autocorrelation_peak):
        assert f(t).count() == 0
    rows = spark.createDataFrame([(1, None, "d"), (None, 5, None), (None, 5, "d"), (3, 5, None)], "doc_id long, sig long, dataset string")
    assert dedup.similar_pairs(rows).count() == 0
    assert {(r["dataset_a"], r["dataset_b"], r["pairs"]) for r in dedup.pair_counts(rows.where("dataset is not null")).collect()} == set()
    assert running.exact_quantiles(rows, ["dataset"], "sig", {"m": 0.5}).count() == 2
