"""Goldens and properties of the operators."""

import random

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import dedup, history, images, models, raster, running, scores, splits
from millrace.plans import models as model_plans
from millrace.sources import files
from millrace.sources.scratch import cut

DATA = "/root/testdata/sf0.001"


def test_metrics_golden(spark):
    """A published confusion matrix and its metrics."""
    row = scores.threshold_metrics(spark.createDataFrame([(44, 21, 4, 1859)], "tn long, fp long, fn long, tp long")).first()
    assert abs(row["accuracy"] - (44 + 1859) / 1928) < 1e-6
    assert abs(row["f1_ai"] - 2 * 1859 / (2 * 1859 + 21 + 4)) < 1e-6
    assert abs(row["recall_real"] - 44 / 65) < 1e-6


def test_zero_division_and_single_class(spark):
    df = spark.createDataFrame([("t", 1, 0.2), ("t", 1, 0.9)], "tag string, y int, p double")
    assert scores.roc_auc(df, ["tag"]).first()["auc"] is None
    m = scores.threshold_metrics(scores.confusion(df, ["tag"])).first()
    assert m["fpr"] == 0 and m["mcc"] == 0


def auc(rows):
    pairs = [(p, q) for p, y in rows if y for q, z in rows if not z]
    return sum((p > q) + 0.5 * (p == q) for p, q in pairs) / len(pairs) if pairs else None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.integers(0, 5), st.booleans()), min_size=1, max_size=30))
def test_auc_with_ties(spark, rows):
    rows = [(p / 5, y) for p, y in rows]
    df = spark.createDataFrame([("t", int(y), p) for p, y in rows], "tag string, y int, p double")
    got, flipped = (scores.roc_auc(d, ["tag"]).first()["auc"] for d in (df, df.withColumn("p", -F.col("p"))))
    want = auc(rows)
    assert (got is None) == (want is None)
    if want is not None:
        assert abs(got - want) < 1e-5 and abs(got + flipped - 1) < 1e-5


def test_calibration_edge(spark):
    df = spark.createDataFrame([("t", 1, 1.0), ("t", 0, 0.0), ("t", 0, 0.5)], "tag string, y int, p double")
    assert sum(r["n"] for r in scores.calibration(df, ["tag"], 12).collect()) == 2
    assert sum(r["n"] for r in scores.calibration(df, ["tag"], 10, 1, "right").collect()) == 3


def test_early_stop_golden(spark):
    """Best at 29 and patience 20 stop at 49."""
    df = spark.createDataFrame([("t", e, float(e if e <= 29 else 58 - e)) for e in range(1, 60)], "tag string, epoch int, v double")
    assert history.early_stop(df, "v", 20).first()["stop_epoch"] == 49
    assert history.best_epoch(df, "v").first()["best_epoch"] == 29


def signatures(spark, seed=0, n=300):
    rng = random.Random(seed)
    base = [rng.getrandbits(60) for _ in range(60)]
    rows = []
    for i in range(n):
        s = rng.choice(base)
        for _ in range(rng.randrange(6)):
            s ^= 1 << rng.randrange(60)
        rows.append((i, s))
    return rows, spark.createDataFrame(rows, "doc_id long, sig long")


def test_full_recall_against_all_pairs(spark):
    rows, df = signatures(spark)
    want = {i: not any(a < i and (s ^ t).bit_count() <= 4 for a, s in rows) for i, t in rows}
    for widths in (dedup.BANDS7, dedup.BANDS5):
        got = {r["doc_id"]: r["kept"] for r in dedup.keep_first(df, widths=widths).collect()}
        assert got == want


def test_one_flip_in_each_band_needs_five_bands(spark):
    a, b = 0, 1 | 1 << 16 | 1 << 32 | 1 << 48
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, sig long")
    assert dedup.near_signatures(df, widths=dedup.BANDS4).count() == 0
    assert dedup.near_signatures(df, widths=dedup.BANDS5).count() == dedup.near_signatures(df).count() == 1


def test_texts_without_words_have_a_signature(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "one two", 0), (5, "One  two", 0)], "doc_id long, text string, sig int").repartition(3)
    sigs = dedup.text_signature(df)
    got = {r["doc_id"]: r["sig"] for r in sigs.collect()}
    assert got[1] == got[2] == got[3] == 0 and got[4] == got[5] != 0
    assert {r["doc_id"]: r["kept"] for r in dedup.keep_first(sigs).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False}
    assert dedup.text_signature(df.limit(0)).count() == 0 and dedup.keep_first(sigs.limit(0)).count() == 0


def test_every_second_copy_across_id_ranges(spark):
    rows = [(i, i % 3) for i in range(0, 400, 2)]
    df = spark.createDataFrame(rows, "doc_id long, sig long").repartition(4)
    seen, want = {}, {}
    for i, s in rows:
        seen[s] = seen.get(s, 0) + 1
        want[i] = seen[s] % 2 == 1
    assert {r["doc_id"]: r["kept"] for r in dedup.drop_every_second(df, ids=16).collect()} == want


def test_many_distinct_scores(spark):
    """100,000 distinct scores of one model, most near 0 and 1; groups of positives against all negatives; exact quantiles."""
    n = 100_000
    df = spark.range(n).select(F.lit("m").alias("tag"), (F.col("id") % 3 == 0).cast("int").alias("y"), (1 / (1 + F.exp(-(F.randn(5) * 9 + F.col("id") % 3)))).alias("p"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("generator"))
    pdf = df.toPandas()
    df = spark.createDataFrame(pdf, df.schema).repartition(5)
    low = pdf.sort_values("p")
    ranks = low["p"].rank()
    P, N = int(low["y"].sum()), int((1 - low["y"]).sum())
    want = (ranks[low["y"] == 1].sum() - P * (P + 1) / 2) / (P * N)
    assert abs(scores.roc_auc(df, ["tag"]).first()["auc"] - want) < 2e-6
    neg = np.sort(pdf.loc[pdf["y"] == 0, "p"].to_numpy())
    for r in scores.per_group_auc(df, ["tag"]).collect():
        pos = np.sort(pdf.loc[(pdf["y"] == 1) & (pdf["generator"] == r["generator"]), "p"].to_numpy())
        below, upto = np.searchsorted(neg, pos, "left"), np.searchsorted(neg, pos, "right")
        assert abs(r["auc"] - ((below + upto) / 2).sum() / (len(pos) * len(neg))) < 2e-6
        tp = np.arange(len(pos), 0, -1)
        assert abs(r["ap"] - (tp / (tp + len(neg) - below)).mean()) < 2e-6
    got = running.exact_quantiles(df, ["tag"], "p", {"a": 0.0, "b": 0.37, "c": 1.0}).first()
    assert np.allclose([got["a"], got["b"], got["c"]], np.quantile(pdf["p"], [0, 0.37, 1]), rtol=0, atol=1e-12)
    odd = spark.createDataFrame([(None, 1, None, "g"), (None, 0, 0.5, None), ("t", 1, 0.5, None)], "tag string, y int, p double, generator string")
    assert scores.roc_auc(odd, ["tag"]).count() == 2 and running.exact_quantiles(odd, ["tag"], "p", {"a": 0.5}).count() == 2


def greedy(rows, limit):
    runs, kept = {}, {}
    for i, s in sorted(rows):
        runs[s] = runs.get(s, 0) + 1
        kept[i] = runs[s] % 2 == 1
    sig = dict(rows)
    for shift in (0, 16, 32, 48):
        buckets = {}
        for i in sorted(kept):
            if kept[i]:
                buckets.setdefault(sig[i] >> shift & 0xFFFF, []).append(i)
        for ids in buckets.values():
            if 2 <= len(ids) <= limit:
                for k, i in enumerate(ids):
                    for j in ids[k + 1 :]:
                        if kept[i] and kept[j] and (sig[i] ^ sig[j]).bit_count() <= 4:
                            kept[j] = False
    return kept


def test_greedy_passes_in_order(spark):
    rows, df = signatures(spark, 1)
    for limit in (4000, 3):
        assert {r["doc_id"]: r["kept"] for r in dedup.greedy_passes(df, limit=limit).collect()} == greedy(rows, limit)


def test_split_laws(spark):
    rows = [(f"u{i}", i % 3 > 0, f"g{i % 11}" if i % 3 else "real:unknown", i % 13 > 0) for i in range(600)]
    df = spark.createDataFrame([(u, int(y), g, k) for u, y, g, k in rows], "uid string, label int, generator string, kept boolean")
    out = splits.split_corpus(df, {"one": ["g1"], "commercial": []})
    assert out.count() == 600 and out.select("uid").distinct().count() == 600
    sizes = {(r["split"], r["label"]): r["count"] for r in out.groupBy("split", "label").count().collect()}
    assert sizes["train", 0] == sizes["train", 1]
    sig = out.withColumn("sig", F.xxhash64("uid"))
    splits.assert_sound(sig)
    ones = splits.hash_rank(df, ["label"], "uid", 1).repartition(1).collect()
    many = splits.hash_rank(df.repartition(7), ["label"], "uid", 1).collect()
    assert {(r["uid"], r["rank"]) for r in ones} == {(r["uid"], r["rank"]) for r in many}


def newton(x, y, strength, rounds=60):
    """Logistic regression by Newton steps: mean loss plus strength / 2 times the squared weights; the intercept is free."""
    a = np.column_stack((x, np.ones(len(x))))
    w, ridge = np.zeros(a.shape[1]), np.diag([strength] * x.shape[1] + [0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) / len(x) + ridge, a.T @ (p - y) / len(x) + ridge @ w)
    return w


def test_logistic_regression_equals_newton(spark):
    """The baseline (C = 1, standardised) and its scores on other rows, against a plain fit of the same optimum."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.2] + [0, 3, -1]
    y = (x @ [0.8, -0.3, 2.0] + rng.normal(size=300) > -2.5).astype(int)
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(300)], "id long, label int, a double, b double, c double")
    scaler, model = models.baseline(df.where("id < 250"), names)
    z = (x - x[:250].mean(0)) / x[:250].std(0, ddof=1)
    w = newton(z[:250], y[:250], 1 / 250)
    assert np.allclose([*model.coefficients, model.intercept], w, atol=2e-3)
    p = {r["id"]: r["p"] for r in models.scored(df.where("id >= 250"), names, scaler, model).collect()}
    want = 1 / (1 + np.exp(-(z[250:] @ w[:3] + w[3])))
    assert np.allclose([p[i] for i in range(250, 300)], want, atol=1e-3)
    assert [n for n, _ in models.weights(model, names)] == [names[i] for i in np.argsort(-np.abs(w[:3]))]


def test_probe_projection_and_batch_scores_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(200)], "id long, y int, v array<double>")
    strength, auc_, p = models.probe(df.where("id < 150"), df.where("id >= 150"), (1e-3,))
    sd = x[:150].std(0, ddof=1)
    w = newton(x[:150] / sd, y[:150], strength)
    got = {r["id"]: r["p"] for r in p.collect()}
    assert np.allclose([got[i] for i in range(150, 200)], 1 / (1 + np.exp(-(x[150:] / sd @ w[:4] + w[4]))), atol=1e-3)
    assert abs(auc_ - auc([(got[i], y[i]) for i in range(150, 200)])) < 1e-5
    c = x - x.mean(0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    points = {r["id"]: (r["x1"], r["x2"]) for r in models.projection(df).collect()}
    for k in range(2):
        mine, theirs = np.array([points[i][k] for i in range(200)]), c @ vt[k]
        assert np.allclose(mine, theirs, atol=1e-6) or np.allclose(mine, -theirs, atol=1e-6)
    scored = {r["id"]: r["p"] for r in models.batch_scores(df, lambda: lambda m: m.mean(axis=1), 4).collect()}
    assert np.allclose([scored[i] for i in range(200)], x.mean(1))
    told = df.withColumn("f", F.array(F.col("y").cast("double")))
    heads = models.heads(told.where("id < 120"), told.where("id between 120 and 149"), df.where("id >= 150").withColumn("f", F.array(F.lit(0.0))), 4, 1, 3)
    assert {r["head"]: r["count"] for r in heads.groupBy("head").count().collect()} == {"linear": 50, "mlp": 50, "fusion": 50}


def test_image_kernel_equals_the_tile_expressions(spark):
    """The kernel over image files, by the tile queries on grey 8 x 8 pixels; and images of other sizes."""
    rng = np.random.default_rng(5)
    tiles = rng.integers(0, 256, (6, 8, 8))
    pixels = spark.createDataFrame([(i, y, x, int(tiles[i, y, x])) for i in range(6) for y in range(8) for x in range(8)], "img long, y int, x int, v int")
    t = raster.tile_rows(pixels)
    z = raster.sensor_noise(t)
    parts = [raster.moments(raster.residual(t, raster.GAUSS_5)).toDF("img", "noise_mean", "noise_std", "noise_energy"), raster.spectrum(t), raster.cooccurrence(t), raster.gradients(t)]
    parts += [raster.moments(z).toDF("img", "prnu_mean", "prnu_std", "prnu_energy"), raster.spectrum(z).select("img", F.col("fft_ratio").alias("prnu_fft_ratio")), raster.autocorrelation_peak(z).withColumnRenamed("peak", "prnu_peak")]
    for part in parts:
        for r in part.collect():
            want = images.features(np.repeat(tiles[r["img"]][:, :, None], 3, axis=2).astype(np.uint8))
            for name in set(part.columns) - {"img"}:
                assert abs(r[name] - want[name]) < 2e-5 * max(1, abs(want[name])), name
    for shape in ((1, 1, 3), (3, 40, 3), (33, 17, 3)):
        f = images.features(rng.integers(0, 256, shape).astype(np.uint8))
        assert sorted(f) == images.NAMES and all(np.isfinite(v) for v in f.values())


def test_broken_images_are_dropped_black_or_counted(spark, tmp_path):
    good, grey = files.png(np.full((3, 2, 3), (10, 20, 30), dtype=np.uint8)), b"no image"
    files.write_files(spark.createDataFrame([("a.png", good), ("b.png", grey), ("c.png", good[:30])], "name string, body binary"), str(tmp_path)).collect()
    assert [(r["height"], r["width"]) for r in files.read_images(spark, str(tmp_path)).collect()] == [(3, 2)]
    black = {r["path"][-5:]: r for r in files.read_images(spark, str(tmp_path), drop=False).collect()}
    assert len(black) == 3 and black["b.png"]["height"] == 1 and bytes(black["b.png"]["data"]) == bytes(3)
    rows = {r["path"][-5:]: r for r in images.extract(files.read_images(spark, str(tmp_path), drop=None)).collect()}
    assert [rows[n]["failed"] for n in ("a.png", "b.png", "c.png")] == [False, True, True]
    assert abs(rows["a.png"]["f_mean_b"] - 30 / 255) < 1e-6


def test_empty_tables_and_clashing_columns(spark):
    """Operators over no rows, and over rows whose columns are named as their helpers are."""
    none = spark.createDataFrame([], "tag string, generator string, y int, p double")
    for f in (scores.roc_auc, scores.average_precision, scores.ranking, scores.best_f1, scores.roc_points, scores.pr_points, scores.per_group_auc, scores.probability_summary):
        assert f(none, ["tag"]).count() == 0
    assert dedup.pair_counts(spark.createDataFrame([], "doc_id long, sig long, dataset string")).count() == 0
    rows = spark.createDataFrame([("u1", "a", 1, 7, 8), ("u2", "a", 0, 7, 8), ("u3", "b", 1, 7, 8)], "uid string, label string, y int, band int, n int")
    ranked = splits.hash_rank(rows, ["label"], "uid", 3)
    assert {(r["uid"], r["band"], r["n"]) for r in ranked.collect()} == {("u1", 7, 8), ("u2", 7, 8), ("u3", 7, 8)}
    copies = spark.createDataFrame([(1, 5, 9), (2, 5, 9), (3, 5, 9)], "doc_id long, sig long, n int")
    assert [r["kept"] for r in dedup.drop_every_second(copies).orderBy("doc_id").collect()] == [True, False, True]


def test_models_run(spark):
    rng = random.Random(2)
    rows = [(i, int(i % 2), [rng.gauss(i % 2 * 2, 1) for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, y int, v array<double>")
    _, auc_, p = models.probe(df.where("id < 150"), df.where("id >= 150"))
    assert auc_ > 0.9 and p.count() == 50
    assert models.projection(df.limit(0)).count() == 0
    assert models.projection(df.limit(1)).first()["x1"] == 0.0
    assert models.projection(df).count() == 200
    assert model_plans.m1_standardized_lr(spark, DATA).count() == 1


def test_signature_keys_stay_off_the_driver(spark):
    """20,000 signatures are few bytes for Spark's estimate, their 700,000 keys are not: no plan broadcasts them."""
    sigs = cut(spark.range(20_000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("sig")))
    near = dedup.near_signatures(sigs)
    near.collect()
    assert "BroadcastExchange" not in near._jdf.queryExecution().executedPlan().toString()


def test_copies_of_images_take_one_pass(spark, tmp_path):
    """Three forms of each pixel, and the pixels are read once."""
    from millrace.plans import raster

    spark.createDataFrame([(2, 0, 0, 10, 250, 33)], "img long, y int, x int, r int, g int, b int").write.parquet(str(tmp_path / "p"))
    made = raster.copied(spark.read.parquet(str(tmp_path / "p")))
    assert sorted(map(tuple, made.collect())) == [(6, 0, 0, 10, 250, 33), (7, 0, 0, 22, 255, 45), (8, 0, 0, 8, 248, 40)]
    assert made._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
