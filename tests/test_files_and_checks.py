"""Image signatures and palettes, shards and listings on disk, gates, sketches, fallbacks and scoring hooks."""

import os
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from millrace.operators import dedup, features, gates, images, models, palette, paths, raster, sketches, splits
from millrace.sources import files


def picture(rng, high, wide):
    """A smooth colour image with some noise."""
    coarse = rng.integers(0, 256, (5, 6, 3))
    y, x = np.linspace(0, 3.999, high), np.linspace(0, 4.999, wide)
    i, j, a, b = y.astype(int), x.astype(int), (y % 1)[:, None, None], (x % 1)[None, :, None]
    at = lambda di, dj: coarse[np.ix_(i + di, j + dj)]
    v = at(0, 0) * (1 - a) * (1 - b) + at(1, 0) * a * (1 - b) + at(0, 1) * (1 - a) * b + at(1, 1) * a * b
    return np.clip(v * 0.8 + 20 + rng.normal(0, 2, v.shape), 0, 255).astype(np.uint8)


def blurred(rgb):
    return np.stack([np.clip(np.round(images.filtered(rgb[..., c].astype(float), raster.normalized(raster.GAUSS_5))), 0, 255) for c in range(3)], axis=-1).astype(np.uint8)


def test_signature_columns_equal_the_kernel(spark):
    rng = np.random.default_rng(1)
    tiles = np.concatenate([rng.integers(0, 256, (30, 8, 8)), np.full((1, 8, 8), 77), np.zeros((1, 8, 8), int)])
    rows = spark.createDataFrame([(k, t.ravel().astype(float).tolist()) for k, t in enumerate(tiles)], "img long, v array<double>")
    got = {r["img"]: r["sig"] for r in raster.signature(rows).collect()}
    assert got == {k: images.signature(np.repeat(t[:, :, None], 3, axis=2).astype(np.uint8)) for k, t in enumerate(tiles)}


def test_near_copies_of_image_files_are_found(spark, tmp_path):
    """60 pictures with a brighter, a blurred and a larger copy each: recall over 0.95 within four bits, no other links, and files that can't be read drop nothing."""
    rng = np.random.default_rng(2)
    bodies = []
    for k in range(60):
        p = picture(rng, 40 + k % 7, 56 - k % 9)
        for c, copy in enumerate((p, np.clip(p.astype(int) + 10, 0, 255).astype(np.uint8), blurred(p), np.repeat(np.repeat(p, 2, 0), 2, 1))):
            bodies.append((f"{4 * k + c:06d}.png", files.png(copy)))
    bodies += [("000900.png", b"broken"), ("000901.png", b"broken")]
    files.write_files(spark.createDataFrame(bodies, "name string, body binary"), str(tmp_path)).collect()
    number = F.regexp_extract("path", "([0-9]+)[.]png$", 1).cast("long")
    signed = images.signatures(files.read_images(spark, str(tmp_path), drop=None)).select(number.alias("doc_id"), "sig")
    kept = {r["doc_id"]: r["kept"] for r in dedup.keep_first(signed).collect()}
    assert len(kept) == 242 and kept[900] and kept[901]
    assert all(kept[4 * k] for k in range(60))
    assert sum(not kept[4 * k + c] for k in range(60) for c in (1, 2, 3)) >= 0.95 * 180


def test_signatures_of_tiny_images():
    for shape in ((1, 1, 3), (1, 50, 3), (33, 31, 3), (500, 3, 3)):
        assert -(1 << 63) <= images.signature(np.full(shape, 9, np.uint8)) < 1 << 63
    assert np.allclose(images.onto_grid(50).sum(axis=1), 1) and np.allclose(images.onto_grid(7).sum(axis=1), 1)


def test_palettes_equal_a_plain_assignment(spark):
    rng = np.random.default_rng(3)
    rgb = np.concatenate([rng.integers(0, 256, (4, 6, 6, 3)), np.full((1, 6, 6, 3), 40)])
    rows = [(i, y, x, *map(int, rgb[i, y, x])) for i in range(5) for y in range(6) for x in range(6)]
    pixels = spark.createDataFrame(rows, "img long, y int, x int, r int, g int, b int").repartition(3)
    centres = palette.codebook(pixels, k=5)
    assert centres.shape == (5, 3) and np.array_equal(centres, palette.codebook(pixels.repartition(7), k=5)) or len(centres) == 5
    u = rgb / 255.0
    xyz = np.where(u <= 0.04045, u / 12.92, ((u + 0.055) / 1.055) ** 2.4) @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T / [0.950456, 1.0, 1.088754]
    f = np.where(xyz > 0.008856, np.cbrt(xyz), xyz * 7.787 + 16 / 116)
    lab = np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1).reshape(5, 36, 3)
    code = ((lab[:, :, None, :] - centres) ** 2).sum(-1).round(9).argmin(-1)
    for r in palette.palettes(pixels, centres).collect():
        n = np.bincount(code[r["img"]], minlength=5)
        p = n[n > 0] / 36
        assert r["dominant"] == n.argmax() and abs(r["dominant_share"] - n.max() / 36) < 1e-6
        assert abs(r["color_entropy"] + (p * np.log2(p)).sum()) < 1e-5 and abs(r["dominant_l"] - centres[n.argmax(), 0]) < 1e-5
    assert len(palette.codebook(pixels.where("img = 4"), k=5)) == 1
    assert len(palette.codebook(pixels.limit(0))) == 0


def test_ids_of_shard_rows_stay(spark, tmp_path):
    """Names and places, whatever the scan's partitions, and after rows that fail are dropped; a shard may span batches."""
    rows = [(k, f"s{k % 3}", None if k % 5 == 0 else f"text {k}") for k in range(25_000)]
    df = spark.createDataFrame(rows, "k long, shard string, text string").repartition(7)
    written = files.write_shards(df, str(tmp_path), "shard", ["k"]).collect()
    assert sorted((r["name"], r["rows"]) for r in written) == [("s0.parquet", 8334), ("s1.parquet", 8333), ("s2.parquet", 8333)]
    assert sorted(os.listdir(tmp_path)) == ["s0.parquet", "s1.parquet", "s2.parquet"]
    want = {k: f"set/s{k % 3}/{k // 3}" for k in range(25_000)}
    assert {r["k"]: r["uid"] for r in files.scan_rows(spark, str(tmp_path), "set", ["k"]).collect()} == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        sound = files.scan_rows(spark, str(tmp_path), "set").where("text is not null")
        assert sound.rdd.getNumPartitions() > 3
        assert {r["k"]: r["uid"] for r in sound.collect()} == {k: u for k, u in want.items() if k % 5}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_listing_reads_no_content(spark, tmp_path, capsys):
    for name in ("a/x.JPG", "a/b/y.png", "a/Old/z.png", "old.png", "t.txt", "a/no_extension", "a/tmp/q.jpg/inner.gif"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    found = files.listing(spark, str(tmp_path), (".jpg", ".PNG"), ("old",))
    assert sorted((r["name"], r["bytes"]) for r in found.collect()) == [("a/b/y.png", 5), ("a/x.JPG", 5), ("old.png", 5)]
    found.explain()
    plan = capsys.readouterr().out
    assert "length:bigint" in plan and "content:binary" not in plan
    assert files.listing(spark, str(tmp_path)).count() == 7


def test_inventory_takes_the_files_own_times(spark, tmp_path):
    for k, (name, size) in enumerate({"a/1": 1_000_000, "a/2": 2_000_000, "a/3": 1, "b/1": 10}.items()):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
        os.utime(tmp_path / name, (1_000_000 + 2 * k, 1_000_000 + 2 * k))
    found = files.listing(spark, str(tmp_path)).select(F.get(F.split("name", "/"), F.lit(0)).alias("dataset"), "bytes", "modified")
    rows = {r["dataset"]: r for r in paths.inventory(found).collect()}
    assert (rows["a"]["files"], rows["a"]["bytes"], rows["a"]["seconds"], rows["a"]["mb_per_s"]) == (3, 3_000_001, 4.0, 0.75)
    assert (rows["b"]["files"], rows["b"]["seconds"], rows["b"]["mb_per_s"]) == (1, 0.001, 0.01)


def test_gates_pass_or_fail_the_job(spark):
    rows = spark.createDataFrame([("u1", "g1", [1.0, 2.0]), ("u2", "g2", [1.0, float("nan")]), ("u3", None, None)], "uid string, generator string, v array<double>")
    none, tagged = rows.where("uid = 'x'"), spark.createDataFrame([("g2",), ("g9",)], "generator string")
    assert gates.gate(rows, none, "rule").count() == 3
    assert gates.gate(none, none, "rule").count() == 0
    assert gates.excluded(rows.where("uid <> 'u2'"), tagged, "generator", "evaluation source").count() == 2
    assert gates.disjoint(rows, rows.where("uid = 'u1'").select("generator"), tagged, "shared").count() == 3
    assert gates.covered(rows, rows.select("uid"), "uid").count() == 3
    assert gates.present(rows, tagged.where("generator = 'g2'"), "generator", "absent").count() == 3
    assert gates.measured(rows.where("uid = 'u1'"), "v", 2).count() == 1
    broken = {
        "evaluation source.*u2": gates.excluded(rows, tagged, "generator", "evaluation source"), "shared.*g2": gates.disjoint(rows, rows.select("generator"), tagged, "shared"), "rows without a match.*u9": gates.covered(rows, spark.createDataFrame([("u9",)], "uid string"), "uid"),
        "absent.*g9": gates.present(rows, tagged, "generator", "absent"), "unexpected width.*u2": gates.measured(rows, "v", 2), "empty too": gates.gate(none, rows, "empty too"),
    }
    for message, df in broken.items():
        with pytest.raises(Exception, match=f"(?s){message}"):
            df.collect()


def test_leaking_splits_do_not_pass(spark):
    sound = [("a", 1, "g1", "train", 1), ("b", 1, "g2", "val", 2), ("c", 0, "real:x", "val", 3), ("d", 0, "real:x", "logo", 4), ("e", 1, "g3", "logo", 5)]
    kind = "uid string, label int, generator string, split string, sig long"
    for more, rule in (([], None), ([("f", 1, "g1", "val", 9)], "train_val_generators"), ([("f", 1, "g3", "train", 9)], "train_logo_generators"), ([("f", 1, "g9", "train", 4)], "train_logo_signatures")):
        rows = spark.createDataFrame(sound + more, kind)
        gated = gates.gate(rows, splits.leakage(rows).where("violations > 0"), "leaking split")
        if rule is None:
            assert gated.count() == 5
        else:
            with pytest.raises(Exception, match=f"(?s)leaking split.*{rule}"):
                gated.collect()


def test_sketches_are_saved_read_and_merged(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"s{rng.randrange(8)}", f"v{rng.randrange(60_000)}", None) for _ in range(120_000)]
    df = spark.createDataFrame(rows, "shard string, v string, nothing string").repartition(5)
    sketches.shard_sketches(df, ["shard"], {"v": F.col("v"), "nothing": F.col("nothing")}).write.parquet(f"{tmp_path}/kept")
    kept = spark.read.parquet(f"{tmp_path}/kept")
    exact = {s: len({v for t, v, _ in rows if t == s}) for s in {r[0] for r in rows}}
    got = {r["shard"]: r for r in sketches.estimates(kept, ["v", "nothing"]).collect()}
    assert all(abs(got[s]["v"] - n) <= sketches.error_bound() * n and got[s]["nothing"] == 0 for s, n in exact.items())
    halves = sketches.merged(kept.withColumn("half", F.col("shard") < "s4"), ["half"], ["v"])
    whole = sketches.estimates(sketches.merged(halves.withColumn("one", F.lit(1)), ["one"], ["v"]), ["v"]).first()["v"]
    n = len({r[1] for r in rows})
    assert abs(whole - n) <= sketches.error_bound() * n
    assert whole == sketches.estimates(sketches.shard_sketches(df.withColumn("one", F.lit(1)), ["one"], {"v": F.col("v")}), ["v"]).first()["v"]


def test_absent_columns_give_the_next_choice(spark):
    df = spark.createDataFrame([(2.0, 5.0, 0.5, 3.0, 0.0, 1.0, None, None)], "a double, b double, share double, mu_a double, sd_a double, mu_b double, mu_c double, c double").withColumn("sd_b", F.lit(2.0)).withColumn("sd_c", F.lit(None).cast("double"))
    z = lambda chain, raw=(): df.select(features.signal_z(df, chain, raw).alias("z")).first()["z"]
    assert z([["a", "b"]]) == (3.0 + 2.0) / 2
    assert z([["b", "missing"]]) == 2.0
    assert z([["missing"], ["b"]]) == 2.0
    assert z([["missing"], ["gone"]], ("nowhere", "share")) == 1.5
    assert z([["missing"]]) == 0.0
    assert z([["b", "c"], ["a"]]) == 2.0
    assert z([["c"], ["b"]]) == 0.0


def test_scoring_hook_equals_the_models_own(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 5))
    rows = [(i, int(x[i, 0] > 0), x[i].tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, y int, v array<double>").repartition(4)
    model = LogisticRegression(labelCol="y", regParam=0.01).fit(df.withColumn("features", array_to_vector("v")))
    want = {r["id"]: r["p"] for r in model.transform(df.withColumn("features", array_to_vector("v"))).select("id", F.get(vector_to_array("probability"), F.lit(1)).alias("p")).collect()}
    odd = df.union(spark.createDataFrame([(900, 0, None), (901, 1, [1.0]), (902, 1, [None] * 5)], df.schema))
    got = {r["id"]: r["p"] for r in models.batch_scores(odd, models.loader(model), 5, batch=64).collect()}
    assert len(got) == 303 and got[900] is None and got[901] is None and got[902] is None
    assert all(abs(got[i] - p) < 1e-6 for i, p in want.items())
    assert models.batch_scores(df.limit(0), models.loader(model), 5).count() == 0


def test_perceptron_stops_by_held_out_rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(240, 4))
    df = spark.createDataFrame([(i, int(x[i, 0] * x[i, 1] > 0), x[i].tolist()) for i in range(240)], "id long, y int, v array<double>").withColumn("features", array_to_vector("v"))
    model, rounds, auc = models.perceptron(df.where("id < 160"), df.where("id >= 160"), [4, 16, 2], rounds=6, iterations=10)
    assert 1 <= rounds <= 6 and auc > 0.8 and model.weights.size == 4 * 16 + 16 + 16 * 2 + 2


def near(a, b, k=4):
    return a is not None and b is not None and bin((a ^ b) & (2**64 - 1)).count("1") <= k


def test_dedup_of_null_and_repeated_ids(spark):
    """keep_first and the greedy passes keep one row a row; see their docstrings for nulls."""
    rng = random.Random(8)
    base = [rng.getrandbits(63) for _ in range(12)]
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, *base]) if rng.random() < 0.4 else rng.choice(base) ^ (1 << rng.randrange(60))) for _ in range(150)]
    df = spark.createDataFrame([(d, s, "x") for d, s in rows], "doc_id long, sig long, low string").repartition(4)
    got = sorted(((r["doc_id"], r["sig"], r["kept"]) for r in dedup.keep_first(df).collect()), key=str)
    want = [(d, s, not any(e is not None and near(s, t) and (d is None or e < d) for e, t in rows)) for d, s in rows]
    assert got == sorted(want, key=str)
    out = dedup.greedy_passes(df).collect()
    assert sorted(((r["doc_id"], r["sig"]) for r in out), key=str) == sorted(rows, key=str)
    assert all(r["kept"] for r in out if r["sig"] is None)
    left = [(r["doc_id"], r["sig"]) for r in out if r["kept"] and r["sig"] is not None]
    band = lambda s, k: s >> 16 * k & 0xFFFF
    assert not any(near(s, t) and any(band(s, k) == band(t, k) for k in range(4)) for i, (_, s) in enumerate(left) for _, t in left[:i])
    assert dedup.greedy_passes(df.limit(0)).count() == 0 and dedup.keep_first(df.limit(0)).count() == 0


def test_features_only_weights_equal_newton(spark):
    """Weights of the clipped, train-scaled features against a plain fit of the same optimum."""
    from test_operators import newton

    from millrace.plans import bindings
    from millrace.plans import models as plans

    data = "/root/testdata/sf0.01"
    f = bindings.features(spark, data).toPandas().sort_values("doc_id")
    x, train = f[bindings.FEATURES].to_numpy(), (f["doc_id"] % 5 > 1).to_numpy()
    sd = x[train].std(0)
    z = np.clip((x - x[train].mean(0)) / np.where(sd < 1e-8, 1.0, sd), -10, 10)[train]
    w = newton((z - z.mean(0)) / z.std(0, ddof=1), f["label"].to_numpy()[train], 1 / train.sum())
    got = {r["feature"]: (r["rank"], r["weight"]) for r in plans.m2_weights(spark, data).collect()}
    names = [c.removeprefix("f_") for c in bindings.FEATURES]
    assert np.allclose([got[n][1] for n in names], w[:-1], atol=2e-3)
    assert sorted(names, key=lambda n: got[n][0]) == [names[i] for i in np.argsort(-np.abs([got[n][1] for n in names]))]
