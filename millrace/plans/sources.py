"""Queries that write and read again through the sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import images
from millrace.plans import bindings as B
from millrace.plans.bindings import FEATURES, sql
from millrace.sources import files
from millrace.sources.scratch import temporary

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


CORPUS = sql("SELECT uid, dataset, label, generator FROM corpus", "corpus")


def corpus(spark, d) -> DataFrame:
    return B.corpus(spark, d).select("uid", "dataset", "label", "generator")


@query("s01_shard_scan", sql("SELECT uid, dataset, label, generator FROM corpus WHERE dataset IN (SELECT DISTINCT dataset FROM corpus ORDER BY dataset LIMIT 2)", "corpus"))
def s01(spark, d):
    """The first two of the sorted shards; each dataset is a shard here."""
    at = temporary(spark, "shards")
    corpus(spark, d).withColumn("shard", F.col("dataset")).repartition("shard").write.partitionBy("shard").parquet(at)
    return files.scan_shards(spark, at, ["uid", "dataset", "label", "generator"], limit=2)


@query("s02_pruned_scan", sql("SELECT uid, label FROM corpus", "corpus"))
def s02(spark, d):
    at = temporary(spark, "pruned")
    files.write_parquet(corpus(spark, d), at)
    return files.scan_shards(spark, at, ["uid", "label"])


@query("s05_feature_csv", sql(f"SELECT uid AS image_path, label, {', '.join(FEATURES)} FROM features WHERE f_digits<>0", "features"))
def s05(spark, d):
    """Texts without digits have a word in place of a number: bad rows, which the reader skips."""
    at = temporary(spark, "features")
    broken = B.features(spark, d).select("uid", "label", *[F.when(F.lit(c == "f_digits") & (F.col(c) == 0), "none").otherwise(F.col(c).cast("string")).alias(c) for c in FEATURES])
    files.write_csv(broken, at)
    return files.read_feature_csv(spark, at, FEATURES)


@query("s06_labels_csv", sql("SELECT uid AS id, CAST(label AS VARCHAR) AS label FROM corpus", "corpus"))
def s06(spark, d):
    at = temporary(spark, "labels")
    files.write_csv(corpus(spark, d).select(F.col("uid").alias("File_Name"), F.col("label").alias("CLASS"), F.col("dataset").alias("y")), at)
    return files.read_labels_csv(spark, at)


@query("s07_run_records", sql("SELECT tag, epoch, val_auc FROM history", "history"))
def s07(spark, d):
    """One nested record a file; drafts (by file prefix) and records without splits are skipped."""
    at = temporary(spark, "runs")
    h = B.history(spark, d).groupBy("tag").agg(F.sort_array(F.collect_list(F.struct("epoch", "val_auc"))).alias("history"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("prefix"), F.lit(n).alias("n")) for k, n in (("run-", 1), ("draft-", 1), ("bare-", None))])).alias("e")
    rows = h.select("tag", "history", kinds).select("tag", "history", "e.prefix", F.when(F.col("e.n").isNotNull(), F.struct("e.n")).alias("splits"))
    body = F.regexp_replace(F.to_json(F.struct("tag", "history", "splits")), ",", ",\n").cast("binary")
    files.write_files(rows.select(F.concat("prefix", "tag", F.lit(".json")).alias("name"), body.alias("body")), at).agg(F.count("*")).collect()
    schema = T._parse_datatype_string("tag string, history array<struct<epoch: int, val_auc: double>>, splits struct<n: int>")
    records = files.read_run_records(spark, at, schema, skip="draft-")
    return records.select("tag", F.explode("history").alias("h")).select("tag", "h.epoch", "h.val_auc")


@query("s08_parquet_round_trip", CORPUS)
def s08(spark, d):
    at = temporary(spark, "zstd")
    files.write_parquet(corpus(spark, d), at)
    return spark.read.parquet(at)


@query("s09_csv_round_trip", sql("SELECT tag, epoch, CASE WHEN epoch%3<>0 THEN val_auc END AS val_auc FROM history", "history"))
def s09(spark, d):
    at = temporary(spark, "csv")
    h = B.history(spark, d).select("tag", "epoch", F.when(F.col("epoch") % 3 != 0, F.col("val_auc")).alias("val_auc"))
    files.write_csv(h, at)
    return spark.read.schema("tag string, epoch int, val_auc double").option("header", True).csv(at)


@query("s10_json_round_trip", CORPUS)
def s10(spark, d):
    at = temporary(spark, "json")
    files.write_json(corpus(spark, d), at)
    return spark.read.schema("uid string, dataset string, label int, generator string").json(at)


IMAGES = "SELECT img, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM rgb GROUP BY img"


@query("s04_decode_images", sql("SELECT img, 'drop' AS mode, 8 AS height, 8 AS width, round(r,6) AS r, round(g,6) AS g, round(b,6) AS b FROM m WHERE img%17<>0 UNION ALL SELECT img, 'black', CASE WHEN img%17=0 THEN 1 ELSE 8 END, CASE WHEN img%17=0 THEN 1 ELSE 8 END, CASE WHEN img%17=0 THEN 0.0::DOUBLE ELSE round(r,6) END, CASE WHEN img%17=0 THEN 0.0::DOUBLE ELSE round(g,6) END, CASE WHEN img%17=0 THEN 0.0::DOUBLE ELSE round(b,6) END FROM m", raw=B.CTE["tiles"], rgb=B.CTE["rgb"], m=IMAGES))
def s04(spark, d):
    """PNG files, one in seventeen cut off: dropped, or black."""
    at = temporary(spark, "images")
    images.write_tiles(B.rgb_tiles(spark, d), at)
    out = None
    for mode in ("drop", "black"):
        found = files.read_images(spark, at, drop=mode == "drop")
        means = images.channel_means(found).select(F.regexp_extract("path", "([0-9]+)[.]png$", 1).cast("long").alias("img"), F.lit(mode).alias("mode"), "height", "width", "r", "g", "b")
        out = means if out is None else out.unionByName(means)
    return out
