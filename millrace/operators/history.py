"""Run-history analytics: last-k means, best epochs, early stopping and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_k(df: DataFrame, metric: str, k: int = 5) -> DataFrame:
    """Mean and population deviation of the last k epochs, and the deviation of all, by tag."""
    back = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("epoch")))
    d = df.select("tag", metric, (back <= k).alias("late"))
    late = F.when(F.col("late"), F.col(metric))
    return d.groupBy("tag").agg(F.round(F.avg(late), 6).alias("last_mean"), F.round(F.stddev_pop(late), 6).alias("last_std"), F.round(F.stddev_pop(metric), 6).alias("all_std"))


def best_epoch(df: DataFrame, metric: str) -> DataFrame:
    """The first epoch of the largest value, by tag; null values are never the best, and both columns are null where all are."""
    there = F.when(F.col(metric).isNotNull(), F.struct(-F.col(metric), F.col("epoch")))
    return df.groupBy("tag").agg(F.min_by("epoch", there).alias("best_epoch"), F.max(metric).alias("best"))


def running_best(df: DataFrame, metric: str, min_delta: float = 0.0) -> DataFrame:
    """Each epoch's best before it, and whether it improves on it by more than min_delta; a null value improves on nothing."""
    before = Window.partitionBy("tag").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(metric).over(before)
    return df.withColumn("best_before", best).withColumn("improved", F.col(metric).isNotNull() & F.coalesce(F.col(metric) > F.col("best_before") + min_delta, F.lit(True)))


def early_stop(df: DataFrame, metric: str, patience: int) -> DataFrame:
    """The first epoch that ends `patience` epochs without improvement (null if none), by tag."""
    order = Window.partitionBy("tag").orderBy("epoch")
    r = running_best(df, metric).withColumn("island", F.sum(F.col("improved").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    bad = F.row_number().over(Window.partitionBy("tag", "island").orderBy("epoch")) - 1
    return r.withColumn("bad", bad).groupBy("tag").agg(F.min(F.when(F.col("bad") >= patience, F.col("epoch"))).alias("stop_epoch"))


def selected(df: DataFrame, by: str, metric: str) -> DataFrame:
    """The epoch that `by` selects (the first of its largest) and its `metric`; null if any `by` is missing."""
    whole = F.count_if(F.col(by).isNull()) == 0
    row = F.min_by(F.struct("epoch", F.col(metric).alias("value")), F.struct(-F.col(by), F.col("epoch")))
    return df.groupBy("tag").agg(F.when(whole, row).alias("r")).select("tag", F.col("r.epoch").alias("epoch"), F.col("r.value").alias("value"))


def selection_stats(df: DataFrame, by: str, metric: str, k: int = 5) -> DataFrame:
    """One row a tag: the best, last and last-k values of `metric`, its deviations, and the epoch that `by` selects with both values there (null if any `by` is missing)."""
    late = last_k(df, metric, k).select("tag", F.col("last_mean").alias("last5_mean"), F.col("last_std").alias("last5_sd"), F.col("all_std").alias("all_sd"))
    best = best_epoch(df, metric).select("tag", F.col("best").alias("best_logo"), F.col("best_epoch").alias("best_logo_epoch"))
    final = df.groupBy("tag").agg(F.max_by(metric, "epoch").alias("final_logo"))
    chosen = selected(df, by, metric).select("tag", F.col("epoch").alias("val_selected_epoch"), F.col("value").alias("val_selected_logo"))
    value = df.groupBy("tag").agg(F.when(F.count_if(F.col(by).isNull()) == 0, F.max(by)).alias("val_selected_val"))
    out = best
    for part in (final, late, chosen, value):
        out = out.join(part, "tag")
    return out


def family(df: DataFrame) -> DataFrame:
    """Adds the arm's family and variant name to runs (frozen, head, feature_dim, lr)."""
    kind = F.when(F.col("feature_dim") > 0, "fusion").otherwise(F.col("head"))
    name = F.concat(F.when(F.col("frozen"), "frozen").otherwise("unfrozen"), F.lit("_"), kind, F.lit("_lr"), F.when(F.col("lr") < 5e-4, "1e-4").otherwise("1e-3"))
    return df.withColumn("family", kind).withColumn("variant", name)


def fusion_pairs(runs: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Each fusion arm with its MLP control: same backbone state and learning rate."""
    named = family(runs)
    key = F.round(F.col("lr") / tolerance).cast("long")
    side = lambda kind, name: named.where(F.col("family") == kind).select("frozen", key.alias("lr_key"), F.col("tag").alias(name))
    return side("fusion", "fusion").join(side("mlp", "control"), ["frozen", "lr_key"]).drop("lr_key")
