"""Score analytics: confusion counts, threshold metrics, ranking metrics and calibration, all native.

Ranking metrics reduce the scores to a histogram by distinct score; running sums over it are taken inside
ranges of the score (`running`), so neither the rows nor the distinct scores of one model land in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import share
from millrace.operators.running import exact_quantiles, null_safe, running_sums, score_range

METRICS = ["accuracy", "balanced_accuracy", "precision_ai", "recall_ai", "f1_ai", "precision_real", "recall_real", "f1_real", "f1_macro", "mcc", "fpr", "fnr"]


def long_scores(df: DataFrame, models: dict[str, str], keep: list[str]) -> DataFrame:
    """(keep..., tag, y, p): one row for each sample and model; models maps tags to score columns."""
    pairs = F.array(*[F.struct(F.lit(t).alias("tag"), F.col(c).alias("p")) for t, c in models.items()])
    return df.select(*keep, F.explode(pairs).alias("m")).select(*keep, "m.tag", "m.p")


def confusion(df: DataFrame, keys: list[str], threshold: float | Column = 0.5) -> DataFrame:
    """tn, fp, fn, tp by key; a row is positive at p >= threshold. Rows without y or p count nowhere."""
    hit = F.col("p") >= threshold
    count = lambda c: F.count_if(c)
    return df.groupBy(*keys).agg(
        count((F.col("y") == 0) & ~hit).alias("tn"), count((F.col("y") == 0) & hit).alias("fp"), count((F.col("y") == 1) & ~hit).alias("fn"), count((F.col("y") == 1) & hit).alias("tp")
    )


def threshold_metrics(counts: DataFrame) -> DataFrame:
    """Twelve metrics from tn, fp, fn, tp; 0 where a denominator is 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    recall, tnr, precision, npv = share(tp, tp + fn), share(tn, tn + fp), share(tp, tp + fp), share(tn, tn + fn)
    f1, f0 = share(2 * tp, 2 * tp + fp + fn), share(2 * tn, 2 * tn + fp + fn)
    values = {
        "accuracy": share(tp + tn, tp + tn + fp + fn), "balanced_accuracy": (recall + tnr) / 2, "precision_ai": precision, "recall_ai": recall, "f1_ai": f1,
        "precision_real": npv, "recall_real": tnr, "f1_real": f0, "f1_macro": (f1 + f0) / 2,
        "mcc": share(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), "fpr": share(fp, fp + tn), "fnr": share(fn, fn + tp),
    }
    return counts.select("*", *[F.round(v, 6).alias(k) for k, v in values.items()])


def histogram(df: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives by key and distinct score; rows without y or a score are left out, a key that has no others too."""
    return df.where("y is not null and p is not null and not isnan(p)").groupBy(*keys, "p").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))


def cumulative(hist: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp at each distinct score as threshold, and the totals n_pos, n_neg."""
    return running_sums(hist, keys, "p", {"pos": "tp", "neg": "fp"}, {"pos": "n_pos", "neg": "n_neg"}, score_range(F.col("p")), descending=True)


def roc_auc(df: DataFrame, keys: list[str]) -> DataFrame:
    """Tie-aware area under the ROC curve (Mann-Whitney, ties half); null for one class."""
    c = cumulative(histogram(df, keys), keys)
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("pos") * F.col("neg") / 2.0)
    return c.groupBy(*keys).agg(F.round(F.try_divide(won, F.first("n_pos").cast("double") * F.first("n_neg")), 6).alias("auc"))


def average_precision(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of recall steps times precision over distinct thresholds; null without positives."""
    c = cumulative(histogram(df, keys), keys)
    steps = F.sum(F.col("pos") * share(F.col("tp"), F.col("tp") + F.col("fp")))
    return c.groupBy(*keys).agg(F.round(F.try_divide(steps, F.first("n_pos").cast("double")), 6).alias("ap"))


def ranking(df: DataFrame, keys: list[str]) -> DataFrame:
    """auc, ap, brier, n, n_ai and the majority share by key, from one histogram."""
    c = cumulative(histogram(df, keys), keys)
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("pos") * F.col("neg") / 2.0)
    steps = F.sum(F.col("pos") * share(F.col("tp"), F.col("tp") + F.col("fp")))
    p = F.col("p")
    P, N = F.first("n_pos").cast("double"), F.first("n_neg").cast("double")
    return c.groupBy(*keys).agg(
        F.round(F.try_divide(won, P * N), 6).alias("auc"), F.round(F.try_divide(steps, P), 6).alias("ap"),
        F.round(F.sum(F.col("pos") * (p - 1) * (p - 1) + F.col("neg") * p * p) / (P + N), 6).alias("brier"),
        (F.first("n_pos") + F.first("n_neg")).alias("n"), F.first("n_pos").alias("n_ai"), F.round(F.greatest(P, N) / (P + N), 6).alias("majority"),
    )


def best_f1(df: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct threshold of the largest F1 (the lowest, if several) and its confusion counts."""
    c = cumulative(histogram(df, keys), keys)
    f1 = share(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("n_pos"))
    row = F.struct(F.col("p").alias("threshold"), (F.col("n_neg") - F.col("fp")).alias("tn"), "fp", (F.col("n_pos") - F.col("tp")).alias("fn"), "tp")
    return c.groupBy(*keys).agg(F.min_by(row, F.struct(-F.round(f1, 12), F.col("p"))).alias("r")).select(*keys, "r.*")


def roc_points(df: DataFrame, keys: list[str]) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, and the start (0, 0) with a null threshold."""
    c = cumulative(histogram(df, keys), keys).select(*keys, F.col("p").alias("threshold"), F.round(share(F.col("fp"), F.col("n_neg")), 6).alias("fpr"), F.round(share(F.col("tp"), F.col("n_pos")), 6).alias("tpr"))
    start = df.select(*keys).distinct().select(*keys, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return c.unionByName(start)


def pr_points(df: DataFrame, keys: list[str]) -> DataFrame:
    """(threshold, precision, recall) at every distinct score, and the end (1, 0) with a null threshold."""
    c = cumulative(histogram(df, keys), keys).select(*keys, F.col("p").alias("threshold"), F.round(share(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(share(F.col("tp"), F.col("n_pos")), 6).alias("recall"))
    end = df.select(*keys).distinct().select(*keys, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return c.unionByName(end)


def calibration(df: DataFrame, keys: list[str], bins: int, least: int = 1, closed: str = "left") -> DataFrame:
    """Mean score and share of positives by equal bins of [0, 1].

    "left": bins hold their left edge and p = 1 falls in none; "right": they hold their right edge, and
    the first holds 0 too. Bins of fewer than `least` rows are left out.
    """
    p = F.col("p")
    k = F.floor(p * bins) + 1 if closed == "left" else F.greatest(F.ceil(p * bins), F.lit(1))
    binned = df.withColumn("bin", k.cast("int")).where(F.col("bin") <= bins)
    return binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("share_ai")).where(F.col("n") >= least)


def per_group_auc(df: DataFrame, keys: list[str], least: int = 20) -> DataFrame:
    """AUC and AP of each group of positives against all negatives of its key.

    Negatives matter only by how many lie at or above each positive score: one running sum by key, looked
    up by score, so they are never copied to the groups. Groups, and keys, with fewer than `least` rows give nothing.
    """
    above = cumulative(histogram(df, keys), keys).where("pos > 0").select(*keys, "p", F.col("neg").alias("ties"), "fp", "n_neg")
    own = df.where("y = 1").groupBy(*keys, "generator", "p").agg(F.count("*").alias("pos"))
    own = running_sums(own, [*keys, "generator"], "p", {"pos": "tp"}, {"pos": "n_fake"}, score_range(F.col("p")), descending=True)
    both = null_safe(own, above, [*keys, "p"]).where((F.col("n_fake") >= least) & (F.col("n_neg") >= least))
    won = F.sum(F.col("pos") * (F.col("n_neg") - F.col("fp") + F.col("ties") / 2.0))
    steps = F.sum(F.col("pos") * share(F.col("tp"), F.col("tp") + F.col("fp")))
    P, N = F.first("n_fake").cast("double"), F.first("n_neg").cast("double")
    return both.groupBy(*keys, "generator").agg(F.round(won / (P * N), 6).alias("auc"), F.round(steps / P, 6).alias("ap"), F.first("n_fake").alias("n_fake"))


def probability_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean, population deviation, median (exact), extremes and share above one half; 0 where there is none."""
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    out = df.groupBy(*keys).agg(F.count("p").alias("n"), z(F.avg("p")).alias("mean"), z(F.stddev_pop("p")).alias("std"), z(F.min("p")).alias("low"), z(F.max("p")).alias("high"), z(F.avg((F.col("p") > 0.5).cast("double"))).alias("share_ai"))
    return with_quantiles(out, exact_quantiles(df, keys, "p", {"median": 0.5}), keys, ["median"], z)


def with_quantiles(out: DataFrame, found: DataFrame, keys: list[str], names: list[str], shown) -> DataFrame:
    """out and the quantiles of its groups, as `shown` makes them; groups without values have nulls before that."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"q.{k}"))
    return out.alias("o").join(found.alias("q"), same, "left").select("o.*", *[shown(F.col(f"q.{n}")).alias(n) for n in names])
