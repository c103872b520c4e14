"""Feature tables: scalers, coverage joins, descriptions and anomaly signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import sanitized, signal_bucket
from millrace.operators.running import exact_quantiles, null_safe

#: Verdicts.
AI_VERDICTS = ("Strong AI likelihood", "Moderate AI likelihood", "Leaning AI, but the forensic cues are mixed")
REAL_VERDICTS = ("Strong authentic likelihood", "Likely authentic", "Mixed signals, manual review recommended")
LARGEST_Z = 3.0


def fit_scaler(df: DataFrame, columns: list[str], floor: float = 1e-6) -> DataFrame:
    """One row: mu_<c> and sd_<c> (population; 1 below the floor) of the sanitised columns."""
    clean = df.select(*[sanitized(F.col(c)).alias(c) for c in columns])
    sd = lambda c: F.when(F.stddev_pop(c) < floor, F.lit(1.0)).otherwise(F.stddev_pop(c))
    return clean.agg(*[F.avg(c).alias(f"mu_{c}") for c in columns], *[sd(c).alias(f"sd_{c}") for c in columns])


def standardized(df: DataFrame, scaler: DataFrame, columns: list[str], clip: float | None = None) -> DataFrame:
    """df with its columns scaled by a one-row scaler, and clipped to [-clip, clip] if given."""

    def scale(c: str) -> Column:
        z = (sanitized(F.col(c)) - F.col(f"mu_{c}")) / F.col(f"sd_{c}")
        return F.greatest(F.lit(-clip), F.least(F.lit(clip), z)) if clip is not None else z

    rest = [c for c in df.columns if c not in columns]
    return df.crossJoin(F.broadcast(scaler)).select(*rest, *[F.round(scale(c), 6).alias(c) for c in columns])


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, mean, std, low, q1, q2, q3, high): sample deviation and exact quartiles."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in columns])).alias("e")).select("e.*")
    out = long.groupBy("feature").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"), F.min("v").alias("low"), F.max("v").alias("high"))
    quartiles = exact_quantiles(long, ["feature"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return out.join(quartiles, "feature", "left").select("feature", "n", "mean", "std", "low", *[F.round(q, 6).alias(q) for q in ("q1", "q2", "q3")], "high")


def class_histograms(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """(feature, label, bin, n): equal bins over each class's own range, the last one closed. Nulls and NaN are in no bin."""
    long = df.select("label", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in columns])).alias("e")).select("label", "e.*").where("v is not null and not isnan(v)")
    span = long.groupBy("feature", "label").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    j = null_safe(long, span, ["feature", "label"])
    k = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins), F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1)).otherwise(1)
    return j.groupBy("feature", "label", k.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for all pairs of columns, in one aggregate."""
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 6).alias("r")) for a in columns for b in columns]).alias("m"))
    return row.select(F.explode("m").alias("e")).select("e.*")


def mean_abs_z(scaler: DataFrame | None, columns: list[str]) -> Column:
    """Mean of |z| over the columns; where a deviation is below 1e-6, 0 at the mean and LARGEST_Z elsewhere."""

    def z(c: str) -> Column:
        off = F.abs(F.col(c) - F.col(f"mu_{c}"))
        return F.when(F.col(f"sd_{c}") < 1e-6, F.when(off < 1e-6, F.lit(0.0)).otherwise(LARGEST_Z)).otherwise(off / F.col(f"sd_{c}"))

    total = F.lit(0.0)
    for c in columns:
        total = total + z(c)
    return total / len(columns)


def signal_z(df: DataFrame, chain: list[list[str]], raw: tuple[str, ...] = ()) -> Column:
    """Mean |z| over the first choice of `chain` of which any column exists in df (with its moments mu_, sd_); columns that don't exist, or have no value here or in the reference, are left out of the mean.

    With no choice present it is LARGEST_Z times the first of the `raw` columns that exists, or 0.
    """
    have = set(df.columns)
    for choice in chain:
        there = [c for c in choice if {c, f"mu_{c}", f"sd_{c}"} <= have]
        if there:
            off = {c: F.abs(F.col(c) - F.col(f"mu_{c}")) for c in there}
            z = [F.when(F.col(f"sd_{c}") < 1e-6, F.when(off[c] < 1e-6, F.lit(0.0)).when(off[c].isNotNull(), LARGEST_Z)).otherwise(off[c] / F.col(f"sd_{c}")) for c in there]
            total = sum((F.coalesce(x, F.lit(0.0)) for x in z), F.lit(0.0))
            return F.coalesce(F.try_divide(total, sum((x.isNotNull().cast("double") for x in z), F.lit(0.0))), F.lit(0.0))
    of = next((c for c in raw if c in have), None)
    return F.coalesce(F.col(of), F.lit(0.0)) * LARGEST_Z if of else F.lit(0.0)


def raw_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(f"mu_{c}") for c in columns], *[F.stddev_pop(c).alias(f"sd_{c}") for c in columns])


def with_signals(df: DataFrame, moments: DataFrame, signals: dict[str, list[str]]) -> DataFrame:
    """df with one struct (score, label) for each signal, from the mean |z| of its columns."""
    wide = df.crossJoin(F.broadcast(moments))
    return wide.select(*df.columns, *[signal_bucket(mean_abs_z(None, cs)).alias(name) for name, cs in signals.items()])


def verdict(predicted: Column, ai: Column, signals: list[str]) -> Column:
    """The report's verdict from the predicted class, the AI probability and the signals' structs."""
    high = sum((F.col(f"{s}.label") == "high").cast("int") for s in signals)
    raised = sum((F.col(f"{s}.label") != "low").cast("int") for s in signals)
    mean = sum(F.col(f"{s}.score") for s in signals) / len(signals)
    if_ai = F.when((ai >= 0.85) & (high >= 2), AI_VERDICTS[0]).when((ai >= 0.65) | (raised >= 2), AI_VERDICTS[1]).otherwise(AI_VERDICTS[2])
    if_real = F.when((ai <= 0.15) & (high == 0) & (mean < 0.35), REAL_VERDICTS[0]).when((ai <= 0.35) & (high <= 1), REAL_VERDICTS[1]).otherwise(REAL_VERDICTS[2])
    return F.when(predicted == 1, if_ai).otherwise(if_real)
