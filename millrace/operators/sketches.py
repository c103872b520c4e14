"""Distinct counts by mergeable sketches: one sketch a shard is kept, and unions of them answer for any set of shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of a sketch's registers; the estimate's relative standard error is 0.83 / sqrt(2^LOG_K).
LOG_K = 12


def error_bound(log_k: int = LOG_K, deviations: float = 3.0) -> float:
    """Relative error that `deviations` standard errors allow."""
    return deviations * 0.83 / (1 << log_k) ** 0.5


def shard_sketches(rows: DataFrame, shard: list[str], values: dict[str, Column], log_k: int = LOG_K) -> DataFrame:
    """One row per shard, with a binary sketch of the distinct values of each of `values`; nulls aren't counted.

    Partial sketches of a few kilobytes are merged, so no task holds a shard's values.
    """
    return rows.groupBy(*shard).agg(*[F.hll_sketch_agg(c, log_k).alias(n) for n, c in values.items()])


def merged(sketches: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Sketches of the union of all shards of each group, to be merged further or estimated."""
    return sketches.groupBy(*by).agg(*[F.hll_union_agg(n).alias(n) for n in names])


def estimates(sketches: DataFrame, names: list[str]) -> DataFrame:
    return sketches.select(*[c for c in sketches.columns if c not in names], *[F.hll_sketch_estimate(n).alias(n) for n in names])
