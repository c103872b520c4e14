"""Checks inside the plan: rows go through a gate, or the job fails with a sample of what is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 5


def gate(rows: DataFrame, violations: DataFrame, rule: str, sample: int = SAMPLE) -> DataFrame:
    """rows, unchanged, if `violations` is empty; else the job that reads them fails with the rule, and the first few violations.

    Nothing runs before the result is read: the check is a subquery of the plan, and at most `sample` rows of it reach
    the driver, in its message. The check is made even where rows is empty.
    """
    named = violations.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in violations.columns])).alias("v"))
    message = F.concat(F.lit(f"{rule}: "), F.array_join(F.array_sort(F.collect_list("v")), ", "))
    broken = named.limit(sample).agg(F.when(F.count("*") > 0, message).alias("m"))
    passed = broken.select(F.when(F.col("m").isNotNull(), F.raise_error(F.col("m")).cast("boolean")).otherwise(True).alias("gate passed"))
    return rows.where(passed.scalar())


def covered(rows: DataFrame, wanted: DataFrame, key: str, rule: str = "rows without a match") -> DataFrame:
    """wanted's rows, if every key of `wanted` is in `rows`."""
    return gate(wanted, wanted.join(rows.select(key), key, "left_anti").select(key), rule)


def disjoint(rows: DataFrame, left: DataFrame, right: DataFrame, rule: str) -> DataFrame:
    """rows, if left and right (of one column) have no value in common; nulls count as values."""
    return gate(rows, left.intersect(right), rule)


def excluded(rows: DataFrame, tagged: DataFrame, key: str, rule: str) -> DataFrame:
    """rows, if none of them has a key of `tagged`."""
    return gate(rows, rows.join(tagged.select(key), key, "left_semi"), rule)


def measured(rows: DataFrame, column: str, size: int, rule: str = "unexpected width") -> DataFrame:
    """rows, if the arrays of `column` all have `size` finite numbers; null arrays don't."""
    sound = F.coalesce((F.size(column) == size) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return gate(rows, rows.where(~sound).select([c for c in rows.columns if c != column] + [F.size(column).alias(f"size of {column}")]), rule)


def present(rows: DataFrame, wanted: DataFrame, key: str, rule: str) -> DataFrame:
    """rows, if each key of `wanted` occurs in them."""
    return gate(rows, wanted.select(key).join(rows.select(key), key, "left_anti"), rule)
