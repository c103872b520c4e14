"""Running sums and exact quantiles over a value in groups of any size: no task holds a whole group.

Values are cut into ranges by a fixed increasing function; the ranges' sums, some ten thousand rows a group at
most, give each range its start, and windows run inside (group, range) alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 1024
NONE = -(1 << 31)


def value_range(v: Column) -> Column:
    """Ranges of a number: STEPS for each doubling of its size, on either side of zero."""
    size = F.floor(F.log2(F.greatest(F.abs(v), F.lit(1e-300))) * STEPS) + 1100 * STEPS
    return F.coalesce(F.when(v < 0, -size).when(v > 0, size).otherwise(0), F.lit(NONE)).cast("int")


def score_range(p: Column) -> Column:
    """Ranges of a score: fine near 0 and near 1, where confident models crowd."""
    return F.when((p > 0.5) & (p <= 1), 3000 * STEPS - value_range(1 - p)).when(p > 1, 3000 * STEPS + value_range(p)).otherwise(value_range(p)).cast("int")


def null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a joined with b on keys, where null equals null; b's keys go."""
    named = b.select(*[F.col(k).alias(f"{k} of b") if k in keys else F.col(k) for k in b.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k} of b"))
    return a.join(named, same).drop(*[f"{k} of b" for k in keys])


def running_sums(df: DataFrame, keys: list[str], value: str, sums: dict[str, str], totals: dict[str, str], ranges: Column, descending: bool = False) -> DataFrame:
    """df with running sums of columns (sums: column -> new name) in order of `value`, the row included, and totals by key (totals: column -> new name). Each (keys, value) must be one row."""
    order = F.desc if descending else F.asc
    d = df.withColumn("range of", ranges)
    cells = [*keys, "range of"]
    before = Window.partitionBy(*keys).orderBy(order("range of")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    held = d.groupBy(*cells).agg(*[F.sum(c).alias(f"{c} in") for c in {**sums, **totals}])
    starts = held.select(*cells, *[F.coalesce(F.sum(f"{c} in").over(before), F.lit(0)).alias(f"{c} before") for c in sums], *[F.sum(f"{c} in").over(whole).alias(n) for c, n in totals.items()])
    inside = Window.partitionBy(*cells).orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    ran = d.select("*", *[F.sum(c).over(inside).alias(f"{c} within") for c in sums])
    joined = null_safe(ran, starts, cells)
    return joined.select(*df.columns, *[(F.col(f"{c} before") + F.col(f"{c} within")).alias(n) for c, n in sums.items()], *totals.values())


def exact_quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(keys, names of `at`): exact quantiles with linear interpolation of the values that are not null; groups without values have no row."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("of value"))
    c = running_sums(counts, keys, value, {"of value": "up to"}, {"of value": "in all"}, value_range(F.col(value)))
    place = {n: (F.col("in all") - 1) * q for n, q in at.items()}
    holds = lambda k: (F.col("up to") > k) & (F.col("up to") - F.col("of value") <= k)
    picked = c.groupBy(*keys).agg(
        F.max("in all").alias("in all"), *[F.max(F.when(holds(F.floor(p)), F.col(value))).alias(f"{n} low") for n, p in place.items()], *[F.max(F.when(holds(F.ceil(p)), F.col(value))).alias(f"{n} high") for n, p in place.items()]
    )
    part = lambda p: p - F.floor(p)
    return picked.select(*keys, *[(F.col(f"{n} low") + (F.col(f"{n} high") - F.col(f"{n} low")) * part(p)).alias(n) for n, p in place.items()])
