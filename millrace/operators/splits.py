"""Leakage-free splits: caps, group allocation, balance, held-out families and assertions.

Random orders are hashes of the key and a seed, so results do not depend on partitions. Ranks in large
groups are taken within ranges of the hash first, so no task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import portable_hash
from millrace.operators.running import null_safe
from millrace.sources.scratch import cut


def hash_rank(df: DataFrame, group: list[str], key: str, seed: int | str, name: str = "rank") -> DataFrame:
    """Add the 0-based rank of the key's hash within its group: ranks in 4,096 ranges of the hash, plus the rows before.

    Null groups are a group, rows without a key come last in theirs, and rows of equal key follow each other in any order. Every
    row stays.
    """
    d = df.withColumn("hash of key", F.coalesce(portable_hash(F.col(key), seed), F.lit(1 << 60))).withColumn("range of", F.shiftright("hash of key", 48))
    keys = [*group, "range of"]
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("range of").rowsBetween(Window.unboundedPreceding, -1)
    offset = d.groupBy(*keys).agg(F.count("*").alias("n in")).select(*keys, F.coalesce(F.sum("n in").over(before), F.lit(0)).alias("n before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("hash of key", key)) - 1
    ranked = null_safe(d.withColumn("rank in", inside), offset, keys)
    return ranked.withColumn(name, F.col("rank in") + F.col("n before")).drop("hash of key", "range of", "rank in", "n before")


def with_total(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a one-row aggregate of df to each of its rows."""
    return df.crossJoin(F.broadcast(df.agg(value.alias(name))))


def capped(df: DataFrame, group: str, key: str, share: int, seed: int | str) -> DataFrame:
    """Add `over`: beyond the first cap = max(1, rows / share) rows of its group, in hash order."""
    r = with_total(hash_rank(df, [group], key, seed, "rank in group"), F.greatest(F.lit(1), F.floor(F.count("*") / share)), "cap of group")
    return r.withColumn("over", F.col("rank in group") >= F.col("cap of group")).drop("rank in group", "cap of group")


def allocated(df: DataFrame, group: str, percent: int, seed: int | str) -> DataFrame:
    """(group, n, chosen): whole groups in hash order, chosen while the rows before are under percent of all."""
    g = df.groupBy(group).agg(F.count("*").alias("n")).withColumn("_h", portable_hash(F.col(group), seed))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_h", group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy())
    return g.select(group, "n", (before * 100 < total * percent).alias("chosen"))


def balanced(df: DataFrame, label: str, key: str, seed: int | str) -> DataFrame:
    """Add `over`: beyond the size of the smaller class (0 or 1), in hash order within its class. A null label is a class of its own, cut alike."""
    sizes = df.agg(F.least(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("size of class"))
    ranked = hash_rank(df, [label], key, seed, "rank in class").crossJoin(F.broadcast(sizes))
    return ranked.withColumn("over", F.col("rank in class") >= F.col("size of class")).drop("rank in class", "size of class")


def held_out(groups: DataFrame, families: dict[str, list[str]], most: int = 3, tagged: str = "commercial") -> DataFrame:
    """(family, generator, n): of each family in turn, its largest unused generators.

    groups (generator, n, tagged): one row a generator. A family's generators contain one of its
    patterns, in any case; the family named `tagged` takes those with the flag instead. Ties go by name.
    """
    chosen: DataFrame | None = None
    free = groups.where(~F.col("generator").startswith("real:"))
    for family, patterns in families.items():
        hit = F.col("tagged") if family == tagged else F.exists(F.array(*map(F.lit, patterns)), lambda p: F.contains(F.lower("generator"), p))
        rank = F.row_number().over(Window.orderBy(F.desc("n"), "generator"))
        rows = free.where(hit)
        if chosen is not None:
            rows = rows.join(chosen, "generator", "left_anti")
        rows = rows.withColumn("k", rank).where(F.col("k") <= most).select(F.lit(family).alias("family"), "generator", "n")
        chosen = rows if chosen is None else chosen.unionByName(rows)
    return chosen


def split_corpus(rows: DataFrame, families: dict[str, list[str]], share: int = 50, percent: int = 15) -> DataFrame:
    """The full split job over rows (uid, label, generator, kept): adds `split`.

    dropped_dup; logo (held-out families); capped_out (a generator's rows beyond 1/share of the fakes);
    reals, if they are one group, at random to logo and val, percent each, else by whole groups to val;
    whole fake groups to val; balanced_out; train. Each step is read several times, so it is cut by a checkpoint.
    """
    rows = cut(rows.select("uid", "label", "generator", "kept"))
    live = rows.where("kept")
    groups = live.groupBy("generator").agg(F.count("*").alias("n")).withColumn("tagged", F.lit(False))
    logo = held_out(groups, families).select("generator", F.lit(True).alias("out"))
    s = live.join(F.broadcast(logo), "generator", "left").withColumn("out", F.coalesce("out", F.lit(False)))
    fakes, reals = s.where("label = 1 and not out"), s.where("label = 0")
    cap = cut(capped(fakes, "generator", "uid", share, "cap"))
    pool = cap.where("not over")
    to_val = allocated(pool, "generator", percent, "groups").select("generator", "chosen")
    fake_side = cap.join(F.broadcast(to_val), "generator", "left").withColumn("split", F.when(F.col("over"), "capped_out").when(F.col("chosen"), "val").otherwise("train"))
    ranked = with_total(hash_rank(reals, [], "uid", "reals"), F.count("*"), "_n").crossJoin(F.broadcast(reals.agg(F.count_distinct("generator").alias("_g"))))
    each = F.floor(F.col("_n") * percent / 100)
    real_val = allocated(reals, "generator", percent, "groups").select("generator", F.col("chosen").alias("_v"))
    single = F.when(F.col("rank") < each, "logo").when(F.col("rank") < 2 * each, "val").otherwise("train")
    real_side = ranked.join(F.broadcast(real_val), "generator", "left").withColumn("split", F.when(F.col("_g") < 2, single).when(F.col("_v"), "val").otherwise("train"))
    columns = ["uid", "label", "generator", "split"]
    parts = fake_side.select(columns).unionByName(real_side.select(columns)).unionByName(s.where("label = 1 and out").withColumn("split", F.lit("logo")).select(columns))
    parts = cut(parts)
    train = balanced(parts.where("split = 'train'"), "label", "uid", "balance").withColumn("split", F.when(F.col("over"), "balanced_out").otherwise("train")).select(columns)
    rest = parts.where("split <> 'train'")
    return train.unionByName(rest).unionByName(rows.where("not kept").withColumn("split", F.lit("dropped_dup")).select(columns))


def leakage(rows: DataFrame) -> DataFrame:
    """(rule, violations) over rows (uid, label, generator, split, sig): all zero where the split is sound."""
    fake = lambda s: rows.where((F.col("split") == s) & ~F.col("generator").startswith("real:")).select("generator").distinct()
    sig = lambda s: rows.where(F.col("split") == s).select("sig").distinct()
    none = lambda s: rows.agg((F.count_if((F.col("split") == s) & (F.col("label") == 0)) == 0).cast("long").alias("violations"))
    count = lambda df: df.agg(F.count("*").alias("violations"))
    rules = {
        "train_val_generators": count(fake("train").intersect(fake("val"))), "train_logo_generators": count(fake("train").intersect(fake("logo"))), "val_logo_generators": count(fake("val").intersect(fake("logo"))),
        "train_logo_signatures": count(sig("train").intersect(sig("logo"))), "val_without_reals": none("val"), "logo_without_reals": none("logo"),
    }
    out: DataFrame | None = None
    for rule, df in rules.items():
        row = df.select(F.lit(rule).alias("rule"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


def assert_sound(rows: DataFrame) -> None:
    broken = leakage(rows).where("violations > 0").collect()
    if broken:
        raise AssertionError(f"leaking split: {[tuple(r) for r in broken]}")


def require_coverage(wanted: DataFrame, have: DataFrame, key: str) -> None:
    """Raise, with a sample, if any wanted key has no row."""
    missing = wanted.join(have, key, "left_anti").select(key)
    sample = missing.limit(5).collect()
    if sample:
        raise ValueError(f"{missing.count()} rows without features, such as {[r[0] for r in sample]}")
