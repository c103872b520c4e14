"""Balanced label propagation: shards of equal row counts that keep linked documents together."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Scratch, bucket, map_texts, salted_rank
from millrace.llm.jaccard import shingles

ROUNDS = 4
SHINGLE = 5
#: Texts that share so many words in a row share a key.
PASSAGE = 50
#: Rows a bucket, where groups are ranked or summed in buckets.
ROWS = 200_000


def prefix_sum(df: DataFrame, group: list[str], unit: str, weight: str, name: str, buckets: int = 64) -> DataFrame:
    """Add `name`: the sum of `weight` before each row of its group, by salted buckets; no task holds a group."""
    d = df.withColumn("_b", bucket([unit], buckets))
    keys = [*group, "_b"]
    before = Window.partitionBy(*group or [F.lit(0)]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = d.groupBy(*keys).agg(F.sum(weight).alias("_w")).withColumn("_o", F.coalesce(F.sum("_w").over(before), F.lit(0))).drop("_w")
    inside = Window.partitionBy(*keys).orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("_i", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(offsets, keys).withColumn(name, F.col("_o") + F.col("_i")).drop("_b", "_i", "_o")


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row; of all, where there are fewer."""
    width, have = min(width, len(h)), 1
    while have < width:
        step = min(have, width - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h


def link_keys(text: bytes) -> list[int]:
    """Hashes of five-word shingles: the least in each passage of 50 words, and the text's four least; none for fewer words.

    The same passage has the same least shingle in every text, so texts that share one always share a key; a text
    has about one key in 24 words, as passages side by side mostly have one least shingle.
    """
    if len(text.split(None, SHINGLE - 1)) < SHINGLE:
        return []
    h = shingles(text)
    return np.union1d(least_of(h, PASSAGE - SHINGLE + 1), np.unique(h)[:4]).tolist()


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, unit, keys) of every row of docs: `unit` is the text's md5, `keys` its link keys. One pass, no shuffle."""

    def rows(part: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in part:
            t = text or b""
            yield doc_id, len(t) + 16, zlib.crc32(t), hashlib.md5(t).hexdigest(), link_keys(t)

    return map_texts(docs, ["doc_id"], rows, T._parse_datatype_string("doc_id long, size long, text_crc32 long, unit string, keys array<long>"))


def cut_share(members: DataFrame, labels: DataFrame) -> float:
    """Share of the links between keys and units that leave the shard in which their key weighs most."""
    per = members.join(labels, "unit").groupBy("key", "label").agg(F.sum("n").alias("w")).groupBy("key").agg(F.sum("w").alias("all"), F.max("w").alias("main"))
    r = per.agg(F.sum("all").alias("all"), F.sum("main").alias("main")).first()
    return 1 - r["main"] / r["all"] if r["all"] else 0.0


def propagate(scratch: Scratch, units: DataFrame, members: DataFrame, shards: int, capacity: int, rounds: int) -> DataFrame:
    """Labels of units (unit, n) after `rounds` of moves: rows (unit, n, label).

    members (unit, key): units that share a key are neighbours. In a round every key counts its weight
    in each shard (one row for each key and shard, however many units), offers the shard with the most
    weight times free share, and each unit asks for its heaviest key's offer. Requests beyond a shard's
    free capacity are thinned by a hash of unit and round. Only the shards' loads, one number a shard,
    come to the driver.
    """
    labels = scratch.save(units.withColumn("label", bucket(["unit"], shards)), "labels-0")
    for k in range(1, rounds + 1):
        load = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        free = [max(0, capacity - load.get(s, 0)) for s in range(shards)]
        room = F.array(*[F.lit(f / max(1, capacity)) for f in free])
        held = members.join(labels, "unit")
        weights = held.groupBy("key", "label").agg(F.sum("n").alias("w"))
        score = F.col("w") * (F.lit(0.05) + F.element_at(room, F.col("label") + 1))
        offers = weights.groupBy("key").agg(F.max_by(F.struct("label", "w"), F.struct(score, -F.col("label"))).alias("o")).select("key", "o.label", "o.w")
        asks = members.join(offers, "key").groupBy("unit").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("to"))
        asked = scratch.save(labels.join(asks, "unit", "left"), f"asked-{k}")
        moves = asked.where("to <> label")
        sums = {r["to"]: r["n"] for r in moves.groupBy("to").agg(F.sum("n").alias("n")).collect()}
        admit = F.array(*[F.lit(min(1.0, free[s] / sums[s]) if sums.get(s) else 0.0) for s in range(shards)])
        drawn = F.pmod(F.xxhash64("unit", F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
        moved = F.col("to").isNotNull() & (F.col("to") != F.col("label")) & (drawn < F.element_at(admit, F.col("to") + 1))
        labels = scratch.save(asked.select("unit", "n", F.when(moved, F.col("to")).otherwise(F.col("label")).alias("label")), f"labels-{k}")
        scratch.drop(f"asked-{k}", f"labels-{k - 1}")
    return labels


def shard(docs: DataFrame, shards: int = 40, rounds: int = ROUNDS) -> DataFrame:
    """Put every row of docs (doc_id, text) into one of `shards` shards whose row counts differ by at most one.

    Returns doc_id, size, text_crc32, law ("rows"), shard, slot (0, 1, ... in each shard) and grown_shard
    (null: only the key law has it). A null text counts as empty. Equal texts are one unit and move
    together; units that share 50 words in a row anywhere, or one of their four least five-word shingles, are neighbours (`link_keys`). After label propagation, units
    that fit their shard stay; the rest, texts with more copies than a shard holds, and texts without
    neighbours are laid out in one line, copies side by side, and cut at the shards' free places. So equal
    texts are split only where a count forces it. Repeated rows and null ids are placed like any row;
    other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    buckets = max(64, docs.count() // ROWS)
    rows = scratch.save(described(docs).withColumn("b", bucket(["doc_id"], buckets)), "rows")
    cells = scratch.save(rows.groupBy("unit", "b").agg(F.count("*").alias("c"), F.any_value("keys").alias("keys")), "cells")
    units = scratch.save(cells.groupBy("unit").agg(F.sum("c").alias("n"), F.any_value("keys").alias("keys")), "units")
    total = units.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    members = units.where(F.col("n") <= quota[-1]).select("unit", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").drop("m")
    members = scratch.save(members.join(shared, "key"), "members")
    linked = units.join(members.select("unit").distinct(), "unit", "left_semi")
    linked = linked.select("unit", "n").union(units.where((F.col("n") > 1) & (F.col("n") <= quota[-1])).join(members, "unit", "left_anti").select("unit", "n"))
    labels = propagate(scratch, linked, members, shards, quota[-1], rounds)
    stay = scratch.save(prefix_sum(labels, ["label"], "unit", "n", "at", buckets).withColumn("fits", F.col("at") + F.col("n") <= F.element_at(F.array(*map(F.lit, quota)), F.col("label") + 1)), "stay")
    kept = stay.where("fits").select("unit", F.col("label").alias("home"))
    filled = {r["home"]: r["n"] for r in stay.where("fits").groupBy(F.col("label").alias("home")).agg(F.sum("n").alias("n")).collect()}
    pool = scratch.save(prefix_sum(units.join(kept, "unit", "left_anti").select("unit", "n"), [], "unit", "n", "at", buckets), "pool")
    ends_at, bound = 0, []
    for s in range(shards):
        ends_at += quota[s] - filled.get(s, 0)
        bound.append(ends_at)
    placed = kept.withColumn("at", F.lit(None).cast("long")).union(pool.select("unit", F.lit(None).cast("int"), "at"))
    before = Window.partitionBy("unit").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    where = cells.select("unit", "b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("o")).join(placed, "unit").select("unit", "b", "home", (F.col("at") + F.col("o")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("unit", "b").orderBy("doc_id")) - 1
    line = F.size(F.filter(F.array(*map(F.lit, bound)), lambda e: e <= F.col("at") + F.col("r")))
    out = rows.drop("keys").withColumn("r", rank).join(where, ["unit", "b"]).withColumn("shard", F.coalesce("home", line).cast("int"))
    out = scratch.save(out.select("doc_id", "size", "text_crc32", "shard", "unit"), "placed")
    scratch.drop("rows", "cells", "units", "members", "stay", "pool")
    slots = salted_rank(out, ["shard"], ["doc_id", "unit"], "slot", 4 * buckets)
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
