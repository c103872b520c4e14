"""Paths, labels by convention, and image geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import basename, extension, portable_hash, stem

#: Folder names and label spellings that imply a class, - and space written _.
AI_FOLDERS = ("ai_generated", "aiartdata", "ai_art", "ai", "fake", "generated", "aiart")
REAL_FOLDERS = ("non_ai_generated", "realart", "real_art", "real", "human", "nonai", "humanart")
AI_LABELS = ("1", "ai", "ai_generated", "aigenerated", "fake", "generated")
REAL_LABELS = ("0", "real", "non_ai_generated", "nonai", "human", "authentic")
IMAGE_TYPES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif")
CROP = 256


def label_from_path(path: Column) -> Column:
    """1 or 0 by the first part, from the root, that implies a class; null if none does."""
    parts = F.transform(F.split(path, "/"), lambda p: F.regexp_replace(F.lower(p), "[ -]", "_"))
    classes = F.transform(parts, lambda p: F.when(p.isin(*AI_FOLDERS), 1).when(p.isin(*REAL_FOLDERS), 0))
    return F.get(F.filter(classes, lambda c: c.isNotNull()), F.lit(0))


def label_from_text(raw: Column) -> Column:
    key = F.lower(F.trim(raw))
    return F.when(key.isin(*AI_LABELS), 1).when(key.isin(*REAL_LABELS), 0)


def resolved_labels(files: DataFrame, csv: DataFrame, declared: Column) -> DataFrame:
    """files (path) with `label`: a declared folder's; else, where none is declared at all, the path's; else the csv's by name, else by stem.

    csv (id, label, row): later rows win.
    """
    by_key = csv.where("label is not null").select(F.explode(F.array(F.struct(basename(F.col("id")).alias("key"), F.lit(0).alias("s")), F.struct(stem(F.col("id")).alias("key"), F.lit(1).alias("s")))).alias("e"), "label", "row")
    keys = by_key.groupBy("e.key").agg(F.max_by("label", F.struct("row", "e.s")).alias("l"))
    named = keys.select(F.col("key").alias("name"), F.col("l").alias("by_name"))
    stems = keys.select(F.col("key").alias("st"), F.col("l").alias("by_stem"))
    f = files.withColumn("name", basename(F.col("path"))).withColumn("st", stem(F.col("path"))).withColumn("declared", declared)
    return f.join(named, "name", "left").join(stems, "st", "left").withColumn("label", F.coalesce("declared", label_from_path(F.col("path")), "by_name", "by_stem"))


def collision_names(files: DataFrame, group: str) -> DataFrame:
    """Adds `link`: the base name, and for its k-th repeat in the group, in path order, stem__k.ext."""
    name = basename(F.col("path"))
    k = F.row_number().over(Window.partitionBy(group, "name").orderBy("path", "page_id")) - 1
    suffix = F.regexp_extract("name", r"(\.[^.]+)$", 1)
    renamed = F.concat(stem(F.col("name")), F.lit("__"), F.col("k").cast("string"), suffix)
    return files.withColumn("name", name).withColumn("k", k).withColumn("link", F.when(F.col("k") == 0, F.col("name")).otherwise(renamed))


def listed(files: DataFrame, types: tuple[str, ...], excluded: tuple[str, ...] = ()) -> DataFrame:
    """Files of the given extensions, in any case, outside the excluded folders."""
    inside = F.exists(F.split("path", "/"), lambda p: p.isin(*excluded)) if excluded else F.lit(False)
    return files.where(extension(F.col("path")).isin(*types) & ~inside)


def crop_plan(sizes: DataFrame, seed: int = 42) -> DataFrame:
    """(uid, was_padded, pads, offset): reflect-pad to CROP, then a crop whose offset is drawn from the uid."""
    pad = lambda s: F.greatest(F.lit(0), F.floor((F.lit(CROP) - F.col(s) + 1) / 2))
    rest = lambda s: F.greatest(F.lit(0), F.lit(CROP) - F.col(s) - pad(s))
    room = lambda s: F.greatest(F.col(s), F.lit(CROP)) - CROP
    draw = lambda axis, s: F.pmod(portable_hash(F.concat("uid", F.lit(axis)), seed), room(s) + 1)
    return sizes.select(
        "uid", ((F.col("w") < CROP) | (F.col("h") < CROP)).alias("was_padded"), pad("w").cast("long").alias("pad_l"), rest("w").cast("long").alias("pad_r"),
        pad("h").cast("long").alias("pad_t"), rest("h").cast("long").alias("pad_b"), draw("x", "w").alias("x"), draw("y", "h").alias("y"),
    )


def resize_plan(sizes: DataFrame) -> DataFrame:
    """(uid, new_w, new_h, left, top): the shorter side to CROP (halves to even), then a centre crop."""
    scaled = lambda s: F.greatest(F.lit(CROP), F.bround(F.col(s) * (F.lit(float(CROP)) / F.least("w", "h"))).cast("long"))
    r = sizes.select("uid", scaled("w").alias("new_w"), scaled("h").alias("new_h"))
    return r.select("*", F.expr(f"(new_w - {CROP}) div 2").alias("left"), F.expr(f"(new_h - {CROP}) div 2").alias("top"))


def inventory(files: DataFrame) -> DataFrame:
    """(dataset, files, bytes, gb, seconds, mb_per_s) of files (dataset, bytes, modified): the time from the first file written to the last, a millisecond at least."""
    seconds = F.greatest(F.max(F.unix_micros("modified")) - F.min(F.unix_micros("modified")), F.lit(1000)) / 1e6
    mb = F.sum("bytes") / 1e6
    return files.groupBy("dataset").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.round(F.sum("bytes") / 1e9, 9).alias("gb"), seconds.alias("seconds"), F.round(mb / seconds, 6).alias("mb_per_s"))
