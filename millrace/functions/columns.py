"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def portable_hash(key: Column, seed: int | str) -> Column:
    """60 bits of md5(key:seed) as a long: a random order that does not depend on partitions or row order."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 15), 16, 10).cast("long")


def share(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def r6(c: Column) -> Column:
    return F.round(c, 6)


def sanitized(c: Column) -> Column:
    """NaN, infinities and null become 0."""
    d = c.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(0.0)).otherwise(d)


def error_type(y: Column, pred: Column) -> Column:
    return F.when(y == pred, "correct").when((y == 0) & (pred == 1), "false_positive").otherwise("false_negative")


def confidence_bucket(confidence: Column, high: float = 0.8) -> Column:
    return F.when(confidence >= high, "high").otherwise("low")


def class_name(label: Column) -> Column:
    return F.when(label == 1, "AI-Generated").otherwise("Real")


def softmax(logits: Column) -> Column:
    """Softmax of an array of logits, shifted by its largest."""
    top = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def l2_normalized(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / norm)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(signature: Column, widths: tuple[int, ...] = (16, 16, 16, 16)) -> Column:
    """Array of structs (no, value): the signature's bands from the low bits up."""
    out, at = [], 0
    for k, w in enumerate(widths):
        value = F.shiftrightunsigned(signature, at).bitwiseAND(F.lit((1 << w) - 1))
        out.append(F.struct(F.lit(k).alias("no"), value.alias("value")))
        at += w
    return F.array(*out)


def norm_generator(label: Column, model: Column, source: Column) -> Column:
    """real:<source> for real rows, the model's name for others; unknown where blank."""
    real = F.concat(F.lit("real:"), F.lower(F.coalesce(F.nullif(F.trim(source), F.lit("")), F.lit("unknown"))))
    return F.when(label == 0, real).otherwise(F.coalesce(F.nullif(F.trim(model), F.lit("")), F.lit("unknown")))


def signal_bucket(z: Column) -> Column:
    """(score, label) of an absolute z score: clip(z/3) to 4 places; high from 2, medium from 1."""
    score = F.round(F.least(F.greatest(z / 3.0, F.lit(0.0)), F.lit(1.0)), 4)
    label = F.when(z >= 2, "high").when(z >= 1, "medium").otherwise("low")
    return F.struct(score.alias("score"), label.alias("label"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]+$", "")


def parent(path: Column, k: int) -> Column:
    """The k-th folder above the file; "" if there is none."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.coalesce(F.get(parts, F.size(parts) - 1 - k), F.lit(""))
