"""A shared codebook of colours: k-means in CIELAB over a bounded sample of pixels, then every pixel to its nearest centre."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.raster import lab_parts

#: Pixels that the codebook is fitted on, at most about.
SAMPLE = 100_000


def lab(pixels: DataFrame) -> DataFrame:
    """pixels (img, y, x, r, g, b) with `lab`, an array of L, a and b."""
    x, y, z = (F.col(c) for c in ("fx", "fy", "fz"))
    return lab_parts(pixels).withColumn("lab", F.array(116 * y - 16, (x - y) * 500, (y - z) * 200)).drop("fx", "fy", "fz")


def codebook(pixels: DataFrame, k: int = 8, sample: int = SAMPLE, seed: int = 42) -> np.ndarray:
    """At most k centres (L, a, b), in order, fitted on the pixels of smallest hash; as many as there are different colours drawn."""
    many, steps = pixels.count(), 1 << 20
    if not many:
        return np.empty((0, 3))
    drawn = lab(pixels.where(F.pmod(F.xxhash64("img", "y", "x", F.lit(seed)), F.lit(steps)) < max(1, min(steps, sample * steps // many))))
    rows = drawn.select(array_to_vector("lab").alias("features"))
    if len(rows.distinct().head(k)) < k:  # k-means needs k different points
        return np.unique(np.array([r[0].toArray() for r in rows.distinct().head(k)] or [[50.0, 0.0, 0.0]]), axis=0)
    return np.unique(np.array(KMeans(k=k, seed=seed, maxIter=20).fit(rows).clusterCenters()), axis=0)


def nearest(point: Column, centres: np.ndarray) -> Column:
    """Number of the nearest centre, ties to the first."""
    far = [sum(((F.get(point, F.lit(j)) - float(c)) ** 2 for j, c in enumerate(centre)), F.lit(0.0)) for centre in centres]
    return F.array_min(F.array(*[F.struct(F.round(d, 9).alias("d"), F.lit(k).alias("k")) for k, d in enumerate(far)]))["k"]


def palettes(pixels: DataFrame, centres: np.ndarray) -> DataFrame:
    """(img, color_entropy, dominant, dominant_share, dominant_l, dominant_a, dominant_b): bits of the image's shares of the
    centres, and the commonest (ties to the first). One aggregate by image."""
    coded = lab(pixels).select("img", nearest(F.col("lab"), centres).alias("code"))
    counts = coded.groupBy("img").agg(F.count("*").alias("n"), *[F.count_if(F.col("code") == k).alias(f"n{k}") for k in range(len(centres))])
    share = [F.col(f"n{k}") / F.col("n") for k in range(len(centres))]
    bits = sum((F.when(s > 0, -s * F.log2(s)).otherwise(0.0) for s in share), F.lit(0.0))
    top = F.array_min(F.array(*[F.struct((-F.col(f"n{k}")).alias("n"), F.lit(k).alias("k")) for k in range(len(centres))]))
    chosen = counts.select("img", F.round(bits, 6).alias("color_entropy"), top["k"].alias("dominant"), F.round(-top["n"] / F.col("n"), 6).alias("dominant_share"))
    value = lambda j: F.get(F.array(*[F.lit(float(c[j])) for c in centres]), F.col("dominant"))
    return chosen.select("*", *[F.round(value(j), 6).alias(f"dominant_{n}") for j, n in enumerate("lab")])
