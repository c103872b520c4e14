"""Image features of small grey tiles, one array of pixels a row: no pixel ever leaves its row.

Neighbours are read through index arrays worked out beforehand, so filters, co-occurrences and
perturbations are column expressions without a shuffle.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.scratch import cut

SIDE = 8
#: Side of the grid that signatures take images to.
GRID = 32
GAUSS_5 = [(dy, dx, math.exp(-(dy * dy + dx * dx) / (2 * 1.5**2))) for dy in range(-2, 3) for dx in range(-2, 3)]
SOBEL_X = [(dy, dx, float(w)) for dy, row in zip((-1, 0, 1), ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1)), strict=True) for dx, w in zip((-1, 0, 1), row, strict=True) if w]
SOBEL_Y = [(dx, dy, w) for dy, dx, w in SOBEL_X]
GAUSS_9 = [(dy, dx, math.exp(-(dy * dy + dx * dx) / 2)) for dy in range(-4, 5) for dx in range(-4, 5)]
GAUSS_3 = [(dy, dx, math.exp(-(dy * dy + dx * dx) / (2 * 0.8**2))) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
ANGLES = {0: (0, 1), 45: (-1, 1), 90: (-1, 0), 135: (-1, -1)}


def mirrored(k: int, side: int = SIDE) -> int:
    k = abs(k)
    return k if k < side else 2 * (side - 1) - k


def tile_rows(pixels: DataFrame) -> DataFrame:
    """(img, v): pixel rows (img, y, x, v) as one row-major array of doubles an image."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    return pixels.groupBy("img").agg(cells.alias("c")).select("img", F.transform("c", lambda p: p["v"].cast("double")).alias("v"))


def normalized(taps: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    total = sum(w for _, _, w in taps)
    return [(dy, dx, w / total) for dy, dx, w in taps]


def filtered(v: Column, taps: list[tuple[int, int, float]], side: int = SIDE) -> Column:
    """The tile under a linear filter with mirrored borders."""
    lookup = [F.array(*[F.lit(mirrored(y + dy, side) * side + mirrored(x + dx, side)) for y in range(side) for x in range(side)]) for dy, dx, _ in taps]

    def at(i: Column) -> Column:
        total = F.lit(0.0)
        for (_, _, w), index in zip(taps, lookup, strict=True):
            total = total + F.get(v, F.get(index, i)) * w
        return total

    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), at)


def mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)


def deviation(v: Column) -> Column:
    m = mean(v)
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(v))


def energy(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) / F.size(v)


def pixel_stats(tiles: DataFrame) -> DataFrame:
    v = F.transform("v", lambda x: x / 255.0)
    return tiles.select("img", v.alias("v")).select("img", F.round(mean(F.col("v")), 6).alias("mean"), F.round(deviation(F.col("v")), 6).alias("std"))


def residual(tiles: DataFrame, taps: list[tuple[int, int, float]]) -> DataFrame:
    """Tiles minus their smoothed selves."""
    return tiles.withColumn("s", filtered(F.col("v"), normalized(taps))).select("img", F.zip_with("v", "s", lambda a, b: a - b).alias("v"))


def blurred(tiles: DataFrame, taps: list[tuple[int, int, float]]) -> DataFrame:
    return tiles.select("img", filtered(F.col("v"), normalized(taps)).alias("v"))


def moments(tiles: DataFrame) -> DataFrame:
    v = F.col("v")
    return tiles.select("img", F.round(mean(v), 6).alias("mean"), F.round(deviation(v), 6).alias("std"), F.round(energy(v), 6).alias("energy"))


def gradients(tiles: DataFrame, threshold: float = 150.0) -> DataFrame:
    """Mean and deviation of the Sobel magnitude, and the share at or above a threshold."""
    m = tiles.withColumn("gx", filtered(F.col("v"), SOBEL_X)).withColumn("gy", filtered(F.col("v"), SOBEL_Y)).select("img", F.zip_with("gx", "gy", lambda a, b: F.sqrt(a * a + b * b)).alias("v"))
    share = F.size(F.filter("v", lambda x: x >= threshold)) / F.size("v")
    return m.select("img", F.round(mean(F.col("v")), 6).alias("sobel_mean"), F.round(deviation(F.col("v")), 6).alias("sobel_std"), F.round(share, 6).alias("gradient_density"))


def spectrum(tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """Shares of the magnitude spectrum inside and outside a disc of radius side // 8, and their ratio."""
    half, radius = side // 2, side // 8

    def magnitude(u: int, w: int) -> Column:
        parts = []
        for f in (math.cos, math.sin):
            basis = F.array(*[F.lit(f(2 * math.pi * (u * y + w * x) / side)) for y in range(side) for x in range(side)])
            parts.append(F.aggregate(F.zip_with("v", basis, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))
        return F.sqrt(parts[0] * parts[0] + parts[1] * parts[1])

    low, high = F.lit(0.0), F.lit(0.0)
    for u in range(side):
        for w in range(side):
            far = math.hypot((u + half) % side - half, (w + half) % side - half) > radius
            low, high = (low, high + magnitude(u, w)) if far else (low + magnitude(u, w), high)
    t = tiles.select("img", low.alias("low"), high.alias("high"))
    total = F.col("low") + F.col("high") + 1e-8
    return t.select("img", F.round(F.col("high") / total, 6).alias("fft_high"), F.round(F.col("low") / total, 6).alias("fft_low"), F.round(F.col("high") / (F.col("low") + 1e-8), 6).alias("fft_ratio"))


def cooccurrence(tiles: DataFrame, levels: int = 64, side: int = SIDE) -> DataFrame:
    """Grey-level co-occurrence at distance 1: contrast, energy, homogeneity and correlation, averaged over four angles.

    A row's pairs are counted in the row: sums over pairs need no counts, and the energy is the sum over pairs of how many are equal to them.
    """
    step = 256 // levels
    g = F.transform("v", lambda x: F.floor(x / step).cast("int"))
    t = tiles.select("img", g.alias("g"))
    for angle, (dy, dx) in ANGLES.items():
        places = [(y * side + x, (y + dy) * side + x + dx) for y in range(side) for x in range(side) if 0 <= y + dy < side and 0 <= x + dx < side]
        index = F.array(*[F.lit(p * side * side + q) for a, b in places for p, q in ((a, b), (b, a))])
        n = side * side
        t = t.withColumn(f"c{angle}", F.array_sort(F.transform(index, lambda i: F.get("g", F.floor(i / n).cast("int")) * levels + F.get("g", (i % n).cast("int")))))
    found = []
    for angle in ANGLES:
        c, size = F.col(f"c{angle}"), F.size(f"c{angle}").cast("double")
        total = lambda f, c=c: F.aggregate(c, F.lit(0.0), lambda a, x: a + f(F.floor(x / levels).cast("double"), (x % levels).cast("double")))
        runs = F.aggregate(c, F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sum")), lambda a, x: F.struct(x.alias("last"), F.when(x == a["last"], a["run"] + 1).otherwise(1).cast("long").alias("run"), (a["sum"] + F.when(x == a["last"], 2 * a["run"] + 1).otherwise(1)).cast("long").alias("sum")))
        mu = total(lambda i, j: i) / size
        var, cov = total(lambda i, j: i * i) / size - mu * mu, total(lambda i, j: i * j) / size - mu * mu
        found.append(F.struct(
            (total(lambda i, j: (i - j) * (i - j)) / size).alias("contrast"), (F.sqrt(runs["sum"].cast("double")) / size).alias("energy"),
            (total(lambda i, j: 1 / (1 + (i - j) * (i - j))) / size).alias("homogeneity"), F.when(var < 1e-15, F.lit(1.0)).otherwise(cov / var).alias("correlation"),
        ))
    names = ("contrast", "energy", "homogeneity", "correlation")
    return t.select("img", F.array(*found).alias("f")).select("img", *[F.round(F.aggregate(F.col(f"f.{c}"), F.lit(0.0), lambda a, x: a + x) / len(ANGLES), 6).alias(c) for c in names])


def palette(tiles: DataFrame, codes: int = 8) -> DataFrame:
    """Shannon entropy (bits) and the commonest code of a fixed grid of grey levels."""
    width = 256 // codes
    c = tiles.select("img", F.explode("v").alias("v")).groupBy("img", F.floor(F.col("v") / width).alias("code")).agg(F.count("*").alias("n"))
    total = F.sum("n")
    entropy = F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total
    return c.groupBy("img").agg(F.round(entropy, 6).alias("entropy"), F.min_by("code", F.struct(-F.col("n"), F.col("code"))).alias("dominant"))


def salted(tiles: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """Salt and pepper on the round(share x pixels) pixels of smallest hash: the first half white, the rest black. The pattern is the same for all images."""
    n = SIDE * SIDE
    many = round(n * share)
    order = sorted(range(n), key=lambda i: int(hashlib.md5(f"{i}:{seed}".encode()).hexdigest()[:15], 16))
    place = F.array(*[F.lit(order.index(i)) for i in range(n)])
    hit = lambda v, p: F.when(p < many // 2, F.lit(255.0)).when(p < many, F.lit(0.0)).otherwise(v)
    return tiles.select("img", F.zip_with("v", place, hit).alias("v"))


def cosines(side: int = SIDE, grid: int = GRID) -> list[list[float]]:
    """Weights of `side` pixels, spread over `grid`, in the first eight cosine frequencies."""
    spread = grid // side
    return [[sum(math.cos(math.pi * u * (2 * (spread * y + r) + 1) / (2 * grid)) for r in range(spread)) for y in range(side)] for u in range(8)]


def signature(tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """(img, sig): 64 bits, one for each of the 8 x 8 lowest cosine coefficients of the tile on a grid of 32 x 32: whether it's above their median.

    The first coefficient is the highest bit. Near copies (other brightness, light blur) differ in few bits (`images.signature` is
    the same for images of any size).
    """
    of = cosines(side)
    basis = [F.array(*[F.lit(of[u][y] * of[w][x]) for y in range(side) for x in range(side)]) for u in range(8) for w in range(8)]
    dot = lambda b: F.round(F.aggregate(F.zip_with("v", b, lambda p, q: p * q), F.lit(0.0), lambda a, x: a + x), 4)
    c = tiles.select("img", F.array(*[dot(b) for b in basis]).alias("c")).withColumn("s", F.array_sort("c"))
    c = c.select("img", "c", ((F.get("s", F.lit(31)) + F.get("s", F.lit(32))) / 2).alias("m"))
    bit = lambda x: F.when(x > F.col("m"), F.lit(1)).otherwise(0).cast("long")
    return c.select("img", F.aggregate("c", F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(bit(x))).alias("sig"))


def sensor_noise(tiles: DataFrame) -> DataFrame:
    """Relative residual of a Gaussian of deviation 1, less its own 3 x 3 blur, as tiles. Each filter is cut by a checkpoint, or the next would work it out anew at every tap."""
    smooth = tiles.withColumn("s", filtered(F.col("v"), normalized(GAUSS_9)))
    relative = smooth.select("img", F.zip_with("v", "s", lambda a, b: (a / 255.0 - b / 255.0) / (a / 255.0 + 1e-3)).alias("v"))
    return cut(residual(cut(relative), GAUSS_3))


def autocorrelation_peak(tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """(img, peak): the largest absolute circular autocorrelation off the origin, by that at it."""
    m = mean(F.col("v"))
    z = tiles.select("img", F.transform("v", lambda x: x - m).alias("v"))
    dot = lambda index: F.aggregate(F.zip_with("v", F.transform(index, lambda i: F.get("v", i)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    shifts = [F.array(*[F.lit((y + dy) % side * side + (x + dx) % side) for y in range(side) for x in range(side)]) for dy in range(side) for dx in range(side)]
    peak = F.array_max(F.array(*[F.abs(dot(i)) for i in shifts[1:]]))
    return z.select("img", F.round(peak / (dot(shifts[0]) + 1e-8), 6).alias("peak"))


def lab_parts(pixels: DataFrame) -> DataFrame:
    """pixels (img, y, x, r, g, b) with fx, fy, fz, from which CIELAB's axes are differences."""
    linear = lambda c: F.when(F.col(c) / 255.0 <= 0.04045, F.col(c) / 255.0 / 12.92).otherwise(F.pow((F.col(c) / 255.0 + 0.055) / 1.055, F.lit(2.4)))
    r, g, b = (linear(c) for c in "rgb")
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16.0 / 116.0)
    return pixels.select("*", f((r * 0.412453 + g * 0.357580 + b * 0.180423) / 0.950456).alias("fx"), f(r * 0.212671 + g * 0.715160 + b * 0.072169).alias("fy"), f((r * 0.019334 + g * 0.119193 + b * 0.950227) / 1.088754).alias("fz"))


def chroma(pixels: DataFrame) -> DataFrame:
    """(img, chroma_mean, chroma_std, chroma_p90) of pixel rows (img, y, x, r, g, b): CIELAB chroma by 181."""
    p = lab_parts(pixels)
    c = p.select("img", (F.sqrt(F.pow((F.col("fx") - F.col("fy")) * 500, F.lit(2.0)) + F.pow((F.col("fy") - F.col("fz")) * 200, F.lit(2.0))) / 181.0).alias("c"))
    return c.groupBy("img").agg(F.round(F.avg("c"), 6).alias("chroma_mean"), F.round(F.stddev_pop("c"), 6).alias("chroma_std"), F.round(F.percentile("c", F.lit(0.9)), 6).alias("chroma_p90"))


def channel_stats(pixels: DataFrame) -> DataFrame:
    """(img, mean and deviation of each channel, brightness) of pixel rows (img, y, x, r, g, b), in units of 255."""
    unit = lambda c: F.col(c) / 255.0
    means, deviations = ([F.round(f(unit(c)), 6).alias(f"{n}_{c}") for c in "rgb"] for n, f in (("mean", F.avg), ("std", F.stddev_pop)))
    return pixels.groupBy("img").agg(*means, *deviations, F.round(F.avg((unit("r") + unit("g") + unit("b")) / 3), 6).alias("brightness"))


def colours(pixels: DataFrame, width: int = 64) -> DataFrame:
    """(img, palette_entropy, dominant_r, dominant_g, dominant_b, hue_std): bits of a fixed grid of colours, the middle of its commonest cell, the deviation of the hue (0 to 1) of pixels that have one."""
    side = 256 // width
    cell = sum((F.floor(F.col(c) / width) * side**k for k, c in enumerate("bgr")), F.lit(0))
    counts = pixels.groupBy("img", cell.alias("code")).agg(F.count("*").alias("n"))
    total = F.sum("n")
    entropy = F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total
    palettes = counts.groupBy("img").agg(F.round(entropy, 6).alias("palette_entropy"), F.min_by("code", F.struct(-F.col("n"), F.col("code"))).alias("code"))
    middle = lambda k: (F.expr(f"code div {side**k} % {side}") * width + width // 2).cast("double")
    most, least = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    span = most - least
    turn = F.when(most == F.col("r"), F.pmod((F.col("g") - F.col("b")) / span, F.lit(6.0))).when(most == F.col("g"), (F.col("b") - F.col("r")) / span + 2).otherwise((F.col("r") - F.col("g")) / span + 4)
    hues = pixels.groupBy("img").agg(F.round(F.coalesce(F.stddev_pop(F.when(span > 0, turn / 6)), F.lit(0.0)), 6).alias("hue_std"))
    return palettes.join(hues, "img").select("img", "palette_entropy", middle(2).alias("dominant_r"), middle(1).alias("dominant_g"), middle(0).alias("dominant_b"), "hue_std")
