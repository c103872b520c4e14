"""Features of image files of any size: one numpy kernel an image, in Arrow batches of Spark's image source.

The columns are those of the tile queries (`raster`), whose expressions and SQL check this kernel. No
pixel leaves its row; an image that can't be decoded is a row with `failed` set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.raster import ANGLES, GAUSS_3, GAUSS_5, GAUSS_9, GRID, SOBEL_X, SOBEL_Y, cosines, normalized
from millrace.sources import files

NAMES = sorted(
    "mean_r mean_g mean_b std_r std_g std_b brightness noise_mean noise_std noise_energy fft_high fft_low fft_ratio prnu_mean prnu_std prnu_energy prnu_fft_ratio prnu_peak "
    "contrast energy homogeneity correlation sobel_mean sobel_std gradient_density chroma_mean chroma_std chroma_p90 palette_entropy dominant_r dominant_g dominant_b hue_std".split()
)


def grey_of(rgb: np.ndarray) -> np.ndarray:
    """Luma of 8-bit pixels, rounded to a whole number."""
    return ((rgb.astype(np.int64) @ np.array([299, 587, 114]) + 500) // 1000).astype(np.float64)


def filtered(v: np.ndarray, taps: list[tuple[int, int, float]]) -> np.ndarray:
    """v under a linear filter with mirrored borders."""
    reach = max(max(abs(dy), abs(dx)) for dy, dx, _ in taps)
    wide = np.pad(v, reach, mode="reflect")
    high, across = v.shape
    return sum(w * wide[reach + dy : reach + dy + high, reach + dx : reach + dx + across] for dy, dx, w in taps)


def shares(v: np.ndarray) -> tuple[float, float]:
    """Sums of the magnitude spectrum inside and outside the disc of an eighth of the smaller side."""
    high, wide = v.shape
    size = np.abs(np.fft.fftshift(np.fft.fft2(v)))
    y, x = np.ogrid[:high, :wide]
    far = np.hypot(y - high // 2, x - wide // 2) > min(high, wide) // 8
    return float(size[~far].sum()), float(size[far].sum())


def sensor(grey: np.ndarray) -> dict[str, float]:
    unit = grey / 255.0
    z = (unit - filtered(unit, normalized(GAUSS_9))) / (unit + 1e-3)
    z = z - filtered(z, normalized(GAUSS_3))
    low, far = shares(z)
    centred = z - z.mean()
    around = np.fft.ifft2(np.abs(np.fft.fft2(centred)) ** 2).real
    peak = np.abs(around.ravel()[1:]).max(initial=0.0) / (around[0, 0] + 1e-8)
    return {"prnu_mean": z.mean(), "prnu_std": z.std(), "prnu_energy": (z * z).mean(), "prnu_fft_ratio": far / (low + 1e-8), "prnu_peak": peak}


def cooccurrence(grey: np.ndarray, levels: int = 64) -> dict[str, float]:
    g = (grey // (256 // levels)).astype(np.int64)
    high, wide = g.shape
    found = []
    for dy, dx in ANGLES.values():
        a = g[max(0, -dy) : high - max(0, dy), max(0, -dx) : wide - max(0, dx)].ravel()
        b = g[max(0, dy) : high - max(0, -dy), max(0, dx) : wide - max(0, -dx)].ravel()
        if not len(a):
            continue
        n = np.bincount(np.concatenate((a * levels + b, b * levels + a)), minlength=levels * levels).reshape(levels, levels)
        p = n / n.sum()
        i, j = np.ogrid[:levels, :levels]
        mu = (p * i).sum()
        var = (p * i * i).sum() - mu * mu
        found.append(((p * (i - j) ** 2).sum(), np.sqrt((p * p).sum()), (p / (1 + (i - j) ** 2)).sum(), 1.0 if var < 1e-15 else ((p * i * j).sum() - mu * mu) / var))
    return dict(zip(("contrast", "energy", "homogeneity", "correlation"), np.mean(found or [(0.0, 1.0, 1.0, 1.0)], axis=0), strict=True))


def chroma(rgb: np.ndarray) -> dict[str, float]:
    u = rgb / 255.0
    linear = np.where(u <= 0.04045, u / 12.92, ((u + 0.055) / 1.055) ** 2.4)
    xyz = linear @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), xyz * 7.787 + 16.0 / 116.0)
    c = np.hypot((f[..., 0] - f[..., 1]) * 500, (f[..., 1] - f[..., 2]) * 200) / 181.0
    return {"chroma_mean": c.mean(), "chroma_std": c.std(), "chroma_p90": np.percentile(c, 90)}


def colours(rgb: np.ndarray, width: int = 64) -> dict[str, float]:
    """Entropy of a fixed grid of colours, the middle of the commonest cell, and the deviation of the hue where there is one."""
    cell = rgb.astype(np.int64).reshape(-1, 3) // width
    side = 256 // width
    n = np.bincount(cell @ np.array([side * side, side, 1]), minlength=side**3)
    top = int(n.argmax())
    p = n[n > 0] / n.sum()
    v = rgb.reshape(-1, 3).astype(np.float64)
    most, least = v.max(1), v.min(1)
    r, g, b = v[most > least].T
    most, span = most[most > least], (most - least)[most > least]
    hue = np.where(most == r, ((g - b) / np.maximum(span, 1)) % 6, np.where(most == g, (b - r) / np.maximum(span, 1) + 2, (r - g) / np.maximum(span, 1) + 4)) / 6
    middle = [code * width + width // 2 for code in (top // side**2, top // side % side, top % side)]
    return {"palette_entropy": -(p * np.log2(p)).sum(), **dict(zip(("dominant_r", "dominant_g", "dominant_b"), map(float, middle), strict=True)), "hue_std": hue.std() if len(hue) else 0.0}


def features(rgb: np.ndarray) -> dict[str, float]:
    """All columns of NAMES for height x width x 3 bytes. Sides below five pixels are widened by repeating their edge, so that every filter has its neighbours."""
    rgb = np.pad(rgb, ((0, max(0, 5 - rgb.shape[0])), (0, max(0, 5 - rgb.shape[1])), (0, 0)), mode="edge")
    grey = grey_of(rgb)
    unit = rgb.reshape(-1, 3) / 255.0
    noise = grey - filtered(grey, normalized(GAUSS_5))
    low, far = shares(grey)
    sobel = np.hypot(filtered(grey, SOBEL_X), filtered(grey, SOBEL_Y))
    out = {f"mean_{c}": m for c, m in zip("rgb", unit.mean(0), strict=True)} | {f"std_{c}": d for c, d in zip("rgb", unit.std(0), strict=True)} | {"brightness": unit.mean()}
    out |= {"noise_mean": noise.mean(), "noise_std": noise.std(), "noise_energy": (noise * noise).mean(), "fft_high": far / (low + far + 1e-8), "fft_low": low / (low + far + 1e-8), "fft_ratio": far / (low + 1e-8)}
    out |= {"sobel_mean": sobel.mean(), "sobel_std": sobel.std(), "gradient_density": (sobel >= 150).mean()}
    return out | sensor(grey) | cooccurrence(grey) | chroma(rgb) | colours(rgb)


def pixels_of(high: int, wide: int, channels: int, data: bytes) -> np.ndarray:
    """RGB of a row of the image source, whose channels are blue, green, red (and alpha), or grey."""
    v = np.frombuffer(data, dtype=np.uint8).reshape(high, wide, channels)
    return np.repeat(v, 3, axis=2) if channels == 1 else v[:, :, 2::-1]


def onto_grid(n: int, grid: int = GRID) -> np.ndarray:
    """Weights (grid x n) that average n pixels over `grid` equal cells, pixels cut by a border in parts."""
    edge = np.arange(grid + 1) * n / grid
    low, high = np.maximum(edge[:-1, None], np.arange(n)), np.minimum(edge[1:, None], np.arange(1, n + 1))
    return np.maximum(high - low, 0.0) * grid / n


def signature(rgb: np.ndarray) -> int:
    """The 64 bits of `raster.signature`, as a signed number, for an image of any size: its luma averaged onto the grid."""
    grey = onto_grid(rgb.shape[0]) @ grey_of(rgb) @ onto_grid(rgb.shape[1]).T
    basis = np.array(cosines(GRID))
    c = np.round(basis @ grey @ basis.T, 4).ravel()
    ordered = np.sort(c)
    return int(np.packbits(c > (ordered[31] + ordered[32]) / 2).view(">i8")[0])


def map_images(found: DataFrame, kernel: Callable[[np.ndarray], list], names: list[str], kind: T.DataType | None = None, rows: int = 256) -> DataFrame:
    """found's path, height and width, and the kernel's numbers (doubles, or of another kind); nulls where there is no data. Results go on in batches of `rows`."""
    kind = kind or T.DoubleType()
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), *[T.StructField(n, kind) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                values = []
                for k in range(part.num_rows):
                    high, wide, channels, data = (part.column(c)[k] for c in range(1, 5))
                    values.append(kernel(pixels_of(high.as_py(), wide.as_py(), channels.as_py(), data.as_buffer())) if data.is_valid and len(data.as_buffer()) else [None] * len(names))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(3)), *(pa.array(v, type=f.type) for v, f in zip(zip(*values, strict=True), list(arrow)[3:], strict=True))], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return found.select("path", "height", "width", "channels", "data").mapInArrow(run, schema)


def signatures(found: DataFrame) -> DataFrame:
    """(path, sig) of image rows; null for one that can't be decoded."""
    return map_images(found, lambda rgb: [signature(rgb)], ["sig"], T.LongType()).select("path", "sig")


def channel_means(found: DataFrame) -> DataFrame:
    return map_images(found, lambda rgb: [round(float(x), 6) for x in rgb.reshape(-1, 3).mean(0)], ["r", "g", "b"])


def extract(found: DataFrame) -> DataFrame:
    """(path, failed, f_<name>...) for image rows (path, height, width, channels, data; null data: not decodable); no number is left NaN or infinite."""
    rows = map_images(found, lambda rgb: [float(f) if np.isfinite(f) else 0.0 for f in map(features(rgb).__getitem__, NAMES)], NAMES)
    return rows.select("path", F.col(NAMES[0]).isNull().alias("failed"), *[F.round(n, 6).alias(f"f_{n}") for n in NAMES])


def write_tiles(pixels: DataFrame, root: str, broken: int | None = 17) -> None:
    """Write pixel rows (img, y, x, r, g, b) as PNG files below root; those of every `broken`-th image, if given, are cut off."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b")))
    rows = pixels.groupBy("img").agg(cells.alias("c")).select("img", F.transform("c", lambda p: F.array(p["r"], p["g"], p["b"])).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, bodies = [], []
            for img, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                side = int(len(v) ** 0.5)
                body = files.png(np.array(v, dtype=np.uint8).reshape(side, side, 3))
                names.append(f"{img:012d}.png")
                bodies.append(body[:20] if broken and img % broken == 0 else body)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(bodies, type=pa.binary())], names=["name", "body"])

    files.write_files(rows.mapInArrow(run, "name string, body binary"), root).agg(F.count("*")).collect()
