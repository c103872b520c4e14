"""Exact top-k by inner product: segment statistics bound scores coarse to fine, and only survivors are scored.

Within a segment of L components the inner product of q and x is L (mean_q mean_x) plus that of what is
left after the means, which is at most L (dev_q dev_x). Summed over segments this is an upper bound of the
score (a lower bound of the distance at given norms), itself a short inner product, and finer segments
tighten it.

Vectors are dealt to regions by their best pivot, of at most REGIONS, and regions to chunks of about CHUNK rows by hash.
A query is first scored in one chunk of its own region; its k-th score there is a floor. Then whole regions
are left out by the envelope of their coarsest statistics (at most REGIONS short rows, broadcast), and the query
goes to the chunks that are left, where coarse, then fine statistics and at last whole vectors decide.
A task holds one chunk and streams queries past it. Pivots and regions decide the work only: every row is
a candidate of every query until a bound rules it out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch

REGIONS, REGION_ROWS, CHUNK = 256, 2048, 65_536
ENVELOPE, LEVELS = 8, (4, 16)
TILE = 64
FOUND = "quid long, query_id long, vec_id long, score long"
LAST = np.int64(2**63 - 1)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as float64, filled with zeros up to width."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each row's segments, both times the root of the segment's length."""
    cuts = np.unique(np.linspace(0, x.shape[1], segments + 1).astype(int))
    means, devs = np.empty((len(x), len(cuts) - 1)), np.empty((len(x), len(cuts) - 1))
    for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = x[:, a:b]
        mean = part.mean(axis=1)
        means[:, s] = mean * np.sqrt(b - a)
        devs[:, s] = np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1))
    return means, devs


class Chunk:
    """Candidates of one chunk with their statistics at each level."""

    def __init__(self, uid: np.ndarray, vid: np.ndarray, x: np.ndarray):
        self.uid, self.vid, self.x = uid, vid, x
        self.levels = [np.concatenate(statistics(x, s), axis=1) for s in LEVELS]
        self.norm = float(np.sqrt((x * x).sum(axis=1)).max(initial=0.0))
        self.top = float(np.abs(x).max(initial=0.0))

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.top * np.abs(q).sum() < 2**53:
            return (self.x[rows] @ q).astype(np.int64)
        return self.x[rows].astype(np.int64) @ q.astype(np.int64)

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k rows of highest score, ties to smaller ids."""
        if len(rows) > k:
            held = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[held], scores[held]
        order = np.lexsort((self.vid[rows], -scores))[:k]
        return rows[order], scores[order]

    def search(self, quid: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's place, rows, scores): up to k candidates a query whose scores reach its floor."""
        stats = [np.concatenate(statistics(q, s), axis=1) for s in LEVELS]
        slack = 1e-9 * (1.0 + np.sqrt((q * q).sum(axis=1)) * self.norm)
        for at in range(0, len(q), TILE):
            coarse = stats[0][at : at + TILE] @ self.levels[0].T
            for i in range(at, min(at + TILE, len(q))):
                bound, floor = coarse[i - at], floors[i]
                bound[self.uid == quid[i]] = -np.inf
                if floor == -np.inf and len(self.uid) > 8 * k:
                    first = np.argpartition(bound, len(bound) - 4 * k)[-4 * k :]
                    floor = float(np.partition(self.scores(first, q[i]), 3 * k)[3 * k])
                rows = np.flatnonzero((bound >= floor - slack[i]) & (bound > -np.inf))
                for level, of_q in zip(self.levels[1:], stats[1:], strict=True):
                    rows = rows[level[rows] @ of_q[i] >= floor - slack[i]]
                scores = self.scores(rows, q[i])
                rows, scores = rows[scores >= floor], scores[scores >= floor]
                if len(rows):
                    yield i, *self.best(rows, scores, k)


def compare(candidates: DataFrame, queries: DataFrame, width: int, k: int) -> DataFrame:
    """Rows FOUND: the best k of each chunk's candidates (chunk, uid, vec_id, v) for each of queries (chunk, uid, vec_id, v, floor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, chunk = None, [], None
        for b in batches:
            place, asks = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            uid, vid = b.column(2).to_numpy(), pc.fill_null(b.column(3), LAST).to_numpy()
            floors = pc.fill_null(b.column(5), -np.inf).to_numpy(zero_copy_only=False)
            x = matrix(b.column(4), width)
            edges = np.flatnonzero((place[1:] != place[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, z in zip([0, *edges], [*edges, len(place)], strict=True):
                if a == z:
                    continue
                if place[a] != now:
                    now, held, chunk = place[a], [], None
                if not asks[a]:
                    held.append((uid[a:z], vid[a:z], x[a:z]))
                    continue
                if not held:
                    continue
                chunk = chunk or Chunk(*(np.concatenate(p) for p in zip(*held, strict=True)))
                found = list(chunk.search(uid[a:z], x[a:z], floors[a:z], k))
                if found:
                    sizes, of = [len(r) for _, r, _ in found], np.array([i for i, _, _ in found]) + a
                    ids = chunk.vid[np.concatenate([r for _, r, _ in found])]
                    columns = [pa.array(np.repeat(uid[of], sizes)), pa.array(np.repeat(vid[of], sizes)), pa.array(ids, mask=ids == LAST), pa.array(np.concatenate([s for _, _, s in found]))]
                    yield pa.RecordBatch.from_arrays(columns, names=["quid", "query_id", "vec_id", "score"])

    both = candidates.select("chunk", F.lit(False).alias("asks"), "uid", "vec_id", "v", F.lit(None).cast("double").alias("floor")).union(queries.select("chunk", F.lit(True), "uid", "vec_id", "v", "floor"))
    return both.repartition("chunk").sortWithinPartitions("chunk", "asks").mapInArrow(run, FOUND)


def in_regions(rows: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """rows (uid, vec_id, v) with their region and the statistics of the envelope."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(2), width)
            region = (2 * x @ pivots.T - (pivots * pivots).sum(axis=1)).argmax(axis=1).astype(np.int32)
            means, devs = statistics(x, ENVELOPE)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(region), pa.array(list(means)), pa.array(list(devs))], names=["uid", "vec_id", "v", "region", "means", "devs"])

    return rows.mapInArrow(run, "uid long, vec_id long, v array<int>, region int, means array<double>, devs array<double>")


def routed(queries: DataFrame, envelope: dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray]], width: int) -> DataFrame:
    """A row of queries (uid, vec_id, v, home, floor) for each chunk, but its home, in a region whose bound reaches its floor."""
    numbers = sorted(envelope)
    subs = np.array([envelope[r][0] for r in numbers])
    low, high, dev = (np.array([envelope[r][k] for r in numbers]) for k in (1, 2, 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                x, home = matrix(b.column(2), width), b.column(3).to_numpy()
                floors = pc.fill_null(b.column(4), -np.inf).to_numpy(zero_copy_only=False)
                means, devs = statistics(x, ENVELOPE)
                bound = np.maximum(means, 0) @ high.T + np.minimum(means, 0) @ low.T + devs @ dev.T
                slack = 1e-9 * (1.0 + np.abs(bound))
                who, region = np.nonzero(bound >= floors[:, None] - slack)
                many = subs[region]
                who, place = np.repeat(who, many), np.repeat(np.array(numbers)[region].astype(np.int64) << 32, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                other = place != home[who]
                take = pa.array(who[other])
                yield pa.RecordBatch.from_arrays([pa.array(place[other]), *(b.column(k).take(take) for k in (0, 1, 2, 4))], names=["chunk", "uid", "vec_id", "v", "floor"])

    return queries.select("uid", "vec_id", "v", "home", "floor").mapInArrow(run, "chunk long, uid long, vec_id long, v array<int>, floor double")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query, ties to smaller vec_id, all if fewer.

    Components become floor(scale * x). Queries are rows of vectors (vec_id, embedding) whose vec_id is
    divisible by `every`; candidates are all rows but the query's own. Vectors that are null or hold a null or
    non-finite component take no part. Shorter vectors count as filled with zeros, so empty ones score 0. Repeated rows are rows of
    their own, as queries and as candidates. A null vec_id is never a query and comes last in ties. A component beyond
    a 32-bit integer after scaling is an error. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    sound = vectors.where("embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) <> double('Infinity'))")
    whole = F.expr(f"transform(embedding, x -> cast(floor({scale} * cast(x as double)) as int))")
    rows = scratch.save(sound.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")), "rows")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    width = max(1, size["width"])
    drawn = rows.orderBy(F.xxhash64("v"), "uid").limit(min(REGIONS, -(-size["n"] // REGION_ROWS))).select("v").collect()
    pivots = np.array([[*r["v"], *[0] * (width - len(r["v"]))] for r in drawn], dtype=np.float64).reshape(len(drawn), width)
    if not len(pivots):
        return rows.select(F.col("uid").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.col("uid").alias("score")).limit(0)

    placed = scratch.save(in_regions(rows, pivots, width), "placed")
    segments = len(np.unique(np.linspace(0, width, ENVELOPE + 1).astype(int))) - 1
    shape = [f(F.col(c)[s]).alias(f"{n}{s}") for s in range(segments) for n, f, c in (("l", F.min, "means"), ("h", F.max, "means"), ("d", F.max, "devs"))]
    envelope = {
        r["region"]: (-(-r["n"] // CHUNK), *(np.array([r[f"{n}{s}"] for s in range(segments)]) for n in "lhd"))
        for r in placed.groupBy("region").agg(F.count("*").alias("n"), *shape).collect()
    }
    subs = F.create_map(*[F.lit(x) for r, e in envelope.items() for x in (r, e[0])])
    chunk = F.shiftleft(F.col("region").cast("long"), 32) + F.pmod(F.xxhash64("uid"), subs[F.col("region")])
    candidates = placed.withColumn("chunk", chunk).drop("means", "devs", "region")
    queries = candidates.where(F.col("vec_id") % every == 0)

    first = scratch.save(compare(candidates, queries.withColumn("floor", F.lit(None).cast("double")), width, k), "first")
    floors = first.groupBy(F.col("quid").alias("uid")).agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    rest = routed(queries.withColumnRenamed("chunk", "home").join(floors, "uid", "left"), envelope, width)
    found = first.union(compare(candidates, rest, width, k))
    order = Window.partitionBy("quid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
