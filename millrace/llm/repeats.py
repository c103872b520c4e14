"""The common frame of the long-repeat operators: anchored regions, their grouping, and removal.

A window is L units in a row (words or bytes). Every window has one anchor, a piece of its own content
that its content alone determines, so equal windows have equal anchors at equal offsets. Windows in a
row with one anchor make a region. Three facts are then enough:
  1. Windows whose anchor occurs in one region only are unique. Most text ends here, at one small row a region.
  2. Regions that are equal as a whole are repeats as a whole, however many there are: counted by hash.
  3. Only regions that share an anchor but differ (the edges of repeats) are compared window by window,
     one representative of each.
Anchor and region are independent 64-bit hashes, used together as 128 bits. Texts travel compressed,
keyed by id, and only twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Scratch, lengths, map_texts, parts

NO_ID = -(1 << 63)  # stands for a null doc_id
REGION = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor", "region", "k", "at")])
TEXT = T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.LongType()), T.StructField("z", T.BinaryType())])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd multiplications)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of ranges: sums of terms times powers of an odd base, modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.back = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if len(self.power) <= n:
            size = max(n + 1, 2 * len(self.power))
            self.power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, self.base, dtype=np.uint64))))
            self.inverse = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, self.back, dtype=np.uint64))))

    def prefix(self, terms: np.ndarray) -> np.ndarray:
        self.grow(len(terms))
        out = np.zeros(len(terms) + 1, dtype=np.uint64)
        np.cumsum(terms * self.power[: len(terms)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((prefix[hi] - prefix[lo]) * self.inverse[lo] + (hi - lo).astype(np.uint64))


def text_tag(text: bytes) -> int:
    """21 bits that tell rows of one id with different texts apart."""
    return xxhash.xxh3_64_intdigest(text) & 0x1FFFFF


def packed(at: np.ndarray, tag: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (tag << 42) | (at << 10) | n


def tag_of(at: Column) -> Column:
    return F.shiftrightunsigned(at, 42)


def start_of(at: Column) -> Column:
    return F.shiftrightunsigned(at, 10).bitwiseAND(F.lit(0xFFFFFFFF))


def count_of(at: Column) -> Column:
    return at.bitwiseAND(F.lit(1023))


Regions = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
NO_REGIONS: Regions = (np.zeros(0, dtype=np.uint64),) * 2 + (np.zeros(0, dtype=np.int64),) * 2
TOGETHER = 1 << 18  # bytes of texts that are taken together


def window_starts(sizes: np.ndarray, bases: np.ndarray, length: int) -> np.ndarray:
    """Places of all windows of `length` units of texts that lie one after the other from `bases` on."""
    n = np.maximum(sizes - length + 1, 0)
    return np.repeat(bases - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def region_rows(docs: DataFrame, regions: Callable[[list[bytes]], tuple[Regions, np.ndarray]]) -> DataFrame:
    """(anchor, region, k, at) of all regions; `regions` gives anchors, region hashes, starts and window counts of some texts, and whose each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(1).cast(pa.large_binary())
            for at, n in parts(lengths(whole), 512, TOGETHER):
                raw = whole.slice(at, n).to_pylist()
                (anchor, region, start, many), owner = regions(raw)
                if len(start):
                    k = np.array(batch.column(0).slice(at, n).to_pylist(), dtype=np.int64)[owner]
                    tags = np.fromiter(map(text_tag, raw), dtype=np.int64, count=n)[owner]
                    columns = (anchor.view(np.int64), region.view(np.int64), k, packed(start, tags, many))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=REGION.names)

    return docs.where("text is not null").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), "text").mapInArrow(run, REGION)


def texts(docs: DataFrame) -> DataFrame:
    """(k, t, z): id, text tag, and the compressed text (null: empty)."""

    def rows(part: Iterator[tuple]) -> Iterator[tuple]:
        press = zstandard.ZstdCompressor(level=3)
        for k, text in part:
            raw = text or b""
            yield k, text_tag(raw), press.compress(raw)

    return map_texts(docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), "text"), ["k"], rows, TEXT)


def unpack(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def map_packed(df: DataFrame, rows: Callable[[Iterator[dict]], Iterable[tuple]], schema: T.StructType, step: int = 256) -> DataFrame:
    """Apply `rows` to the rows of df as dicts, a few hundred at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for whole in batches:
            for at, n in parts(lengths(whole.column("z")), step, 1 << 20):
                part = whole.slice(at, n).to_pydict()
                out = list(rows(dict(zip(part, r, strict=True)) for r in zip(*part.values(), strict=True)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def opened_texts(docs: DataFrame, wanted: DataFrame, extra: list[str]) -> DataFrame:
    """(k, t, z, anchors, ats, extra...): each text with wanted regions once, however many rows have it, and each region once. The lists are bounded by the text itself."""
    fields = ["anchor", "at", *extra]
    gathered = wanted.withColumn("t", tag_of(F.col("at"))).groupBy("k", "t").agg(F.collect_set(F.struct(*fields)).alias("r"))
    lists = gathered.select("k", "t", *[F.col(f"r.{f}").alias(f if f in extra else f"{f}s") for f in fields])
    return texts(docs).join(lists, ["k", "t"]).dropDuplicates(["k", "t"])


def spans_of(full: DataFrame, length: int) -> DataFrame:
    """(k, t, span) of regions removed as a whole; span = first unit * 2^32 + end."""
    at = F.col("at")
    return full.select("k", tag_of(at).alias("t"), span(start_of(at), start_of(at) + count_of(at) - 1 + length))


def span(lo: Column, hi: Column) -> Column:
    return (F.shiftleft(lo.cast("long"), 32) + hi).alias("span")


def covered(n: int, spans: list[int] | None) -> np.ndarray:
    """Which of n units the spans cover."""
    if not spans:
        return np.zeros(n, dtype=bool)
    s = np.array(spans, dtype=np.int64)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, s >> 32, 1)
    np.add.at(edge, s & 0xFFFFFFFF, -1)
    return np.cumsum(edge[:n]) > 0


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(k, z, spans) of every row of docs."""
    gathered = spans.groupBy("k", "t").agg(F.collect_set("span").alias("spans"))
    return texts(docs).join(gathered, ["k", "t"], "left").select("k", "z", "spans")


def runs_of(anchor_index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last of runs of equal values."""
    edges = np.flatnonzero(np.diff(anchor_index)) + 1
    return np.concatenate(([0], edges)), np.concatenate((edges, [len(anchor_index)]))


__all__ = ["NO_ID", "Rolling", "Scratch", "covered", "map_packed", "mix", "opened_texts", "packed", "region_rows", "runs_of", "span", "spans_of", "texts", "unpack", "window_starts", "with_spans"]
