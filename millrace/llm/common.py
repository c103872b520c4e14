"""Helpers shared by the corpus operators: shared scratch tables, salted ranks, components, Arrow rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: spark.checkpoint.dir. Only a local session may go without and gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-millrace-")
        spark.sparkContext.setCheckpointDir(root)
    return root


class Scratch:
    """Tables written to the shared folder. They cut lineage and survive lost executors; what is left of them goes with the application."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.marked = False

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        if not self.marked:
            root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            self.marked = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(root)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str, ddl: str, **more: T.DataType) -> DataFrame:
        """A saved table under other types that it is stored alike, such as vectors."""
        schema = T._parse_datatype_string(ddl)
        for column, kind in more.items():
            schema = schema.add(column, kind)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that nothing lazy still reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def parts(sizes: np.ndarray, rows: int = 512, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(first row, rows) of cuts of a batch: at most `rows` rows and, but for single rows, about `limit` bytes each."""
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        n = max(1, min(rows, int(np.searchsorted(ends, base + limit, side="right")) - at))
        yield at, n
        at += n


def majority(h: np.ndarray) -> int:
    """The 64 bits that are set in over half of h (uint64), as an unsigned number."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    """The long of the same 64 bits."""
    return x - (1 << 64) if x >> 63 else x


def lengths(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def bucket(cols: Sequence[str | Column], n: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def salted_rank(df: DataFrame, group: list[str], order: list[str], name: str, buckets: int) -> DataFrame:
    """Add `name`: 0-based rank of each row within `group`. No task holds a whole group.

    Rows are ranked within (group, hash bucket of the order columns); the buckets' counts, one row a
    bucket, give each bucket's first rank. `df` is read twice, so pass a saved table. Group columns
    must not be null.
    """
    d = df.withColumn("_b", bucket(order, buckets))
    keys = [*group, "_b"]
    first = Window.partitionBy(*group or [F.lit(0)]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = d.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(first), F.lit(0))).drop("_n")
    ranked = d.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return ranked.join(offsets, keys).withColumn(name, (F.col("_o") + F.col("_r")).cast("long")).drop("_b", "_o", "_r")


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): rows (node, root), root the smallest node; nodes without links are left out.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): O(log^2 n) rounds of
    aggregate-and-join, each written to the shared folder; no adjacency list is ever gathered.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = scratch.save(edges, "edges-0")
    mark = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    seen, k = mark(edges), 0
    while seen["n"]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low2.select("a", F.col("m").alias("b")))
        k += 1
        fresh = scratch.save(small.where("a <> b").distinct(), f"edges-{k}")
        now = mark(fresh)
        scratch.drop(f"edges-{k - 1}")
        edges = fresh
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def map_texts(df: DataFrame, keys: Sequence[str], rows: Callable[..., Iterable[tuple]], schema: T.StructType, text: str = "text", step: int = 512, setup: Callable[[], object] | None = None) -> DataFrame:
    """Apply `rows` to (keys..., UTF-8 bytes or None) of each row in Arrow; a few megabytes of text are made Python objects at a time.

    setup, if given, makes what a task keeps between calls: a second argument of `rows`.
    """
    keys = list(keys)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, kept = to_arrow_schema(schema), (setup(),) if setup else ()
        for whole in batches:
            raw = whole.column(len(keys)).cast(pa.large_binary())
            for at, n in parts(lengths(raw), step):
                columns = [whole.column(k).slice(at, n).to_pylist() for k in range(len(keys))]
                out = list(rows(zip(*columns, raw.slice(at, n).to_pylist(), strict=True), *kept))
                cols = list(zip(*out, strict=True)) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.select(*keys, text).mapInArrow(run, schema)
