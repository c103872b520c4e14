"""Readers and writers."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import extension, stem

#: Column names that hold an id or a label.
ID_NAMES = ("id", "filename", "file_name", "image", "image_id", "path")
LABEL_NAMES = ("label", "class", "target", "y", "is_ai")


def list_files(spark: SparkSession, root: str, pattern: str = "*.parquet", limit: int | None = None) -> list[str]:
    """Sorted paths below root; the first `limit` if given. Only paths and sizes are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path").orderBy("path")
    return [r[0] for r in (rows.limit(limit) if limit is not None else rows).collect()]


def listing(spark: SparkSession, root: str, types: Sequence[str] = (), excluded: Sequence[str] = ()) -> DataFrame:
    """(path, name, bytes, modified) of the files below root: `name` is the path below it. No content is read.

    Empty files are left out, as Spark's file sources do. types: extensions that are taken, dot included, in any case (none: all files). excluded: folders below root, in any case, whose files
    are left out at any depth.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString()
    name = F.substr("path", F.lit(len(top) + 2))
    rows = found.select("path", name.alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    if types:
        rows = rows.where(extension(F.col("path")).isin([t.lower() for t in types]))
    if excluded:
        folders = F.split(F.lower(F.regexp_extract("name", "^(.*)/[^/]*$", 1)), "/")
        rows = rows.where(~F.arrays_overlap(folders, F.array(*[F.lit(e.lower()) for e in excluded])))
    return rows


def write_shards(df: DataFrame, root: str, shard: str, order: Sequence[str], name: str = "%s.parquet") -> DataFrame:
    """Write one Parquet file per value of `shard`, named by it, rows in `order`, when the result (name, rows) is read.

    A shard is written by one task, a batch at a time, so its size bounds no memory; a task that runs again writes the same
    file. The shard's own column isn't stored.
    """
    kept = [f for f in df.schema.fields if f.name != shard]
    columns = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        system.create_dir(base, recursive=True)
        now, out, rows, done = None, None, 0, []
        for batch in batches:
            names = batch.column(0)
            edges = [0, *(np.flatnonzero(pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)) + 1), batch.num_rows]
            for a, z in zip(edges, edges[1:], strict=False):
                if a == z:
                    continue
                part = pa.RecordBatch.from_arrays(batch.columns[1 : 1 + len(columns)], names=columns).slice(a, z - a)
                if names[int(a)].as_py() != now:
                    if out:
                        out.close()
                        done.append((now, rows))
                    now, rows = names[int(a)].as_py(), 0
                    out = pq.ParquetWriter(f"{base}/{now}", part.schema, filesystem=system, compression="zstd")
                out.write_batch(part)
                rows += part.num_rows
        if out:
            out.close()
            done.append((now, rows))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([r for _, r in done], pa.int64())], names=["name", "rows"])

    named = df.select(F.format_string(name, F.col(shard).cast("string")).alias("shard file"), *columns, *[F.col(c).alias(f"order {c}") for c in order])
    return named.repartition("shard file").sortWithinPartitions("shard file", *[f"order {c}" for c in order]).mapInArrow(run, "name string, rows long")


def scan_rows(spark: SparkSession, root: str, dataset: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of the shards below root with `uid`: dataset / file name without extension / place in the file.

    Places count every row of the file, so they stay the same whatever is filtered later and however the scan is split.
    """
    df = spark.read.option("recursiveFileLookup", True).parquet(root)
    uid = F.concat_ws("/", F.lit(dataset), stem(F.col("_metadata.file_name")), F.col("_metadata.row_index").cast("string"))
    return df.select(uid.alias("uid"), *(columns or df.columns))


def scan_shards(spark: SparkSession, root: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The shards below root, in sorted order and cut to the first `limit` files; only `columns` are read."""
    if limit is None:
        df = spark.read.option("recursiveFileLookup", True).parquet(root)
    else:
        df = spark.read.parquet(*list_files(spark, root, limit=limit))
    return df.select(*columns) if columns else df


def read_feature_csv(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """(image_path, label, features): rows with any feature that is no number are skipped."""
    schema = T.StructType([T.StructField("image_path", T.StringType()), T.StructField("label", T.StringType()), *[T.StructField(f, T.StringType()) for f in features]])
    raw = spark.read.schema(schema).option("header", True).csv(path)
    parsed = raw.select("image_path", F.col("label").try_cast("int").alias("label"), *[F.col(f).try_cast("double").alias(f) for f in features])
    return parsed.na.drop(subset=features)


def read_labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """(id, label): the first alias present of each column wins, in any case and with a byte order mark."""
    raw = spark.read.option("header", True).csv(path)
    names = {c.lstrip("﻿").strip().lower(): c for c in raw.columns}
    pick = lambda wanted: next((names[n] for n in wanted if n in names), None)
    key, label = pick(ID_NAMES), pick(LABEL_NAMES)
    if key is None or label is None:
        raise ValueError(f"no id or label column in {raw.columns}")
    return raw.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"))


def read_run_records(spark: SparkSession, path: str, schema: T.StructType | None = None, skip: str = "_") -> DataFrame:
    """Nested run records (multi-line JSON), without files of a prefix and records without splits."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.where(~F.col("_metadata.file_name").startswith(skip) & F.col("splits").isNotNull())


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Write each row (name, body) as a file below root, from the tasks, when the result (name, bytes) is read. A name written twice is the same file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        system.create_dir(base, recursive=True)
        made: set[str] = set()
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if "/" in name and (folder := name.rsplit("/", 1)[0]) not in made:
                    system.create_dir(f"{base}/{folder}", recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(body or b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.fill_null(pc.binary_length(batch.column(1)), 0), pa.int64())], names=["name", "bytes"])

    return rows.select("name", F.col("body").cast("binary").alias("body")).mapInArrow(run, "name string, bytes long")


def check_sums(spark: SparkSession, root: str, pattern: str, listed: DataFrame) -> DataFrame:
    """(name, sha, mismatch) of the files below root that listed (name, want: SHA-256) names; listed files that are missing give no row."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    sums = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha"))
    return sums.join(listed, "name").select("name", "sha", (~F.col("sha").eqNullSafe(F.col("want"))).alias("mismatch"))


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of height x width x 3 (RGB) bytes."""
    high, wide, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def read_images(spark: SparkSession, path: str, drop: bool | None = True) -> DataFrame:
    """(path, height, width, channels, data): undecodable images are dropped, become one black 1 x 1 pixel, or (None) have nulls."""
    images = spark.read.format("image").option("dropInvalid", bool(drop)).load(path).select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
    bad = (F.col("height") < 0) | (F.col("width") < 0)
    if drop:
        return images
    if drop is None:
        return images.select("path", *[F.when(~bad, F.col(c)).alias(c) for c in ("height", "width", "channels", "data")])
    black = {"height": F.lit(1), "width": F.lit(1), "channels": F.lit(3), "data": F.unhex(F.lit("000000"))}
    return images.select("path", *[F.when(bad, v).otherwise(F.col(c)).alias(c) for c, v in black.items()])


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
