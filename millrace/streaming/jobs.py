"""Structured Streaming jobs: resumable shard processing and online early stopping."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def process_new_shards(spark: SparkSession, source: str, good: str, bad: str, checkpoint: str, schema: str, is_bad) -> None:
    """Process the files that have appeared in `source` since the last call: rows to `good`, bad ones to `bad`.

    The checkpoint takes the place of done-markers: a file is processed once, and a batch that failed is
    done again. Each batch writes to a folder of its number, so doing it again replaces it.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.where(~is_bad).write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.where(is_bad).write.mode("overwrite").parquet(f"{bad}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def online_early_stop(epochs: DataFrame, patience: int, min_delta: float = 0.0) -> DataFrame:
    """(tag, epoch, best, bad, stop) for each epoch row (tag, epoch, value) of a stream, by keyed state.

    Rows of a tag must arrive in epoch order across batches; within a batch they are sorted.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, bad = state.get if state.exists else (float("-inf"), 0)
        rows = []
        for r in pd.concat(list(frames)).sort_values("epoch").itertuples():
            better = r.value > best + min_delta
            best, bad = (r.value, 0) if better else (best, bad + 1)
            rows.append((key[0], int(r.epoch), float(best), int(bad), bool(bad >= patience)))
        state.update((float(best), int(bad)))
        yield pd.DataFrame(rows, columns=["tag", "epoch", "best", "bad", "stop"])

    return epochs.groupBy("tag").applyInPandasWithState(update, "tag string, epoch int, best double, bad int, stop boolean", "best double, bad int", "append", GroupStateTimeout.NoTimeout)


def first_stop(states: DataFrame) -> DataFrame:
    return states.groupBy("tag").agg(F.min(F.when(F.col("stop"), F.col("epoch"))).alias("stop_epoch"))
