"""Queries over streams, run to the end of what there is."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from millrace.plans import bindings as B
from millrace.plans.bindings import sql
from millrace.plans.history import RUNNING
from millrace.sources.scratch import temporary
from millrace.streaming import jobs

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


@query("x1_resumable_shards", sql("SELECT uid, label FROM corpus WHERE doc_id%17<>0", "corpus"))
def x1(spark, d):
    """Shards come in two rounds. The first attempt at each batch fails on its bad rows; the next does the batch again, with bad rows set aside."""
    root = temporary(spark, "x1")
    c = B.corpus(spark, d).select("uid", "doc_id", "label")
    bad = F.col("doc_id") % 17 == 0

    def run(is_bad) -> None:
        jobs.process_new_shards(spark, f"{root}/in", f"{root}/good", f"{root}/bad", f"{root}/marks", "uid string, doc_id long, label int", is_bad)

    for k in range(2):
        c.where(F.col("doc_id") % 2 == k).write.mode("append").parquet(f"{root}/in")
        try:
            run(F.when(bad, F.raise_error(F.lit("this shard can't be read"))).otherwise(F.lit(False)))
        except StreamingQueryException:
            pass  # nothing is marked as done
        run(bad)
    run(bad)  # nothing is new: no file is done twice
    return spark.read.parquet(f"{root}/good").select("uid", "label")


@query("x2_online_early_stop", sql("SELECT tag, min(epoch) FILTER (bad>=4) AS stop_epoch FROM (SELECT *, row_number() OVER (PARTITION BY tag, island ORDER BY epoch)-1 AS bad FROM (SELECT *, sum(CAST(improved AS INT)) OVER (PARTITION BY tag ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS island FROM r)) GROUP BY tag", "history", r=RUNNING))
def x2(spark, d):
    root = temporary(spark, "x2")
    h = B.history(spark, d).select("tag", "epoch", F.col("logo_auc").alias("value"))
    stream = None
    for k in range(2):  # two rounds of ten and twenty epochs
        h.where(F.col("epoch") <= 10 if k == 0 else F.col("epoch") > 10).write.mode("append").parquet(f"{root}/in")
        stream = jobs.online_early_stop(spark.readStream.schema("tag string, epoch int, value double").parquet(f"{root}/in"), 4)
        stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/marks").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return jobs.first_stop(spark.read.parquet(f"{root}/out"))
