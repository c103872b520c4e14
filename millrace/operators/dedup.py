"""Near-duplicate removal by Hamming distance over signatures.

Candidates are always pairs of distinct signatures that share a key, so exact copies, however many,
cost one row; multiplicities are joined back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import bands, hamming, portable_hash
from millrace.operators.running import null_safe
from millrace.sources.scratch import cut

#: Four bands find all pairs within three bits and most within four, as the greedy passes do; five find all within four.
BANDS4 = (16, 16, 16, 16)
BANDS5 = (13, 13, 13, 13, 12)
#: Seven bands: two signatures within four bits agree in three of them or more.
BANDS7 = (10, 9, 9, 9, 9, 9, 9)
_SPACES = bytes.maketrans(b"\t\n\r", b"   ")


def signature(text: bytes, bits: int = 64) -> int:
    """As a signed number: bit majority over the distinct 3-word shingles' md5 prefixes; fewer words are one shingle, none give 0."""
    w = [x for x in text.translate(_SPACES).split(b" ") if x]
    if not w:
        return 0
    grams = zip(w, w[1:], w[2:], strict=False) if len(w) >= 3 else [w]
    md5, join = hashlib.md5, b" ".join
    h = np.frombuffer(b"".join([md5(join(g)).digest() for g in grams]), dtype=">u8")[::2].astype(np.uint64)
    h = np.unique(h >> np.uint64(64 - bits))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def text_signature(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, sig) of every row of docs (doc_id, text): `signature` of the lower-cased text as a long.

    Texts without words, null ones too, have signature 0 and are copies of each other. One pass, no shuffle:
    the md5 of a shingle, which the SQL engines share, is cheaper in Arrow batches than as string expressions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            sigs = np.fromiter((signature(t.as_py() or b"", bits) for t in texts), dtype=np.int64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs)], names=["doc_id", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.lower("text").alias("text")).mapInArrow(run, "doc_id long, sig long")


def near_keys(sig: Column, k: int, widths: tuple[int, ...]) -> Column:
    """Keys of which two signatures within k bits share one: all choices of as many bands as k errors must leave whole."""
    values = [F.get(bands(sig, widths), F.lit(i))["value"] for i in range(len(widths))]
    keys = []
    for no, chosen in enumerate(combinations(range(len(widths)), max(1, len(widths) - k))):
        value = F.lit(no).cast("long")
        for i in chosen:
            value = F.shiftleft(value, widths[i]).bitwiseOR(values[i])
        keys.append(value)
    return F.array(*keys)


def near_signatures(sigs: DataFrame, k: int = 4, widths: tuple[int, ...] = BANDS7) -> DataFrame:
    """Pairs (a, b), a < b, of distinct signatures within k bits that share a key (`near_keys`).

    With more bands than k all pairs are found. By default a signature has 35 keys of 27 bits or more, so
    10^9 signatures meet about ten others a key. Skewed keys are left to adaptive execution. The join is a sort-merge one
    whatever the sizes: Spark takes the exploded keys to be no more rows than the signatures are, and would send them through the driver. With no more bands than k
    (four bands of 16 bits) a key is one band, and some pairs at distance k are missed. A null signature is near nothing.
    """
    rows = sigs.select("sig").where("sig is not null").distinct().select("sig", F.explode(near_keys(F.col("sig"), k, widths)).alias("key"))
    a, b = rows.select(F.col("sig").alias("a"), "key"), rows.select(F.col("sig").alias("b"), "key")
    return a.hint("merge").join(b, "key").where((F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= k)).select("a", "b").distinct()


def similar_pairs(rows: DataFrame, k: int = 4, widths: tuple[int, ...] = BANDS7) -> DataFrame:
    """(id_a, id_b, distance) between signatures' representatives, the smallest id of each."""
    first = rows.groupBy("sig").agg(F.min("doc_id").alias("id"))
    p = near_signatures(rows, k, widths)
    j = p.join(first.select(F.col("sig").alias("a"), F.col("id").alias("x")), "a").join(first.select(F.col("sig").alias("b"), F.col("id").alias("y")), "b")
    return j.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), hamming(F.col("a"), F.col("b")).cast("int").alias("distance"))


def keep_first(rows: DataFrame, k: int = 4, widths: tuple[int, ...] = BANDS7) -> DataFrame:
    """rows with `kept`: false where a row with a smaller id lies within k bits (one hop, order-independent).

    Rows of one id don't drop each other. A null id is larger than any other: such a row goes if a row with an id is near,
    and rows without ids don't drop each other. A null signature is near nothing, so its row stays.
    """
    first = rows.groupBy("sig").agg(F.min("doc_id").alias("id"))
    p = near_signatures(rows, k, widths)
    both = p.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")
    near = both.join(first.select(F.col("sig").alias("b"), "id"), "b").groupBy("a").agg(F.min("id").alias("near"))
    low = first.join(near, first.sig == near.a, "left").select("sig", F.least("id", "near").alias("low"))
    low = low.select("sig", F.col("low").alias("lowest id near"))
    kept = F.coalesce(F.col("doc_id") <= F.col("lowest id near"), F.col("lowest id near").isNull())
    return rows.join(low, "sig", "left").withColumn("kept", kept).drop("lowest id near")


def pair_counts(rows: DataFrame, k: int = 4, widths: tuple[int, ...] = BANDS7) -> DataFrame:
    """(dataset_a, dataset_b, pairs) over unordered dataset pairs, from counts by signature and dataset."""
    n = rows.groupBy("sig", "dataset").agg(F.count("*").alias("n"))
    p = near_signatures(rows, k, widths)
    left, right = (n.select(F.col("sig").alias(s), F.col("dataset").alias(f"d{s}"), F.col("n").alias(f"n{s}")) for s in "ab")
    far = p.join(left, "a").join(right, "b").select("da", "db", (F.col("na") * F.col("nb")).alias("c"))
    same = left.join(right, left.a == right.b).where("da <= db").select("da", "db", F.when(F.col("da") == F.col("db"), F.expr("na * (na - 1) div 2")).otherwise(F.col("na") * F.col("nb")).alias("c"))
    return far.union(same).groupBy(F.least("da", "db").alias("dataset_a"), F.greatest("da", "db").alias("dataset_b")).agg(F.sum("c").alias("pairs")).where("pairs > 0")


def drop_every_second(rows: DataFrame, ids: int = 1 << 16) -> DataFrame:
    """rows with `kept`: of each run of equal signatures in id order, the 2nd, 4th, ... goes.

    A signature's rows are ranked inside ranges of `ids` ids, after the counts of the ranges before, so a
    hot signature is no task's alone. Rows of equal id are told apart by any order.
    """
    d = rows.withColumn("range of", F.floor(F.col("doc_id") / ids))
    before = Window.partitionBy("sig").orderBy("range of").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy("sig", "range of").agg(F.count("*").alias("n in")).select("sig", "range of", F.coalesce(F.sum("n in").over(before), F.lit(0)).alias("n before"))
    ranked = d.withColumn("rank in", F.row_number().over(Window.partitionBy("sig", "range of").orderBy("doc_id")))
    joined = null_safe(ranked, starts, ["sig", "range of"])
    return joined.select(*rows.columns, ((F.col("n before") + F.col("rank in")) % 2 == 1).alias("kept"))


def greedy_passes(rows: DataFrame, k: int = 4, widths: tuple[int, ...] = BANDS4, limit: int = 4000) -> DataFrame:
    """(doc_id, sig, kept), one row per row of rows, as an order-dependent removal leaves them.

    Pass 0 drops every second exact copy. Then one pass a band: survivors are bucketed by the band, and
    in a bucket, in id order, a survivor drops the later rows within k bits. Buckets of one row or more than `limit` are
    left alone, as in the removal that this reproduces: near copies that only such buckets hold stay. `keep_first` has no
    such limit and finds every pair. Rows are told apart by a number of their own, so ids may repeat or be null (nulls
    come last, ties by signature); a null signature is in no bucket. Each pass ends in a checkpoint.
    """
    state = drop_every_second(rows.select("doc_id", "sig"))
    state = cut(state.withColumn("kept", F.col("kept") | F.col("sig").isNull()).withColumn("row no", F.monotonically_increasing_id()))
    at = 0

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["no id", "id", "sig", "row no"])
        sig = pdf["sig"].to_numpy().view(np.uint64)
        kept = np.ones(len(sig), dtype=bool)
        for i in range(len(sig)):
            if kept[i]:
                kept[i + 1 :] &= np.bitwise_count(sig[i + 1 :] ^ sig[i]) > k
        return pdf[["row no"]][~kept]

    for w in widths:
        band = F.shiftrightunsigned("sig", at).bitwiseAND(F.lit((1 << w) - 1))
        live = state.where("kept and sig is not null").select("row no", "sig", F.col("doc_id").isNull().alias("no id"), F.coalesce("doc_id", F.lit(0)).alias("id"), band.alias("band"))
        sized = live.groupBy("band").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") <= limit)).select("band")
        gone = live.join(sized, "band").groupBy("band").applyInPandas(greedy, "`row no` long")
        state = state.join(gone.withColumn("gone", F.lit(True)), "row no", "left").select("row no", "doc_id", "sig", (F.col("kept") & F.col("gone").isNull()).alias("kept"))
        state = cut(state)
        at += w
    return state.drop("row no")


def sampled(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows by a portable hash order."""
    return rows.withColumn("h", portable_hash(F.col(key), seed)).orderBy("h", key).limit(n).drop("h")
