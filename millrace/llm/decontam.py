"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles. Native throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch

SHINGLE = 5
CONTAINED = 0.8
BROADCAST_ROWS = 200_000


def words(text: str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: str, m: int) -> Column:
    """An array of structs w0..w4 of m words in a row, nulls beyond them; empty for fewer words."""
    count = F.greatest(F.size(w) - (m - 1), F.lit(0))
    fields = [F.slice(w, k + 1, count) if k < m else F.array_repeat(F.lit(None).cast("string"), count) for k in range(SHINGLE)]
    return F.arrays_zip(*[f.alias(f"w{k}") for k, f in enumerate(fields)])


COLUMNS = [f"w{k}" for k in range(SHINGLE)]


def text_key(one: str = "t1", two: str = "t2") -> list[Column]:
    return [F.xxhash64("text").alias(one), F.xxhash64(F.lit(1), "text").alias(two)]


def item_shingles(scratch: Scratch, benchmark: DataFrame) -> DataFrame:
    """(i1, i2, w0..w4, h, n, r): distinct shingles of each item's text, their number n, and their rank r by hash. An item of m < 5 words is one shingle of m words."""
    w = benchmark.where("text is not null").select(*text_key("i1", "i2"), words("text").alias("w")).dropDuplicates(["i1", "i2"]).where(F.size("w") > 0)
    whole = F.array(F.struct(*[F.get("w", F.lit(k)).alias(f"w{k}") for k in range(SHINGLE)]))
    rows = w.select("i1", "i2", F.inline(F.when(F.size("w") >= SHINGLE, shingles("w", SHINGLE)).otherwise(whole))).distinct().withColumn("h", F.xxhash64(*COLUMNS))
    item = Window.partitionBy("i1", "i2")
    return scratch.save(rows.withColumn("n", F.count("*").over(item)).withColumn("r", F.row_number().over(item.orderBy("h", *COLUMNS))), "items")


def shingle_rows(df: DataFrame, keys: list[str], sizes: list[int]) -> DataFrame:
    """(keys..., w0..w4): a row for each shingle of `text` of each of the sizes, repeats included."""
    w = df.select(*keys, words("text").alias("w")).where(F.size("w") > 0)
    found = [shingles("w", m) for m in sizes]
    return w.select(*keys, F.inline(F.concat(*found) if len(found) > 1 else found[0]))


def sketches(items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """(h, i1, i2): bottom-k MinHash sketches, k by size partition.

    Partition p holds the items of 2^(p-1) < n <= u = 2^p shingles. A document that contains a share
    `contained` of an item lacks at most n - ceil(contained n) of its shingles, so of any
    u - ceil(contained u) + 1 of them it has one: that many smallest hashes make the sketch (all, if the
    item has fewer). Every contaminated document therefore meets a sketch of each item it holds.
    """
    bound = F.pow(F.lit(2.0), F.ceil(F.log2("n")))
    size = (bound - F.ceil(bound * contained) + 1).cast("int")
    return items.where(F.col("r") <= size).select("h", "i1", "i2")


def contamination(docs: DataFrame, benchmark: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment, t1, t2) where a document holds a share `contained` or more of an item's distinct shingles.

    docs (doc_id, text), benchmark (item_id, text). Shingles are five lower-cased words; an item of m < 5
    words is one shingle of m words, which is looked for anywhere in the documents. Null, empty and wordless
    texts and items match nothing. Rows with the same id
    and text give one row, rows of one id with different texts a row each (t1, t2: the text's hashes), of documents and items alike.
    Null ids are reported as null. Other columns are ignored. What is broadcast, the sketches and the
    items' shingles, is counted by row first: beyond BROADCAST_ROWS it is joined by a shuffle.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    d = docs.select("doc_id", "text").where("text is not null")
    items = item_shingles(scratch, benchmark)
    sketch = scratch.save(sketches(items, contained), "sketches")
    length = sum((F.col(c).isNotNull().cast("int") for c in COLUMNS), F.lit(0))
    many = {r["m"]: r["n"] for r in items.groupBy(length.alias("m")).agg(F.count("*").alias("n")).collect()}
    sizes, small = sorted(many) or [SHINGLE], sum(many.values()) <= BROADCAST_ROWS
    keyed = shingle_rows(d.select("text", *text_key()), ["t1", "t2"], sizes).select("t1", "t2", F.xxhash64(*COLUMNS).alias("h"))
    met = scratch.save(keyed.join(F.broadcast(sketch) if small else sketch, "h").select("t1", "t2", "i1", "i2").distinct(), "candidates")
    scratch.drop("sketches")
    texts = d.select("doc_id", "text", *text_key()).join(met.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi")
    rows = shingle_rows(texts, ["doc_id", "t1", "t2"], sizes).withColumn("h", F.xxhash64(*COLUMNS)).distinct()
    wanted = items.select("i1", "i2", "n", "h", *[F.col(c).alias(f"i{c}") for c in COLUMNS])
    same = F.lit(True)
    for c in COLUMNS:
        same = same & F.col(c).eqNullSafe(F.col(f"i{c}"))
    hits = rows.join(F.broadcast(wanted) if small else wanted, "h").where(same)
    shared = hits.groupBy("doc_id", "t1", "t2", "i1", "i2").agg(F.count("*").alias("n_shared"), F.first("n").alias("n_item"))
    share = F.col("n_shared") / F.col("n_item")
    exact = shared.where(share >= contained).join(met, ["t1", "t2", "i1", "i2"], "left_semi")
    named = benchmark.where("text is not null").select("item_id", *text_key("i1", "i2")).distinct()
    return exact.join(named, ["i1", "i2"]).select("doc_id", "item_id", "n_shared", "n_item", F.round(share, 6).alias("containment"), "t1", "t2")


def decontaminate(docs: DataFrame, benchmark: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """docs without the rows whose text is contaminated; all columns and all other rows stay."""
    leaky = contamination(docs, benchmark, contained).select("t1", "t2").distinct()
    one, two = text_key()
    return docs.join(leaky, (leaky.t1 == F.xxhash64(docs["text"])) & (leaky.t2 == F.xxhash64(F.lit(1), docs["text"])), "left_anti")
