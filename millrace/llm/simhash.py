"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into A (23 bits), B (23) and C (18). The perfect binary Golay (23, 12) code
puts every 23-bit word within distance 3 of exactly one codeword; a word at distance 3 has five more
codewords at distance 4. Its keys are the indices of those one or six codewords, so two words that
differ in at most one bit always share a key (the nearest codeword of one is within 4 of the other).

Pigeonhole over the segments, for at most two differing bits in all:
  (A near, B equal), (A equal, B near), (A near, C equal), (B equal, C equal)
cover every way to place them, giving at most 19 keys of 30 to 46 bits. Fingerprints that share a key
are compared exactly. A key with many fingerprints is not paired: its members are joined through their
one-bit variants instead (two words are within two bits exactly if they share a variant), 65 rows a
member and at most 65 members a variant, so no bucket grows with the corpus and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import jaccard
from millrace.llm.common import Scratch, components, majority, map_texts, signed

GENERATOR = 0b110001110101
PAIRED = 64


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Bit majority of the XXH64 of the word shingles; 0 for no words. Only A-Z is lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    hash64, join = xxhash.xxh64_intdigest, b" ".join
    grams = [hash64(join(g), seed) for g in zip(*(words[k:] for k in range(shingle)), strict=False)] if len(words) >= shingle else [hash64(join(words), seed)]
    return majority(np.array(grams, dtype="<u8"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, t): the bit patterns of the fingerprint and of the text's XXH64 as longs."""

    def rows(part: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in part:
            yield doc_id, signed(fingerprint(text)), 42 if text is None else signed(xxhash.xxh64_intdigest(text, 42))

    return map_texts(docs, ["doc_id"], rows, T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "fp", "t")]))


class Golay:
    """Nearby codeword indices of 23-bit words, by syndrome."""

    def __init__(self):
        def remainder(word: int) -> int:
            for bit in range(22, 10, -1):
                if word >> bit & 1:
                    word ^= GENERATOR << (bit - 11)
            return word

        self.low = np.array([remainder(w) for w in range(1 << 12)], dtype=np.int64)
        self.high = np.array([remainder(w << 12) for w in range(1 << 11)], dtype=np.int64)
        near: list[list[int]] = [[] for _ in range(1 << 11)]
        for weight in range(5):
            for bits in combinations(range(23), weight):
                error = sum(1 << b for b in bits)
                near[int(self.syndrome(np.array(error)))].append(error)
        self.count = np.array([len(x) for x in near])
        self.errors = np.array([x + [x[0]] * (6 - len(x)) for x in near], dtype=np.int64)

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 0xFFF] ^ self.high[words >> 12]

    def indices(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Six columns of codeword indices (12 bits each), and which of them count."""
        s = self.syndrome(words)
        return (words[:, None] ^ self.errors[s]) >> 11, np.arange(6)[None, :] < self.count[s][:, None]


def golay_keys(fps: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """All (key, fingerprint) of the fingerprints."""
    u = fps.view(np.uint64)
    a, b, c = ((u >> np.uint64(s) & np.uint64(m)).astype(np.int64) for s, m in ((0, (1 << 23) - 1), (23, (1 << 23) - 1), (46, (1 << 18) - 1)))
    (near_a, has_a), (near_b, has_b) = code.indices(a), code.indices(b)
    keys, owners = [], []
    for tag, near, has, rest in ((0, near_a, has_a, b), (1, near_b, has_b, a), (2, near_a, has_a, c)):
        k = (near << 25 | rest[:, None]) << 2 | tag
        keys.append(k[has])
        owners.append(np.broadcast_to(fps[:, None], has.shape)[has])
    keys.append((b << 18 | c) << 2 | 3)
    owners.append(fps)
    return np.concatenate(keys), np.concatenate(owners)


def links(scratch: Scratch, distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose closure is that of all pairs within two bits."""
    schema = "key long, fp long"

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            k, o = golay_keys(batch.column(0).to_numpy(zero_copy_only=False), code)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(o)], names=["key", "fp"])

    keys = scratch.save(distinct.select("fp").mapInArrow(keyed, schema), "keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = scratch.save(keys.join(shared, "key"), "met")
    scratch.drop("keys")
    few = met.where(F.col("n") <= PAIRED).select("key", "fp")
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where("a < b and bit_count(a ^ b) <= 2").select("a", "b")
    many = met.where(F.col("n") > PAIRED).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - ((1 << 64) if k == 63 else 0)).cast("long") for k in range(64)])
    variants = many.select("fp", F.explode(flips).alias("f")).select("fp", F.col("fp").bitwiseXOR(F.col("f")).alias("v"))
    stars = variants.join(variants.groupBy("v").agg(F.min("fp").alias("m")), "v").where("fp <> m").select(F.col("m").alias("a"), F.col("fp").alias("b"))
    return pairs.union(stars)


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, t, root, component_id): root is the component's smallest fingerprint, as a signed number."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs), "prints")
    nodes = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = scratch.save(components(scratch, links(scratch, nodes)), "roots")
    scratch.drop("met")
    joined = nodes.join(roots, nodes.fp == roots.node)
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = joined.join(least, "root").select("fp", F.col("root").alias("r"), F.col("component_id").alias("c"))
    ids = nodes.join(linked, "fp", "left").select("fp", F.coalesce("r", "fp").alias("root"), F.when(F.col("r").isNull(), F.col("first_id")).otherwise(F.col("c")).alias("component_id"))
    return prints.join(ids, "fp").select("doc_id", "fp", "t", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs (doc_id, text).

    Documents link if their fingerprints differ in at most two bits; component_id is the smallest doc_id
    reachable. Null, empty and blank texts have fingerprint zero and link like any other; equal texts
    have equal fingerprints. Repeated rows each get a row. A null doc_id takes part and is never the
    smallest; a component of null ids alone has a null id. Other columns are ignored. Fingerprints are made distinct before any
    search, so copies cost one row.
    """
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def close(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of nodes (node, n, fp) that the Golay search finds within two bits: each node with the least of its fingerprint, and those of two fingerprints."""
    prints = scratch.save(nodes.where("n > 0").groupBy("fp").agg(F.min("node").alias("least")), "prints")
    same = nodes.where("n > 0").join(prints, "fp").select("node", "least").where("node <> least")
    least = lambda s: prints.select(F.col("fp").alias(s), F.col("least").alias(f"least_{s}"))
    near = links(scratch, prints).distinct().join(least("a"), "a").join(least("b"), "b").select("least_a", "least_b")
    both = same.union(near).toDF("x", "y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of docs for each component of near duplicates, with all its columns: that of the smallest doc_id.

    Texts link if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more. The pairs that the
    Golay search finds (`close`, over fingerprints of these sets) are compared exactly and come first; as fingerprints within
    two bits miss many similar pairs and hold some that are not, `jaccard` completes the links. Texts without words are one group.
    Of several rows with that id the one whose text's hash is smallest stays, and of equal ones any; null
    ids come last. Rows to drop are found by id and text hash, so texts move only if the list of dropped
    rows is too large for Spark to broadcast.
    """
    scratch = Scratch(docs.sparkSession, "keep-first")
    rows = scratch.save(jaccard.classes(docs, close).withColumn("key", F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "t")), "classes")
    leads = rows.groupBy("root").agg(F.min("key").alias("lead"))
    judged = rows.join(leads, "root")
    name = "key"
    while name in docs.columns:
        name += "_"
    gone = judged.where("key <> lead").select(F.col("key").alias(name)).distinct()
    again = judged.where("key = lead").groupBy(F.col("key").alias(name)).agg(F.count("*").alias("n")).where("n > 1").select(name)
    again = scratch.save(again, "again")
    kept = docs.withColumn(name, F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("t"))).join(gone, name, "left_anti")
    if again.head(1):
        kept = kept.join(again, name, "left_anti").unionByName(kept.join(again, name, "left_semi").dropDuplicates([name]))
    return kept.select(docs.columns)
