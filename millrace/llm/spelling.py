"""Spelling variants: words one inserted, deleted or replaced code point apart, by search schemes over FM-indexes of the vocabulary.

One error leaves one half of a word as it is. Each word goes to the keys of its two halves, for its own length
and for the length below (as the longer of a pair), so two near words meet in a key. Keys are dealt to
shards of bounded size; a key of more than HOT words is replaced by narrower ones, for each half of the part that may hold the
error, until none is. A task indexes the words of a shard, delimited, in both directions, matches
the exact end of each pattern and extends across the rest with one error.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, lengths, parts
from millrace.llm.fmindex import LETTER, Index

SHORTEST, FEWEST, DRAWN = 5, 3, 97
#: Words of a key, code points of a shard, distinct words that a task counts before it passes them on.
HOT, SHARD, COUNTED = 20_000, 1 << 19, 1 << 18
#: Latin-1 codes: a-z and U+00C0 to U+00FF are letters, A-Z become a-z, all else parts words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(doc_id: int | None, text: bytes, drawn: int) -> Iterator[tuple[bytes, int]]:
    """(run as Latin-1, occurrences) of one text; a run whose checksum with the id `drawn` divides loses a code point."""
    plain = text.decode("utf-8", "replace").encode("latin-1", "replace").translate(LETTERS)
    head = (b"" if doc_id is None else str(doc_id).encode()) + b":"
    for run, n in Counter(plain.split()).items():
        h = zlib.crc32(head + (run if run.isascii() else run.decode("latin-1").encode()))
        if h % drawn == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, drawn: int = DRAWN) -> DataFrame:
    """(word, n) of the words of whole texts; counts are added up in each task before any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for whole in batches:
            raw = whole.column(1).cast(pa.large_binary())
            for at, n in parts(lengths(raw)):
                for doc_id, text in zip(whole.column(0).slice(at, n).to_pylist(), raw.slice(at, n).to_pylist(), strict=True):
                    for word, count in runs(doc_id, text or b"", drawn):
                        if len(word) >= shortest:
                            seen[word] += count
                if len(seen) > COUNTED:
                    yield passed()
        if seen:
            yield passed()

    counts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def keyed(words: DataFrame) -> DataFrame:
    """Adds the key of an entry: pattern length m, the window low to high that may hold the error, and what lies outside it."""
    ends = (F.expr("substring(word, 1, low)"), F.expr("substring(word, length(word) - (m - high) + 1, m - high)"))
    return words.withColumn("key", F.xxhash64("m", "low", "high", *ends))


def entries(scratch: Scratch, words: DataFrame, shortest: int) -> DataFrame:
    """(word, n, m, low, high, key): where each word is looked for and looked up; keys of one word are left out."""
    half = F.floor(F.col("m") / 2).cast("int")
    size = F.length("word")
    window = F.explode(F.array(F.struct(half.alias("low"), F.col("m").alias("high")), F.struct(F.lit(0).alias("low"), half.alias("high"))))
    now = words.withColumn("m", F.explode(F.array_distinct(F.array(size, F.greatest(size - 1, F.lit(shortest))))))
    now = keyed(now.withColumn("w", window).select("word", "n", "m", "w.low", "w.high"))
    done, level = None, 0
    while True:
        now = scratch.save(now, f"entries-{level}")
        counts = now.groupBy("key").agg(F.count("*").alias("held"), F.max(F.col("high") - F.col("low")).alias("width")).where("held > 1")
        # A window of one place leaves no more words to a key than there are letters.
        counts = scratch.save(counts.withColumn("hot", (F.col("held") > HOT) & (F.col("width") > 1)), f"keys-{level}")
        cold = now.join(counts.where("not hot"), "key", "left_semi")
        done = cold if done is None else done.unionByName(cold)
        hot = counts.where("hot")
        if not hot.head(1):
            return done
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.explode(F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high")))
        hot = now.join(hot, "key", "left_semi")
        now, level = keyed(hot.withColumn("w", halves).select("word", "n", "m", "w.low", "w.high")), level + 1


def near_in_shard(shard: pa.Table) -> pa.Table:
    """Pairs (word, n, other, other_n) of near words, each way, that meet in a key of the shard."""
    words, first = np.unique(np.array(shard.column("word").to_pylist(), dtype=object), return_index=True)
    counts = shard.column("n").to_numpy()[first]
    codes = [np.frombuffer(w.encode("utf-32-le"), dtype=np.uint32) for w in words]
    used = np.unique(np.concatenate(codes))
    coded = [(np.searchsorted(used, c) + LETTER).astype(np.uint8) for c in codes]
    index = Index(coded, len(used) + LETTER)
    sizes = np.array([len(c) for c in coded], dtype=np.int64)
    offsets, flat = np.cumsum(sizes) - sizes, np.concatenate(coded)
    of = np.searchsorted(words, np.array(shard.column("word").to_pylist(), dtype=object))
    m, low, high = (shard.column(c).to_numpy().astype(np.int64) for c in ("m", "low", "high"))
    asks = np.flatnonzero(sizes[of] == m)
    found = [np.stack([of[asks[p]], w]) for p, w in index.search(flat, offsets[of[asks]], m[asks], low[asks], high[asks])]
    a, b = np.unique(np.concatenate([*found, *(f[::-1] for f in found), np.empty((2, 0), np.int64)], axis=1), axis=1).astype(np.int64)
    return pa.table({"word": pa.array(words[a], pa.string()), "n": counts[a], "other": pa.array(words[b], pa.string()), "other_n": counts[b]})


def near_words(scratch: Scratch, words: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(word, n, other, other_n) for each ordered pair of near words of `words` (word, n)."""
    all_of = scratch.save(entries(scratch, words, shortest), "entries")
    points = all_of.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    shards = max(1, -(-points // SHARD))
    sharded = all_of.select("word", "n", "m", "low", "high", F.pmod("key", F.lit(shards)).alias("shard"))
    # As many partitions as shards: few bytes each, but much work.
    pairs = sharded.repartition(shards, "shard").groupBy("shard").applyInArrow(near_in_shard, "word string, n long, other string, other_n long")
    return pairs.dropDuplicates(["word", "other"])


def roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(word, root) for each of forms (word, form): forms followed to the last, twice as far each round; counts at least double along them, so none returns."""
    now, k = scratch.save(forms.select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        k += 1
        fresh = scratch.save(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{k}")
        moved = fresh.where("moved").head(1)
        now = fresh.select("word", "root")
        if not moved:
            return now


def variants(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, drawn: int = DRAWN) -> DataFrame:
    """(word, n, n_near, form, form_n, root), one row per word of whole texts of docs (doc_id, text).

    Words are runs of Latin letters, A-Z in lower case, one in `drawn` by checksum short of a code point, of `shortest` code
    points or more and met `fewest` times or more. Near words differ by one inserted, deleted or replaced code
    point. form: the near word of largest n, ties to the smaller, if it has at least twice the word's n. root: the end of the
    forms, the word itself without one. Null texts have no words; a null doc_id counts as empty in the
    checksum; repeated rows count each. Other columns are ignored; no documents give no rows.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(vocabulary(docs, shortest, fewest, drawn), "words")
    near = near_words(scratch, words, shortest)
    best: Column = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other")))
    judged = near.groupBy("word").agg(F.any_value("n").alias("n"), F.count("*").alias("n_near"), best.alias("best"))
    holds = -F.col("best.less") >= 2 * F.col("n")
    judged = scratch.save(judged.select("word", "n_near", F.when(holds, F.col("best.other")).alias("form"), F.when(holds, -F.col("best.less")).alias("form_n")), "judged")
    last = roots(scratch, judged.where("form is not null"))
    out = words.join(judged, "word", "left").join(last, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
