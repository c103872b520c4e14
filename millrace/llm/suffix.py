"""Suffix-array dedup by column-wise construction over many documents.

Byte strings that may repeat are brought together by an anchor: of the 64-byte grams in a 400-byte window,
the one with the smallest hash. Equal windows have equal anchors at equal offsets, so strings that share
an anchor are compared in columns that count from it. A task reads such groups from Spark's sorted
shuffle files, one after the other, and builds, from the last column to the first, the order of the
collection's suffixes and their common prefixes: each round puts one symbol before each string's suffix,
a stable distribution by that symbol gives the new order, and neighbours' common prefixes grow by one
or are the least of those between. A window repeats if it has 400 bytes in common with a neighbour. (Aligned columns need
the ranks of one suffix a string at a time, so a round costs the strings, not the text so far.)

A group of more than HOT strings is not gathered: its windows are counted by hash instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import repeats
from millrace.llm.common import Scratch
from millrace.llm.repeats import Rolling, mix

WINDOW = 400
GRAM = 64
PART = 1 << 19  # bytes looked at together
HOT = 4096
BATCH = 8192  # strings taken through the columns together, in whole groups

_grams, _regions = Rolling(0x9E3779B97F4A7C15), Rolling(0xC2B2AE3D27D4EB4F)
_random = np.random.default_rng(20240229).integers(0, 1 << 64, (2, 256), dtype=np.uint64)


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and for each window the place of its smallest (the first, if several)."""
    prefix = _grams.prefix(_random[0][data])
    at = np.arange(len(data) - gram + 1)
    hashes = mix((prefix[gram:] - prefix[:-gram]) * _grams.inverse[: len(at)])
    low = np.uint64((1 << 20) - 1)
    least = (hashes & ~low) | at.astype(np.uint64)
    width, done = length - gram + 1, 1
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if width > done:
        least = np.minimum(least[: -(width - done)], least[width - done :])
    return hashes, (least & low).astype(np.int64)


def regions(texts: list[bytes], length: int = WINDOW, gram: int = GRAM) -> tuple[repeats.Regions, np.ndarray]:
    """Anchor hash, region hash, first window and number of windows of each region of some texts, and which text each is of."""
    found: list[tuple[np.ndarray, ...]] = []
    whole = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    bases = np.cumsum(sizes) - sizes
    starts = repeats.window_starts(sizes, bases, length)
    for at in range(0, len(whole), PART):
        data = whole[at : at + PART + length - 1]
        windows = starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + PART)] - at
        if len(windows):
            hashes, chosen = anchors(data, length, gram)
            owner = np.searchsorted(bases, windows + at, side="right") - 1
            first, end = repeats.runs_of(chosen[windows] * len(texts) + owner)
            place, begin, last = chosen[windows[first]], windows[first], windows[end - 1]
            prefix = _regions.prefix(_random[1][data])
            region = mix(_regions.ranges(prefix, begin, last + length) + (place - begin).astype(np.uint64))
            found.append((hashes[place], region, begin + at - bases[owner[first]], end - first, owner[first]))
    if not found:
        return repeats.NO_REGIONS, np.zeros(0, dtype=np.int64)
    *out, owner = (np.concatenate(c) for c in zip(*found, strict=True))
    return tuple(out), owner


def repeated_columns(groups: np.ndarray, bodies: list[bytes], offsets: np.ndarray, windows: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(string, first windows) of the windows that another string of the same group holds at the same column.

    groups must be sorted. offsets: where the anchor stands in each string; column 0 is the anchor.
    windows: how many windows begin a string's first bytes. The state is the strings' order by group and
    suffix, and each one's common prefix with the string before it.
    """
    sizes = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies))
    left, right = -offsets, sizes - offsets
    text = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    base = np.cumsum(sizes) - sizes - left  # text[base + column]
    hits: list[tuple[np.ndarray, int]] = []
    order, common = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    entering = np.argsort(-right, kind="stable")
    at = 0
    for column in range(int(right.max(initial=0)) - 1, int(left.min(initial=0)) - 1, -1):
        begun = at
        while at < len(entering) and right[entering[at]] > column:
            at += 1
        live = left[order] <= column
        if not live.all():
            common = carried(common, live)
            order = order[live]
        if at > begun:
            order = np.concatenate((order, entering[begun:at]))
            common = np.concatenate((common, np.zeros(at - begun, dtype=np.int64)))
        if not len(order):
            continue
        symbol = text[base[order] + column]
        key = groups[order] * 256 + symbol
        sort = np.argsort(key, kind="stable")
        same = np.concatenate(([False], key[sort[1:]] == key[sort[:-1]]))
        p, q = sort[:-1][same[1:]], sort[1:][same[1:]]
        fresh = np.zeros(len(order), dtype=np.int64)
        if len(p):
            bounds = np.stack((p + 1, q + 1), axis=1).ravel()
            fresh[same] = np.minimum.reduceat(np.append(common, 0), bounds)[::2] + 1
        order, common = order[sort], fresh
        long = common >= length
        if long.any():
            both = long | np.append(long[1:], False)
            found = order[both]
            found = found[column - left[found] < windows[found]]
            if len(found):
                hits.append((found, column))
    if hits:
        who = np.concatenate([f for f, _ in hits])
        where = np.concatenate([c - left[f] for f, c in hits])
        sort = np.lexsort((where, who))
        who, where = who[sort], where[sort]
        first, end = repeats.runs_of(who)
        for a, b in zip(first, end, strict=True):
            yield int(who[a]), where[a:b]


def carried(common: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Common prefixes of those that stay: the least of one's own and those of all that left since the last that stays."""
    stay = np.flatnonzero(live)
    if not len(stay):
        return np.zeros(0, dtype=np.int64)
    heads = np.concatenate(([0], stay[:-1] + 1))
    return np.minimum.reduceat(common[: stay[-1] + 1], heads)


OPENED = T.StructType([*[T.StructField(n, T.LongType()) for n in ("anchor", "k", "t", "start", "offset", "n", "w")], T.StructField("body", T.BinaryType())])
FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("k", "t", "span")])
KEPT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])


def compare(opened: DataFrame, length: int) -> DataFrame:
    """(k, t, span) of repeated windows among strings that share an anchor."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        _, group = np.unique(np.array([r[0] for r in rows]), return_inverse=True)
        arrays = [np.array([r[i] for r in rows], dtype=np.int64) for i in (4, 5)]
        k, t, spans = [], [], []
        for i, windows in repeated_columns(group, [r[6] for r in rows], *arrays, length):
            first, end = repeats.runs_of(windows - np.arange(len(windows)))
            for a, b in zip(first.tolist(), end.tolist(), strict=True):
                k.append(rows[i][1])
                t.append(rows[i][2])
                begin = rows[i][3] + int(windows[a])
                spans.append((begin << 32) + begin + b - a - 1 + length)
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in (k, t, spans)], names=FOUND.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(rows) >= BATCH and r[0] != rows[-1][0]:
                    yield solve(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield solve(rows)

    sorted_ = opened.select("anchor", "k", "t", "start", "offset", "n", "body").repartition("anchor").sortWithinPartitions("anchor")
    return sorted_.mapInArrow(run, FOUND)


def repeated_spans(scratch: Scratch, docs: DataFrame, length: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(k, t, span): byte spans of docs whose windows also start elsewhere."""
    rows = scratch.save(repeats.region_rows(docs, lambda texts: regions(texts, length, gram)), "regions")
    kinds = rows.groupBy("anchor", "region").agg(F.count("*").alias("times"), F.min(F.struct("k", "at")).alias("sample"))
    shared = kinds.groupBy("anchor").agg(F.sum("times").alias("total"), F.count("*").alias("kinds")).where("total > 1").select("anchor", "kinds")
    met = scratch.save(rows.join(kinds.join(shared, "anchor"), ["anchor", "region"]), "met")
    scratch.drop("regions")
    full = repeats.spans_of(met.where("times > 1"), length)
    samples = met.where("kinds > 1 and k = sample.k and at = sample.at").withColumn("hot", F.col("kinds") > hot)
    wanted = repeats.opened_texts(docs, samples, ["hot"])

    def opened_rows(part: Iterator[dict]) -> Iterator[tuple]:
        for r in part:
            text = repeats.unpack(r["z"])
            data, prefix = np.frombuffer(text, dtype=np.uint8), None
            for anchor, at, is_hot in zip(r["anchors"], r["ats"], r["hot"], strict=True):
                n, start = at & 1023, at >> 10 & 0xFFFFFFFF
                if is_hot:
                    prefix = _regions.prefix(_random[1][data]) if prefix is None else prefix
                    s = np.arange(start, start + n)
                    for w, one in zip(_regions.ranges(prefix, s, s + length).view(np.int64).tolist(), s.tolist(), strict=True):
                        yield anchor, r["k"], r["t"], one, None, 1, w, None
                else:
                    piece = data[start : start + n - 1 + length]
                    yield anchor, r["k"], r["t"], start, int(anchors(piece[:length], length, gram)[1][0]), n, None, piece.tobytes()

    opened = scratch.save(repeats.map_packed(wanted, opened_rows, OPENED, 32), "opened")
    near = compare(opened.where("body is not null"), length)
    counted = opened.where("w is not null")
    twice = counted.groupBy("anchor", "w").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    hashed = counted.join(twice, ["anchor", "w"]).select("k", "t", repeats.span(F.col("start"), F.col("start") + length))
    return full.union(near).union(hashed)


def remove_repeats(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every row of docs (doc_id, text) without its repeated bytes.

    A byte goes if a string of `length` bytes that covers it starts in any other place, of the same
    document or another; strings may overlap and are judged on the input. n_spans counts maximal removed runs.
    Null, empty and shorter texts lose nothing. Repeated rows are places of their own, so each loses all
    its windows. Null ids take part. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    docs = docs.select("doc_id", "text")
    spans = scratch.save(repeated_spans(scratch, docs, length), "spans")
    scratch.drop("met", "opened")

    def cut(part: Iterator[dict]) -> Iterator[tuple]:
        for r in part:
            text = repeats.unpack(r["z"])
            gone = repeats.covered(len(text), r["spans"])
            kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes() if gone.any() else text
            runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            yield None if r["k"] == repeats.NO_ID else r["k"], len(text), len(text) - len(kept), runs, kept

    return repeats.map_packed(repeats.with_spans(docs, spans), cut, KEPT)
