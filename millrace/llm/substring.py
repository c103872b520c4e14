"""Substring dedup by recompression.

A text is a string of words. A round first names maximal runs of one symbol, then splits the symbols in
two classes by a bit of their names and names each pair (first class, second class). Names are 64-bit
digests of what they stand for, so they are global: equal substrings get equal interior symbols in every
document, without a dictionary to shuffle. Each symbol also carries how far its making looked to either
side; a symbol whose reach lies inside a window is there in every equal window. A window's anchor is the
smallest-hash symbol of the highest level whose reach it contains (level 0, the words, always has one),
named by all words in that reach. What is shared is then settled by the frame in `repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import repeats
from millrace.llm.common import Scratch
from millrace.llm.repeats import Rolling, mix

WINDOW = 50
ROUNDS = 3
PART = 1 << 19  # words looked at together
REMEMBERED = 200_000
BETWEEN = b" "  # no word


class Vocabulary(dict):
    """Two 64-bit hashes of each word, remembered; forgotten when there are too many."""

    def __init__(self):
        super().__init__()
        self.table = np.zeros((1 << 12, 2), dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        h = xxhash.xxh3_128_intdigest(word)
        self.table[n, 0], self.table[n, 1] = h & (1 << 64) - 1, h >> 64
        self[word] = n
        return n

    def lookup(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > REMEMBERED:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return self.table[at, 0], self.table[at, 1]


_vocabulary = Vocabulary()
_anchors, _regions = Rolling(0x9E3779B97F4A7C15), Rolling(0xC2B2AE3D27D4EB4F)


def symbols(words: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(name, reach begin, reach end) of the symbols of each level, level 0 the words. A reach past an end of the text lies outside it."""
    n = len(words)
    name, lo, hi = words, np.arange(n), np.arange(1, n + 1)
    out = [(name, lo, hi)]
    for k in range(rounds):
        head = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        size = np.diff(np.append(head, len(name)))
        before, after = np.concatenate(([-1], lo[:-1])), np.concatenate((hi[1:], [n + 1]))
        tail = head + size - 1
        name = np.where(size > 1, mix(name[head] * np.uint64(3) + size.astype(np.uint64)), name[head])
        lo, hi = before[head], after[tail]
        first = (mix(name + np.uint64(k + 1)) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(name), dtype=bool)
        joins[:-1] = first[:-1] & ~first[1:]
        taken = np.concatenate(([False], joins[:-1]))
        before, after = np.concatenate(([-1], lo[:-1])), np.concatenate((hi[1:], [n + 1]))
        fused = mix(name[:-1] * np.uint64(5) + mix(name[1:] + np.uint64(7)))
        new = name.copy()
        new[:-1][joins[:-1]] = fused[joins[:-1]]
        left = np.where(~first & ~taken, before, lo)
        right = np.where(first, after, hi)  # of a pair: the reach of its second symbol
        name, lo, hi = new[~taken], left[~taken], right[~taken]
        out.append((name, lo, hi))
    return out


def window_anchors(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Level and symbol index of each window's anchor; windows are given by their starts."""
    level, chosen = np.full(len(windows), -1), np.zeros(len(windows), dtype=np.int64)
    open_ = np.arange(len(windows))
    low = np.uint64((1 << 20) - 1)
    for k in range(len(levels) - 1, -1, -1):
        name, lo, hi = levels[k]
        a = np.searchsorted(lo, windows[open_], side="left")
        b = np.searchsorted(hi, windows[open_] + length, side="right")
        some = b > a
        if some.any():
            key = (mix(name) & ~low) | np.arange(len(name), dtype=np.uint64)
            depth = int(np.log2(max(1, (b - a).max()))) + 1
            least = np.full((depth, len(key)), np.iinfo(np.uint64).max, dtype=np.uint64)
            least[0] = key
            for d in range(1, depth):
                half = 1 << (d - 1)
                np.minimum(least[d - 1, :-half], least[d - 1, half:], out=least[d, :-half])
            a, b, which = a[some], b[some], open_[some]
            d = np.log2(b - a).astype(np.int64)
            level[which] = k
            chosen[which] = (np.minimum(least[d, a], least[d, b - (1 << d)]) & low).astype(np.int64)
            open_ = open_[~some]
        if not len(open_):
            break
    return level, chosen


def regions(texts: list[bytes], length: int = WINDOW) -> tuple[repeats.Regions, np.ndarray]:
    """Anchor hash, region hash, first window and number of windows of each region of some texts, and which text each is of.

    The texts are taken together, with a word of its own between two; no window holds it, so symbols whose making saw it are no anchors.
    """
    words = [t.split() for t in texts]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    bases = np.cumsum(sizes + 1) - sizes - 1
    line = list(chain.from_iterable((*w, BETWEEN) for w in words))
    found: list[tuple[np.ndarray, ...]] = []
    starts = repeats.window_starts(sizes, bases, length)
    for at in range(0, len(line), PART):
        windows = starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + PART)] - at
        if len(windows):
            one, two = _vocabulary.lookup(line[at : at + PART + length - 1])
            begin, *rest = _regions_of(one, two, windows, length)
            owner = np.searchsorted(bases, begin + at, side="right") - 1
            found.append((*rest[:2], begin + at - bases[owner], rest[2], owner))
    if not found:
        return repeats.NO_REGIONS, np.zeros(0, dtype=np.int64)
    *out, owner = (np.concatenate(c) for c in zip(*found, strict=True))
    return tuple(out), owner


def _regions_of(one: np.ndarray, two: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """First window, anchor hash, region hash and number of windows of the regions of some windows."""
    levels = symbols(one)
    level, chosen = window_anchors(levels, windows, length)
    first, end = repeats.runs_of(chosen * len(levels) + level)
    lo, hi = np.zeros(len(first), dtype=np.int64), np.zeros(len(first), dtype=np.int64)
    for k, (_, left, right) in enumerate(levels):
        mine = level[first] == k
        lo[mine], hi[mine] = left[chosen[first[mine]]], right[chosen[first[mine]]]
    begin = windows[first]
    anchor = mix(_anchors.ranges(_anchors.prefix(one), lo, hi) + level[first].astype(np.uint64))
    region = mix(_regions.ranges(_regions.prefix(two), begin, windows[end - 1] + length) + (lo - begin).astype(np.uint64))
    return begin, anchor, region, end - first


WINDOWS = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor", "w", "k", "t", "s")])
KEPT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


def repeated_spans(scratch: Scratch, docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """(k, t, span): word spans of docs that repeat a window of a document with a smaller id."""
    rows = scratch.save(repeats.region_rows(docs.where("doc_id is not null"), regions), "regions")
    kinds = rows.groupBy("anchor", "region").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    shared = kinds.groupBy("anchor").agg(F.min("first").alias("lowest"), F.max("last").alias("highest"), F.count("*").alias("kinds")).where("lowest < highest").select("anchor", "kinds")
    met = scratch.save(rows.join(kinds.join(shared, "anchor").drop("last"), ["anchor", "region"]), "met")
    scratch.drop("regions")
    full = repeats.spans_of(met.where("first < k"), length)
    wanted = repeats.opened_texts(docs, met.where("first = k and kinds > 1"), [])

    def windows(part: Iterator[dict]) -> Iterator[tuple]:
        for r in part:
            words = repeats.unpack(r["z"]).split()
            prefix = _regions.prefix(_vocabulary.lookup(words)[1])
            at = np.array(r["ats"], dtype=np.int64)
            n, start = at & 1023, at >> 10 & 0xFFFFFFFF
            s = np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            h = _regions.ranges(prefix, s, s + length).view(np.int64)
            yield from zip(np.repeat(np.array(r["anchors"], dtype=np.int64), n).tolist(), h.tolist(), [r["k"]] * len(s), [r["t"]] * len(s), s.tolist(), strict=True)

    opened = scratch.save(repeats.map_packed(wanted, windows, WINDOWS, 64), "windows")
    first = opened.groupBy("anchor", "w").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last").drop("last")
    later = opened.join(first, ["anchor", "w"]).where("first < k")
    return full.union(later.select("k", "t", repeats.span(F.col("s"), F.col("s") + length)))


def remove_repeats(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every row of docs (doc_id, text) without its repeated words.

    Words are runs of bytes other than space and 0x09-0x0D. A word goes if a window of `length` words
    that covers it also starts in a document with a smaller doc_id; windows are judged on the input. kept
    joins the others with one space. Null, empty and shorter texts lose nothing. Repeated rows of one id
    don't count against each other; rows with a null id neither lose words nor cost others any. Other
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    docs = docs.select("doc_id", "text")
    spans = scratch.save(repeated_spans(scratch, docs, length), "spans")
    scratch.drop("met", "windows")

    def cut(part: Iterator[dict]) -> Iterator[tuple]:
        for r in part:
            words = repeats.unpack(r["z"]).split()
            gone = repeats.covered(len(words), r["spans"])
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
            yield None if r["k"] == repeats.NO_ID else r["k"], len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace")

    return repeats.map_packed(repeats.with_spans(docs, spans), cut, KEPT)
