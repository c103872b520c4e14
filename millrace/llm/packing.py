"""Hierarchical multi-length packing of token sequences."""

from __future__ import annotations

import base64
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Scratch, map_texts, salted_rank

WINDOW = 2048
TIERS = (256, 512, 1024)
STEP_TOKENS = 8 * WINDOW
END = struct.pack("<I", 1)
REMEMBERED = 100_000
#: A space next to other white space: where splitting at spaces could part what the tokenizer takes together.
ADJACENT = re.compile(r" \s|\s ")


class Words(dict):
    """Little-endian 32-bit ids of a space and a word, by the word; forgets all when it has grown too large."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.encode(" " + word)
        out = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return out


class Encoder:
    """Ids of a byte-level BPE vocabulary given as tokenizers JSON and as tiktoken ranks.

    Such a tokenizer takes one space with the word after it, so a text is split at its spaces and each
    word's ids are remembered. Texts with a space beside other white space are encoded whole; texts that
    spell a special token go to the JSON tokenizer itself.
    """

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        self.json = public_tokenizers.path(f"{name}.json")
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = Words(self.fast.encode_ordinary)
        self.whole = None

    def encode(self, text: str) -> bytes:
        if "<|endoftext|>" in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.json)
            ids = self.whole.encode(text, add_special_tokens=False).ids
        elif ADJACENT.search(text):
            ids = self.fast.encode_ordinary(text)
        else:
            first, *rest = text.split(" ")
            ids = self.fast.encode_ordinary(first)
            return struct.pack(f"<{len(ids)}I", *ids) + b"".join(map(self.words.__getitem__, rest))
        return struct.pack(f"<{len(ids)}I", *ids)


def cuts(doc_id: int | None, tokens: int, window: int) -> list[int]:
    """Where a document is cut: at each full window, and, for some documents, in what is left.

    As many copies of the rest as fit leave a gap in a window. A share of the documents (the gap's share of the
    window and a quarter more, drawn by the id) has its rest cut into pieces of the gap's size, so that a corpus full
    of one length can fill its own gaps. Gaps under a 32nd of the window are left to other documents.
    """
    at = list(range(0, tokens, window))
    rest = tokens - at[-1]
    gap = window % rest
    if gap >= window // 32 and zlib.crc32(f"{doc_id}:{tokens}".encode()) % 1024 < gap * 1280 // window:
        at += range(at[-1] + gap, tokens, gap)
    return at


PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k", window: int = WINDOW) -> DataFrame:
    def rows(part: Iterator[tuple]) -> Iterator[tuple]:
        global _encoder
        if _encoder is None or _encoder[0] != tokenizer:
            _encoder = (tokenizer, Encoder(tokenizer))
        for doc_id, text in part:
            ids = _encoder[1].encode((text or b"").decode("utf-8", "replace")) + END
            tokens = len(ids) // 4
            at = cuts(doc_id, tokens, window)
            for a, b in zip(at, [*at[1:], tokens], strict=True):
                yield doc_id, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), tokens

    return map_texts(docs, ["doc_id"], rows, PIECES)


_encoder: tuple[str, Encoder] | None = None


@dataclass
class Plan:
    """Where the r-th piece of each length goes. Runs of alike sequences; a few entries for each length."""

    window: int
    runs: list[tuple[int, int, list[tuple[int, int]]]] = field(default_factory=list)  # tier, sequences, (length, copies)

    def table(self) -> pd.DataFrame:
        """length, first rank, copies a sequence, first sequence, offset, tier, first sequence of the tier, first step of the tier."""
        used: dict[int, int] = {}
        rows, sequence, tier_at, step = [], 0, {}, 0
        for tier, n, items in sorted(self.runs, key=lambda r: r[0]):
            if tier not in tier_at:
                if tier_at:
                    last, (begun, step_begun) = next(reversed(tier_at.items()))
                    step = step_begun - (-(sequence - begun) // max(1, STEP_TOKENS // last))
                tier_at[tier] = (sequence, step)
            offset = 0
            for length, copies in items:
                rows.append((length, used.get(length, 0), copies, sequence, offset, tier, *tier_at[tier]))
                used[length] = used.get(length, 0) + n * copies
                offset += length * copies
            sequence += n
        return pd.DataFrame(rows, columns=["length", "rank", "copies", "sequence", "offset", "tier", "tier_sequence", "tier_step"], dtype="int64").sort_values(["length", "rank"])


def plan(counts: dict[int, int], window: int = WINDOW, tiers: tuple[int, ...] = TIERS) -> Plan:
    """Pack a histogram of piece lengths (at most `window` entries, so its size is bounded).

    A piece is routed to the smallest tier that holds it. Each short tier keeps the sequences that it can
    fill exactly, with one piece or two, using at most half of the pieces of a length as partners;
    all other pieces go to full windows: the longest first, its gap filled again and again with the
    longest pieces that still fit.
    """
    left = {n: c for n, c in counts.items() if c}
    out = Plan(window)

    def take(tier: int, n: int, items: list[tuple[int, int]]) -> None:
        out.runs.append((tier, n, items))
        for length, copies in items:
            left[length] -= n * copies
            if not left[length]:
                del left[length]

    for tier in tiers:
        for length in [n for n in sorted(left, reverse=True) if tier // 2 <= n <= tier]:
            if length not in left:
                continue
            rest = tier - length
            if length == tier:
                take(tier, left[length], [(length, 1)])
            elif rest == length and left[length] > 1:
                take(tier, left[length] // 2, [(length, 2)])
            elif rest != length and (n := min(left[length], left.get(rest, 0) // 2)):
                take(tier, n, [(length, 1), (rest, 1)])
    lengths = sorted(left)
    while left:
        while lengths[-1] not in left:
            lengths.pop()
        gap, at, items = window, len(lengths), []
        while gap and (at := min(at, bisect_right(lengths, gap))):
            length = lengths[at - 1]
            if copies := min(gap // length, left.get(length, 0)):
                items.append((length, copies))
                gap -= length * copies
            elif length not in left:
                lengths.pop(at - 1)
            at -= 1
        take(window, min(left[n] // c for n, c in items), items)
    return out


#: Pieces a bucket, where pieces of a length are ranked in buckets.
RANKED = 200_000


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", window: int = WINDOW, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Pack all rows of docs (doc_id, text) into sequences of at most `window` tokens: one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group. tier is
    the sequence's context size: a power of two that it fills exactly, or the window, to which it is
    padded. Steps hold equal numbers of tokens of one tier. Null and empty texts are the end id alone.
    Repeated rows are packed each; null ids too; other columns are ignored. The texts are
    tokenised once and never shuffled: only pieces' numbers are ranked within their length, in salted
    buckets. The plan is made from the histogram of lengths, at most `window` rows.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.save(pieces(docs, tokenizer, window), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = plan(counts, window, tiers).table()
    key = (table["length"].to_numpy() << 40) + table["rank"].to_numpy()
    fields = {c: table[c].to_numpy() for c in table}

    @F.pandas_udf("sequence_id long, offset long, tier long, step_group long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(key, (length.to_numpy() << 40) + rank.to_numpy(), side="right") - 1
        beyond = rank.to_numpy() - fields["rank"][at]
        copies, tier = fields["copies"][at], fields["tier"][at]
        sequence = fields["sequence"][at] + beyond // copies
        offset = fields["offset"][at] + length.to_numpy() * (beyond % copies)
        step = fields["tier_step"][at] + (sequence - fields["tier_sequence"][at]) // np.maximum(1, STEP_TOKENS // tier)
        return pd.DataFrame({"sequence_id": sequence, "offset": offset, "tier": tier, "step_group": step})

    ranked = salted_rank(cut, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"], "rank", max(64, sum(counts.values()) // RANKED))
    return ranked.withColumn("at", place("length", "rank")).select(*PIECES.names, "at.*")
