"""Bidirectional FM-index of a few delimited words in numpy, and a search that allows one error in a window of the pattern."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Symbols: end of text, delimiter, then code points in order.
END, DELIMITER, LETTER = 0, 1, 2
STEP = 64
#: States taken together, which bounds memory; intervals up to SMALL rows are read row by row for the symbols in them.
STATES, SMALL = 1 << 16, 64


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes (text ends with its only smallest symbol), by doubling prefixes."""
    n, width, rank = len(text), 1, text.astype(np.int64)
    while True:
        second = np.full(n, -1, dtype=np.int64)
        second[: max(0, n - width)] = rank[width:]
        both = rank * (max(n, int(rank.max())) + 2) + second + 1
        order = np.argsort(both, kind="stable")
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(both[order][1:] != both[order][:-1])])
        if fresh[order[-1]] == n - 1:
            return order
        rank, width = fresh, width * 2


class Ranks:
    """Burrows-Wheeler transform of a text with counts of each symbol, and of smaller ones, before any row."""

    def __init__(self, text: np.ndarray, symbols: int):
        bwt = text[suffix_order(text) - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        rows = -(-(len(bwt) + 1) // STEP)
        self.blocks = np.full((rows, STEP), 255, dtype=np.uint8)
        self.blocks.reshape(-1)[: len(bwt)] = bwt
        at = np.repeat(np.arange(rows), STEP)[: len(bwt)]
        counts = np.bincount(at * symbols + bwt, minlength=rows * symbols).reshape(rows, symbols)
        self.before = (np.cumsum(counts, axis=0) - counts).astype(np.int32)
        self.smaller = (np.cumsum(self.before, axis=1) - self.before).astype(np.int32)

    def upto(self, symbol: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the first `row` rows have this symbol, and how many a smaller one."""
        block, rest = row // STEP, row % STEP
        window, inside = self.blocks[block], np.arange(STEP) < rest[:, None]
        equal = ((window == symbol[:, None]) & inside).sum(axis=1)
        less = ((window < symbol[:, None]) & inside).sum(axis=1)
        return self.before[block, symbol] + equal, self.smaller[block, symbol] + less


class Index:
    """Index of distinct words, given in code point order as arrays of symbols; intervals are kept in the text and its reversal at once."""

    def __init__(self, words: list[np.ndarray], symbols: int):
        mark = np.array([DELIMITER], dtype=np.uint8)
        text = np.concatenate([mark, *(x for w in words for x in (w, mark))]).astype(np.uint8)
        end = np.array([END], dtype=np.uint8)
        self.symbols, self.words = symbols, len(words)
        self.ahead, self.back = Ranks(np.concatenate([text, end]), symbols), Ranks(np.concatenate([text[::-1], end]), symbols)

    def search(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(pattern, word): words that differ from a pattern by one symbol replaced in [low, high), or one inserted at low to high.

        Pattern p is flat[starts[p] : starts[p] + lengths[p]]. The longer of the exact ends is matched first, from its
        delimiter; then the match is extended across the window and the other end. A word's number is the
        rank of its delimiter's suffix.
        """
        forward = low >= lengths - high
        for way in (True, False):
            all_of = np.flatnonzero(forward == way)
            for at in range(0, len(all_of), STATES // 4):
                yield from self._one_way(all_of[at : at + STATES // 4], way, flat, starts, lengths, low, high)

    def _one_way(self, patterns: np.ndarray, forward: bool, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # Going back, pattern and window are mirrored and the two texts change places.
        ranks, first = (self.back, self.back.first) if forward else (self.ahead, self.ahead.first)
        begin, end = (low, high) if forward else (lengths - high, lengths - low)

        def symbol(p: np.ndarray, i: np.ndarray) -> np.ndarray:
            """The i-th symbol from where the search began, the delimiter past the end."""
            inside = i < lengths[p]
            place = np.where(inside, starts[p] + (i if forward else lengths[p] - 1 - i), 0)
            return np.where(inside, flat[place], DELIMITER).astype(np.int64)

        def extend(lo: np.ndarray, near: np.ndarray, size: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """lo: interval of the match in the text read this way; near: in the one read the other way, whose transform holds the next symbol."""
            a, less_a = ranks.upto(c, near)
            b, less_b = ranks.upto(c, near + size)
            return lo + less_b - less_a, first[c] + a, b - a

        n, start = len(patterns), np.int64(first[DELIMITER])
        held = [(patterns, np.zeros(n, np.int64), np.zeros(n, bool), np.full(n, start), np.full(n, start), np.full(n, self.words + 1, np.int64))]
        while held:
            p, i, erred, lo, near, size = held.pop()
            if len(p) > STATES:
                held += [tuple(x[k : k + STATES] for x in (p, i, erred, lo, near, size)) for k in range(0, len(p), STATES)]
                continue
            want, free = symbol(p, i), ~erred & (i >= begin[p])
            # The next symbol as it is: always after the error, before it only where the error can still come.
            go = np.flatnonzero(erred | (i < end[p]))
            states = [(p[go], i[go] + 1, erred[go], lo[go], near[go], size[go], want[go])]
            who, other = self._symbols(ranks, near, size, np.flatnonzero(free))
            change = (other != want[who]) & (i[who] < end[p[who]])
            insert = (other != want[who]) | (i[who] == end[p[who]])
            for chosen, step in ((change, 1), (insert, 0)):
                w = who[chosen]
                states.append((p[w], i[w] + step, np.ones(len(w), bool), lo[w], near[w], size[w], other[chosen]))
            p, i, erred, lo, near, size, c = (np.concatenate(x) for x in zip(*states, strict=True))
            parts = []
            for k in range(0, len(p), STATES):
                s = slice(k, k + STATES)
                lo2, near2, size2 = extend(lo[s], near[s], size[s], c[s])
                keep = size2 > 0
                done = keep & (c[s] == DELIMITER)
                if done.any():
                    ahead = lo2 if forward else near2
                    yield p[s][done], ahead[done] - start - 1  # the last delimiter, before the end, comes first
                keep &= ~done
                parts.append(tuple(x[keep] for x in (p[s], i[s], erred[s], lo2, near2, size2)))
            p, i, erred, lo, near, size = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else held_nothing()
            if len(p):
                held.append((p, i, erred, lo, near, size))

    def _symbols(self, ranks: Ranks, near: np.ndarray, size: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, symbol) for each letter that can follow each of the states."""
        few, many = who[size[who] <= SMALL], who[size[who] > SMALL]
        row = np.repeat(near[few] - np.cumsum(size[few]) + size[few], size[few]) + np.arange(size[few].sum())
        pairs = np.unique(np.repeat(few, size[few]) * 256 + ranks.blocks.reshape(-1)[row])
        state, c = pairs >> 8, pairs & 255
        letters = np.arange(LETTER, self.symbols)
        state = np.concatenate([state[c >= LETTER], np.repeat(many, len(letters))])
        return state, np.concatenate([c[c >= LETTER], np.tile(letters, len(many))])


def held_nothing() -> tuple[np.ndarray, ...]:
    return tuple(np.empty(0, np.int64) for _ in range(6))
