"""Spelling variants, the conversation trie and exact top-k against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from millrace.llm import fmindex, spelling, topk, trie


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


@pytest.mark.parametrize("letters, states", [("ab", 1 << 16), ("abcdefgh", 1 << 16), ("ab", 8)])
def test_index_finds_all_words_one_error_off(monkeypatch, letters, states):
    """Every window of every word, with intervals read by row and symbol by symbol."""
    monkeypatch.setattr(fmindex, "STATES", states)
    monkeypatch.setattr(fmindex, "SMALL", 4)
    rng = random.Random(len(letters) + states)
    words = sorted({"".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(120)})
    coded = [np.array([letters.index(c) + 2 for c in w], dtype=np.uint8) for w in words]
    index = fmindex.Index(coded, len(letters) + 2)
    asks = [(k, low, high) for k, w in enumerate(words) for low in range(len(w)) for high in range(low + 1, len(w) + 1)]
    of, low, high = np.array(asks, dtype=np.int64).T
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    got = {(int(a), int(b)) for p, w in index.search(np.concatenate(coded), (np.cumsum(sizes) - sizes)[of], sizes[of], low, high) for a, b in zip(p, w)}
    want = set()
    for a, (k, lo, hi) in enumerate(asks):
        w = words[k]
        for b, x in enumerate(words):
            replaced = len(x) == len(w) and any(x[:i] == w[:i] and x[i] != w[i] and x[i + 1 :] == w[i + 1 :] for i in range(lo, hi))
            inserted = len(x) == len(w) + 1 and any(x[:i] == w[:i] and x[i + 1 :] == w[i:] for i in range(lo, hi + 1))
            if replaced or inserted:
                want.add((a, b))
    assert got == want


def plain_variants(rows, drawn):
    n = collections.Counter()
    for d, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(c.lower() if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            n[r[: h % len(r)] + r[h % len(r) + 1 :] if h % drawn == 0 else r] += 1
    v = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in v if one_apart(w, x)] for w in v}
    form = {}
    for w, xs in near.items():
        if xs and v[best := min(xs, key=lambda x: (-v[x], x))] >= 2 * v[w]:
            form[w] = best
    out = []
    for w in v:
        root = w
        while root in form:
            root = form[root]
        out.append((w, v[w], len(near[w]), form.get(w), v.get(form.get(w)), root))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot, shard", [(20_000, 1 << 19), (3, 200)])
def test_variants_against_all_pairs(spark, monkeypatch, hot, shard):
    """Also with every key hot, so that windows are narrowed to one place, and with many small shards."""
    monkeypatch.setattr(spelling, "HOT", hot)
    monkeypatch.setattr(spelling, "SHARD", shard)
    rng = random.Random(5)
    stems = ["".join(rng.choices("aabcé×ß", k=rng.choice([5, 5, 6, 7, 9, 14]))) for _ in range(40)] + ["prefix" + x for x in "abcdefgh"] + ["x" * 300, "x" * 299, "x" * 301]
    rows = []
    for d in range(150):
        words = rng.choices(stems, k=30)
        words = [w if rng.random() < 0.7 else (w[: (k := rng.randrange(len(w)))] + rng.choice(["", "a", "z"]) + w[k + rng.randrange(2) :]) for w in words]
        rows.append((d, rng.choice([" ", "-", "1", "ł"]).join(w.upper() if rng.random() < 0.2 else w for w in words)))
    rows += [rows[3], (None, rows[4][1]), (None, None), (900, None), (901, ""), (902, " \n 12 "), (903, "aabbc " * 5000)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, n int").repartition(6)
    got = sorted((tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in spelling.variants(df, drawn=5).collect()), key=str)
    assert got == plain_variants(rows, 5)
    assert any(x[3] for x in got) and any(x[5] != x[3] for x in got if x[3])
    assert spelling.variants(df.limit(0)).count() == 0


def plain_trie(rows):
    talks = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            talks[c].append((t is not None, t or 0, r or "", x or ""))
    talks = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in talks.items()}
    new = {}
    for c in talks:
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = talks.get(c - int(math.fmod(c, 20)), [])[:h] + talks[c][h:]
    members = collections.defaultdict(list)
    for c, v in new.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * words
            leaves[p[:d]] += not children[p]
    return sorted(
        (
            (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(new[c]) == len(p)).encode()).hexdigest())
            for p, m in members.items()
        ),
        key=str,
    )


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def built_trie(df):
    return sorted((tuple(r[c] for c in TRIE) for r in trie.prefix_trie(df).collect()), key=str)


@pytest.mark.parametrize("block, ranged, piece", [(4, 1024, 13), (2, 2, 1)])
def test_trie_against_plain_tree(spark, monkeypatch, block, ranged, piece):
    """Also with ranges of two turns and two blocks, and lists of ends in pieces of two ids."""
    for name, value in (("BLOCK", block), ("RANGE", ranged), ("PIECE_BITS", piece)):
        monkeypatch.setattr(trie, name, value)
    rng = random.Random(6)
    rows, scripts = [], [[(rng.choice(["user", "assistant"]), f"turn {rng.randrange(3)}  x" * rng.randrange(1, 4)) for _ in range(rng.choice([1, 2, 3, 8, 13]))] for _ in range(12)]
    for c in [*range(-45, 90), 400, 12_000_000_000]:
        if c % 9:
            said = rng.choice(scripts)
            said = said[: rng.randrange(1, len(said) + 1)] + [("user", f"own {rng.randrange(4)}")] * rng.randrange(3)
            rows += [(c, 3 * k - 2, r, x) for k, (r, x) in enumerate(said)]
    rows += [(9, k, "user", "long") for k in range(60)] + [(18, k, "user", "long") for k in range(60)]
    rows += [(401, None, "user", "no turn"), (401, 0, None, None), (402, 1, "user", ""), (402, 1, "user", ""), (None, 1, "user", "lost"), (777, 0, "system", "alone")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, place string, n1 int").repartition(5)
    assert built_trie(df) == plain_trie(rows)


def test_trie_of_nothing_and_of_copies(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert built_trie(spark.createDataFrame([], kind)) == []
    assert built_trie(spark.createDataFrame([(None, 1, "user", "x")], kind)) == []
    copies = [(c, t, "user", f"same {t}") for c in range(600) for t in range(5)]
    assert built_trie(spark.createDataFrame(copies, kind)) == plain_trie(copies)
    bare = [(1, 0, "user", "x")]  # h is 3: its only turn goes, and there is no conversation 0
    assert built_trie(spark.createDataFrame(bare, kind)) == plain_trie(bare)


def plain_topk(rows, k=20, every=20):
    sound = [(i, d, [math.floor(64 * x) for x in v]) for i, (d, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, d, q in sound:
        if d is not None and d % every == 0:
            scored = [(-sum(a * b for a, b in zip(q, x)), e is None, e or 0) for j, e, x in sound if j != i]
            out += [(d, r, None if none else e, -s) for r, (s, none, e) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk, region", [(65_536, 2048), (40, 30)])
def test_topk_against_all_pairs(spark, monkeypatch, chunk, region):
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "REGION_ROWS", region)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 24))
    rows = [(int(i), [float(x) for x in (centres[rng.integers(6)] + rng.normal(size=24) * rng.choice([0.01, 0.3]))]) for i in rng.integers(-100, 900, size=500)]
    rows += [(1000 + i, list(map(float, centres[0]))) for i in range(120)]
    rows += [(2000, None), (2020, [float("nan")] * 24), (2040, [None, 1.0]), (2060, [float("inf")]), (2080, []), (2100, [1.0, -2.0]), (None, rows[0][1]), (None, rows[0][1]), (2120, [1e6] * 24)]
    df = spark.createDataFrame([(d, v, 1, "x") for d, v in rows], "vec_id long, embedding array<double>, chunk int, uid string").repartition(7)
    got = sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df).collect()), key=str)
    assert got == plain_topk(rows)
    assert topk.top_k(df.limit(0)).count() == 0
    few = df.where("vec_id >= 2080")
    assert sorted(tuple(r) for r in topk.top_k(few).select("query_id", "rank", "vec_id", "score").collect()) == plain_topk([(d, v) for d, v in rows if d is not None and d >= 2080])
    assert topk.top_k(df.where("embedding is null")).count() == 0


def test_topk_of_large_integers(spark):
    """Beyond 2^53 scores are worked out in integers."""
    rows = [(i, [float(2**24 - i), float(2**23 + 3 * i), 1.0 + i]) for i in range(41)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in topk.top_k(df).select("query_id", "rank", "vec_id", "score").collect()), key=str) == plain_topk(rows)
