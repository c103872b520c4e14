import random

import numpy as np
import xxhash
from millrace.llm import simhash


def brute(rows):
    """component_id by comparing all pairs."""
    fps = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")
        w = [x for x in w if x]
        g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
        fps.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d if d is not None else -1), f"{fps[i]:016x}", least.get(find(i), -1)) for i, (d, _) in enumerate(rows))


def got(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select("doc_id", "fingerprint", "component_id").collect())


def test_golay_keys_meet():
    code, rng = simhash.Golay(), np.random.default_rng(0)
    assert code.count.min() == 1 and code.count.max() == 6
    words = rng.integers(0, 1 << 23, 2000)
    base, has = code.indices(words)
    for bit in range(23):
        other, has2 = code.indices(words ^ (1 << bit))
        assert all(set(a[x]) & set(b[y]) for a, x, b, y in zip(base, has, other, has2))


def test_every_close_pair_shares_a_key():
    rng, code = np.random.default_rng(1), simhash.Golay()
    a = rng.integers(-(1 << 63), 1 << 63, 3000, dtype=np.int64)
    b = a.copy()
    for k in range(len(b)):
        for bit in rng.choice(64, rng.integers(1, 3), replace=False):
            b[k] ^= np.int64(np.uint64(1 << int(bit)).view(np.int64))
    ka, kb = {}, {}
    for keys, d in ((simhash.golay_keys(a, code), ka), (simhash.golay_keys(b, code), kb)):
        for k, f in zip(*keys):
            d.setdefault(int(f), set()).add(int(k))
    assert all(ka[int(x)] & kb[int(y)] for x, y in zip(a, b))


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for d in range(60):
        w = rng.choices(words, k=rng.choice([1, 2, 3, 40, 300]))
        rows.append((d * 7 % 61, " ".join(w)))
        for _ in range(rng.randrange(3)):
            v = list(w)
            v[rng.randrange(len(v))] = "Changed"
            rows.append((100 + len(rows), "\t".join(v)))
    rows += [(500, None), (501, ""), (None, " \n "), (502, "Ä b"), (502, "Ä b"), (503, "ä b"), (None, "solo text here now")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int").repartition(5)
    assert got(simhash.near_duplicates(df)) == brute(rows)


def test_hot_key_goes_through_variants(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(400)]
    rows = []
    for d in range(150):
        w = list(base)
        for _ in range(d % 4):
            w[rng.randrange(len(w))] = f"x{d}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert got(simhash.near_duplicates(df)) == want
    monkeypatch.setattr(simhash, "PAIRED", 2)
    assert got(simhash.near_duplicates(df)) == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
