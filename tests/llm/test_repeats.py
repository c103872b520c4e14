import random

import numpy as np

from millrace.llm import repeats, substring, suffix


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(500)]
    line = " ".join(rng.choices(words, k=20))
    passage = " ".join(rng.choices(words, k=70))
    texts = []
    for _ in range(n):
        t = rng.choices(words, k=rng.choice([3, 49, 50, 120, 400]))
        kind = rng.randrange(8)
        if kind == 0 and texts:
            t = rng.choice(texts).split(" ")
        elif kind == 1 and texts:
            t = rng.choice(texts).split(" ")
            t[rng.randrange(len(t))] = "edited"
        elif kind == 2:
            at = rng.randrange(len(t))
            t = t[:at] + passage.split(" ") + t[at:]
        elif kind == 3:
            t = t + [rng.choice(words)] * 120 + t[:5]
        elif kind == 4:
            t = rng.choices(words, k=3) * 60
        elif kind == 5:
            t = t + line.split(" ") + t
        texts.append(rng.choice([" ", " ", "\n", " \t"]).join(t))
    return texts + [None, "", "  ", "é" * 450, "é" * 450 + "a", "x" * 1200]


def brute_words(rows, length=50):
    starts = {}
    cut = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in cut:
        if d is not None:
            for s in range(len(w) - length + 1):
                key = tuple(w[s : s + length])
                starts[key] = min(starts.get(key, d), d)
    out = []
    for d, w in cut:
        gone = np.zeros(len(w), bool)
        if d is not None:
            for s in range(len(w) - length + 1):
                if starts[tuple(w[s : s + length])] < d:
                    gone[s : s + length] = True
        out.append((d, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def brute_bytes(rows, length=400):
    count = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for _, t in raw:
        for s in range(len(t) - length + 1):
            key = t[s : s + length]
            count[key] = count.get(key, 0) + 1
    out = []
    for d, t in raw:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if count[t[s : s + length]] > 1:
                gone[s : s + length] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(t), int(gone.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return sorted(out, key=str)


def rows_of(seed):
    texts = corpus(seed)
    rng = random.Random(seed)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    return rows + [rows[3], rows[10], (None, texts[2]), (None, texts[5]), (rows[4][0], texts[6])]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, anchor int").repartition(5)


def test_words_against_brute_force(spark):
    for seed in (1, 2):
        rows = rows_of(seed)
        got = sorted((tuple(r) for r in substring.remove_repeats(frame(spark, rows)).collect()), key=str)
        assert got == brute_words(rows)


def test_bytes_against_brute_force(spark, monkeypatch):
    for seed, hot in ((1, 4096), (2, 1), (3, 3)):
        monkeypatch.setattr(suffix.repeated_spans, "__defaults__", (400, 64, hot))
        rows = rows_of(seed)
        got = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix.remove_repeats(frame(spark, rows)).collect()), key=str)
        assert got == brute_bytes(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring.remove_repeats(df).count() == 0
    assert suffix.remove_repeats(df).count() == 0


def test_symbols_are_consistent():
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 30, 200).astype(np.uint64)
    a = np.concatenate((rng.integers(0, 30, 77).astype(np.uint64), shared, rng.integers(0, 30, 50).astype(np.uint64)))
    b = np.concatenate((rng.integers(0, 30, 13).astype(np.uint64), shared, rng.integers(0, 30, 90).astype(np.uint64)))
    for (n1, l1, h1), (n2, l2, h2) in zip(substring.symbols(a), substring.symbols(b)):
        one = {(int(x), l - 77, h - 77) for x, l, h in zip(n1, l1, h1) if l >= 77 and h <= 277}
        two = {(int(x), l - 13, h - 13) for x, l, h in zip(n2, l2, h2) if l >= 13 and h <= 213}
        assert one == two and one


def test_long_texts_are_cut_in_parts(spark, monkeypatch):
    """Regions cover all windows once, and are the same for texts taken alone, together and in parts."""
    texts = [(t or "").encode() for _, t in rows_of(5)[:30]]
    for module, part, size, length in ((substring, 64, lambda t: len(t.split()), 50), (suffix, 500, len, 400)):
        alone = [module.regions([t])[0] for t in texts]
        assert all(int(r[3].sum()) == max(0, size(t) - length + 1) for r, t in zip(alone, texts))
        together, owner = module.regions(texts)
        for i, r in enumerate(alone):
            assert all((a[owner == i] == b).all() for a, b in zip(together, r))
        monkeypatch.setattr(module, "PART", part)
        assert all(int(module.regions([t])[0][3].sum()) == max(0, size(t) - length + 1) for t in texts)


def test_repeated_rows_are_opened_once(spark):
    """200 equal rows, some without id: what is opened grows with the texts, not with the rows."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    base = rng.choices(words, k=300)
    other = base[:150] + rng.choices(words, k=150)
    rows = [(1, " ".join(base))] * 200 + [(2, " ".join(other))] + [(None, " ".join(other[:200]))] * 50 + [(3, " ".join(rng.choices(words, k=200)))]
    df = frame(spark, rows)
    got = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix.remove_repeats(df).collect()), key=str)
    assert got == brute_bytes(rows)
    got = sorted((tuple(r) for r in substring.remove_repeats(df).collect()), key=str)
    assert got == brute_words(rows)
    regions = spark.createDataFrame([(5, 1, 7), (5, 1, 7), (6, 1, 9)], "anchor long, k long, at long")
    one = spark.createDataFrame([(1, "x")] * 40, "doc_id long, text string")
    tag = repeats.text_tag(b"x")
    wanted = regions.withColumn("at", regions["at"] + (tag << 42))
    (row,) = repeats.opened_texts(one, wanted, []).collect()
    assert sorted(row["anchors"]) == [5, 6]


def test_passages_against_brute_force_over_many_partitions(spark, monkeypatch):
    """Passages of 51 to 90 words, many copies, repeats inside a document; 211 partitions."""
    rng = random.Random(8)
    for n, parts in ((80, 7), (160, 211)):
        words = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(800)]
        passages = [rng.choices(words, k=rng.randrange(51, 91)) for _ in range(6)]
        rows = []
        for i in range(n):
            t = rng.choices(words, k=rng.randrange(20, 200))
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(t))
                t[at:at] = passages[min(5, int(rng.expovariate(0.8)))]
            rows.append((i, " ".join(t + t[:90] if i % 9 == 0 else t)))
        rows += [(n + i, rows[0][1]) for i in range(n // 3)]
        df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, at int").repartition(parts)
        got = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix.remove_repeats(df).collect()), key=str)
        assert got == brute_bytes(rows)
        got = sorted((tuple(r) for r in substring.remove_repeats(df).collect()), key=str)
        assert got == brute_words(rows)
