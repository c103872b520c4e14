import random

import pytest
from millrace.llm import jaccard, simhash


def shingles(text):
    w = (text or "").casefold().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    """Ids of the rows that stay, by comparing all pairs."""
    s, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] == s[j] or 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def near_copies(rng, groups, copies, line=""):
    words, rows = [f"w{k}" for k in range(2000)], []
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([3, 6, 30, 120, 400]))
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w) + line))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("paired, common", [(64, 8), (2, 8), (2, 10**6)])
def test_keep_first_against_brute_force(spark, monkeypatch, paired, common):
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "SAMPLED", 1)
    rng = random.Random(7)
    rows = near_copies(rng, 25, 7) + [(1000 + d, t) for d, t in near_copies(rng, 15, 5, " the same very common line of a few words" * 2)]
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "One  two"), (5004, "one two"), (5005, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(r["doc_id"] for r in simhash.keep_first(df).collect()) == brute(rows)


def test_rows_grow_with_texts_that_share_a_passage(spark, monkeypatch):
    """170 shared and 30 own words (similarity 0.74): compared pairs stay in proportion to the texts."""
    made, whole = [], jaccard.similar

    def counted(scratch, docs, nodes, pairs, name):
        made.append(pairs.count())
        return whole(scratch, docs, nodes, pairs, name)

    monkeypatch.setattr(jaccard, "similar", counted)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(5000)]
    shared = " ".join(rng.choices(words, k=170))
    for n in (1000, 4000):
        made.clear()
        rows = [(d, " ".join([*rng.choices(words, k=15), shared, *rng.choices(words, k=15)])) for d in range(n)]
        rows += [(n, rows[5][1] + " end"), (n + 1, "start " + rows[5][1])]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert simhash.keep_first(df).count() == n
        assert sum(made) < 2 * n


def test_fingerprint_search_comes_first(spark, monkeypatch):
    """Sets within two bits are found by Golay keys and compared; what they link is not paired again, and the rest is completed."""
    made, whole = {}, jaccard.similar

    def noted(scratch, docs, nodes, pairs, name):
        made[name] = {(r["a"], r["b"]) for r in pairs.collect()}
        return whole(scratch, docs, nodes, pairs, name)

    monkeypatch.setattr(jaccard, "similar", noted)
    rng = random.Random(11)
    words = [f"w{k}" for k in range(5000)]
    rows = []
    for _ in range(40):
        base = rng.choices(words, k=600)
        for changed in (0, 1, 2, 20):
            w = list(base)
            for at in rng.sample(range(600), changed):
                w[at] = "changed"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(r["doc_id"] for r in simhash.keep_first(df).collect()) == brute(rows)
    sets = [jaccard.shingle_set(t.encode()) for _, t in rows]
    prints = {jaccard.node_of(s): jaccard.fingerprint(s) for s in sets}
    nodes = sorted(prints)
    least = {prints[a]: a for a in reversed(nodes)}
    near = {(least[prints[a]], a) for a in nodes if least[prints[a]] != a}
    near |= {(min(a, b), max(a, b)) for f, a in least.items() for g, b in least.items() if f < g and bin((f ^ g) & ((1 << 64) - 1)).count("1") <= 2}
    assert made["near"] == near and len(near) > 20
    assert made["rest"] and not made["rest"] & near


def test_large_keys_place_rows_once(spark, monkeypatch):
    """With keys above PAIRED: rows of keys get components in saved tables, so no plan of pairs works them out again for each side, and passes stay few."""
    plans, closed, whole, joined = {}, [], jaccard.similar, jaccard.components

    def noted(scratch, docs, nodes, pairs, name):
        plans[name] = pairs._jdf.queryExecution().optimizedPlan().toString()
        return whole(scratch, docs, nodes, pairs, name)

    def counted(scratch, links):
        closed.append(1)
        return joined(scratch, links)

    monkeypatch.setattr(jaccard, "PAIRED", 2)
    monkeypatch.setattr(jaccard, "similar", noted)
    monkeypatch.setattr(jaccard, "components", counted)
    rows = near_copies(random.Random(5), 20, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(r["doc_id"] for r in simhash.keep_first(df).collect()) == brute(rows)
    assert list(plans) == ["near", "1", "rest"] and len(closed) == 3
    assert not any("LeftOuter" in p for p in plans.values())
