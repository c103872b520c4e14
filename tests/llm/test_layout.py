import math
import random
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import packing, secrets, sharding
from millrace.llm.common import Scratch, bucket

import corpus_pipeline


def test_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    bits = ["word", " ", "  ", "\n", "\n\n", " \n", "\t", "é", "don't", "'s", "123", "!?", " ", "\x1c", "日本", "<|endoftext|>", ".", "A"]
    encoder = packing.Encoder("byte_bpe_50k")
    for _ in range(1500):
        text = "".join(rng.choices(bits, k=rng.randrange(0, 14)))
        ids = whole.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == struct.pack(f"<{len(ids)}I", *ids), repr(text)


def laws(rows, docs, window=2048):
    """Pieces cover each document once; sequences have no gaps and fit; returns the share of padding."""
    encoder = packing.Encoder("byte_bpe_50k")
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    copies = {}
    for d, t in docs:
        copies.setdefault(d, []).append(encoder.encode(t or "") + packing.END)
    for d, ids in copies.items():
        got = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[d])
        want = []
        for x in ids:
            n = len(x) // 4
            at = packing.cuts(d, n, window)
            want += [(a, b - a, zlib.crc32(x[4 * a : 4 * b]), n) for a, b in zip(at, [*at[1:], n])]
        assert got == sorted(want)
    padded = used = 0
    for parts in by_seq.values():
        end = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= window and (parts[0]["tier"] == window or parts[0]["tier"] == end)
        used += end
        padded += end if math.log2(end).is_integer() else window
    assert sorted(by_seq) == list(range(len(by_seq)))
    return padded / used - 1


def test_packing_laws(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(500)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 20, 200, 700, 4000])))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (5, docs[5][1]), (None, "text without id"), (None, "another")]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, length int").repartition(4)
    assert laws(packing.pack(df).collect(), docs) < 0.02
    assert packing.pack(df.limit(0)).count() == 0
    same = [(i, " ".join(words[:400])) for i in range(400)]
    assert laws(packing.pack(spark.createDataFrame(same, "doc_id long, text string")).collect(), same) < 0.05


def test_plan_is_exact():
    rng = random.Random(3)
    for _ in range(20):
        counts = {rng.randrange(1, 2049): rng.randrange(1, 50) for _ in range(rng.randrange(1, 300))}
        out = packing.plan(counts)
        used = {}
        for tier, n, items in out.runs:
            total = sum(length * copies for length, copies in items)
            assert n > 0 and total <= 2048 and (tier == 2048 or total == tier)
            for length, copies in items:
                used[length] = used.get(length, 0) + n * copies
        assert used == counts


def check_shards(spark, rows, shards, whole=True):
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, shard int").repartition(5)
    out = sharding.shard(df, shards).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    want = sorted((d or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in out) == want
    homes = {}
    for r in out:
        homes.setdefault((r["text_crc32"], r["size"]), []).append(r["shard"])
    capacity = len(rows) // shards
    split = sum(len(set(h)) - math.ceil(len(h) / max(1, capacity)) for h in homes.values())
    assert split <= shards
    return homes


def test_sharding_laws(spark):
    rng = random.Random(4)
    rows = [(i, f"text {rng.randrange(150)} " + "x" * rng.randrange(3)) for i in range(400)]
    rows += [(i, "hot copy") for i in range(1000, 1200)] + [(None, "no id"), (None, None), (7, None), (8, "")]
    check_shards(spark, rows, 7)
    check_shards(spark, rows[:3], 40)
    near = [(i, f"{'shared beginning ' * 10}{i % 20} {'y' * (i % 9)}") for i in range(300)]
    homes = check_shards(spark, near + [(i + 1000, f"single {i}") for i in range(900)], 6)
    assert len({s for k, h in homes.items() if len(h) > 1 for s in h}) <= 4
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard(empty, 5).count() == 0


def test_propagation_equals_plain_loops(spark):
    """The rounds, replayed in plain Python with the same draws; and they cut fewer links than the start does."""
    rng = random.Random(9)
    shards, capacity, rounds = 5, 40, 3
    units = {f"u{i:03d}": rng.choice([1, 1, 1, 2, 5]) for i in range(110)}
    members = sorted({(u, rng.randrange(8) * 5 + rng.randrange(6)) for u in units for _ in range(3)})
    udf, mdf = spark.createDataFrame(list(units.items()), "unit string, n long"), spark.createDataFrame(members, "unit string, key long")
    scratch = Scratch(spark, "test")
    got = sharding.propagate(scratch, udf, mdf, shards, capacity, rounds)
    draws = {(r["unit"], k): r[f"d{k}"] for r in udf.select("unit", *[(F.pmod(F.xxhash64("unit", F.lit(k)), F.lit(1 << 20)) / float(1 << 20)).alias(f"d{k}") for k in range(1, rounds + 1)]).collect() for k in range(1, rounds + 1)}
    start = udf.select("unit", "n", bucket(["unit"], shards).alias("label"))
    label = {r["unit"]: r["label"] for r in start.collect()}
    for k in range(1, rounds + 1):
        load = [sum(n for u, n in units.items() if label[u] == s) for s in range(shards)]
        free = [max(0, capacity - x) for x in load]
        weight = {}
        for u, key in members:
            weight[key, label[u]] = weight.get((key, label[u]), 0) + units[u]
        offer = {}
        for (key, s), w in weight.items():
            offer[key] = max(offer.get(key, (-1.0, 0, 0, 0)), (w * (0.05 + free[s] / capacity), -s, s, w))
        ask = {}
        for u, key in members:
            ask[u] = max(ask.get(u, (-1, 0)), (offer[key][3], -offer[key][2]))
        wants = {u: -a[1] for u, a in ask.items() if -a[1] != label[u]}
        sums = [sum(units[u] for u, s in wants.items() if s == t) for t in range(shards)]
        for u, s in wants.items():
            if draws[u, k] < min(1.0, free[s] / sums[s]):
                label[u] = s
    assert {r["unit"]: r["label"] for r in got.collect()} == label
    assert sharding.cut_share(mdf, got) < sharding.cut_share(mdf, start)


def test_links_see_the_middle_of_texts(spark):
    rng = random.Random(10)
    words = [f"w{k}" for k in range(5000)]
    passage = " ".join(rng.choices(words, k=60))
    texts = [f"{' '.join(rng.choices(words, k=120))} {passage} {' '.join(rng.choices(words, k=120))}" for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None), (98, "four words are few")], "doc_id long, text string")
    keys = {r["doc_id"]: set(r["keys"]) for r in sharding.described(df).collect()}
    assert keys[99] == keys[98] == set()
    assert sum(bool(keys[i] & keys[j]) for i in range(40) for j in range(i)) >= 0.9 * 780


def test_pipeline_stages_and_rows(spark):
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "packing"]
    state = {r["doc_id"]: r["text"] for r in docs.collect()}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, base)
        assert at.columns == docs.columns
        now = {r["doc_id"]: r["text"] for r in at.collect()}
        assert now.keys() <= state.keys()
        if name == "secret_scan":
            assert now == {d: secrets.redact_text(t) for d, t in state.items()}
        else:
            assert all(state[d] == t for d, t in now.items())
        state = now
    assert laws(corpus_pipeline.run(spark, base).collect(), list(state.items())) < 0.05


def test_every_shared_passage_of_fifty_words_links():
    """1,500 pairs of texts that share 50 words: each pair shares a key. Sampled shingles lost about one pair in twenty."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(5000)]
    for _ in range(1500):
        passage = rng.choices(words, k=50)
        a, b = (" ".join([*rng.choices(words, k=rng.randrange(120)), *passage, *rng.choices(words, k=rng.randrange(120))]) for _ in range(2))
        keys = set(sharding.link_keys(a.encode()))
        assert keys & set(sharding.link_keys(b.upper().encode()))
        assert len(keys) <= 5 + len(a.split()) / 12
    assert sharding.least_of(np.array([5, 3, 4, 1, 2]), 3).tolist() == [3, 1, 1]
    assert sharding.least_of(np.array([5, 3]), 3).tolist() == [3]
