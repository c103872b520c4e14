"""Quality classifier: a weak-label model (EM over overlapping heuristic labellers) and a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Scratch, lengths, map_texts, parts
from millrace.llm.repeats import mix

BITS = 15
#: Bound of the training sample: about so many rows, drawn by a hash of the id from all rows.
SAMPLE = 20_000
#: Bound of the labelled rows, drawn likewise, from which the lists of suspect word beginnings are learned.
TAUGHT = 20_000
#: Longest list of word beginnings of a family, and how often a listed one occurs in abusive and how much rarer in other texts.
LISTED, SEEN, TIMES = 2_000, 4, 25.0
#: Bytes of the word beginnings of each family, and how many different words of a text must share one.
FAMILIES = {"once": ((5, 6, 7), 1), "twice": ((3, 4, 5, 6), 2)}
SIZES = (3, 4, 5, 6, 7)
START_BITS = 20
ABSTAIN, BAD, GOOD = 0, 1, 2

#: Insults that the tone labellers look for.
INSULTS = frozenset("clown disgusting dumb dumbass garbage idiot idiots loser losers moron morons pathetic scum stupid trash worthless".split())
#: Frequent short words of English, by which a text counts as English.
ENGLISH = frozenset("the of and in to is that it for was on are with as be by this have from or".split())
MARKS = b"*#%&$@^~=<>{}[]\\_+"


def describe(raw: bytes) -> dict[str, float]:
    """Figures of a text's form that the labellers share."""
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    same = sum(map(bytes.__eq__, words, words[1:]))
    distinct = len(set(words))
    return {
        "n": n,
        "repeat": same / max(1, n),
        "variety": distinct / max(1.0, n**0.75),
        "upper": upper / max(1, upper + lower),
        "bang": int(counts[33]) / max(1, n),
        "marks": int(counts[list(MARKS)].sum()) / max(1, n),
        "pipes": int(counts[124]) / max(1, n),
        "letters": (upper + lower + int(counts[128:].sum())) / size,
        "stops": int(counts[46]) / max(1, n),
        "longest": size / max(1, n),
    }


def two_sided(value: float, bad: float, good: float) -> int:
    """BAD beyond one bound, GOOD beyond the other, nothing between them."""
    if bad > good:
        return BAD if value > bad else GOOD if value < good else ABSTAIN
    return BAD if value < bad else GOOD if value > good else ABSTAIN


def form_votes(d: dict[str, float]) -> list[int]:
    """Votes of the labellers of form. Each kind of junk is seen by two or more."""
    if d["n"] == 0:
        return [BAD] * 8
    return [
        two_sided(d["repeat"], 0.2, 0.08),
        two_sided(d["variety"], 0.3, 0.6) if d["n"] >= 50 else ABSTAIN,
        two_sided(d["upper"], 0.5, 0.2),
        two_sided(d["bang"], 0.3, 0.05),
        two_sided(d["marks"], 0.5, 0.1),
        two_sided(d["letters"], 0.7, 0.75),
        two_sided(d["pipes"], 0.1, 0.02),
        BAD if d["n"] >= 30 and d["stops"] < 0.004 else GOOD if 0.02 < d["stops"] < 0.35 and d["longest"] < 12 else ABSTAIN,
    ]


_FOLD = np.zeros(256, dtype=np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _low in range(97, 123):
    _FOLD[_low] = _FOLD[_low - 32] = _low
_FOLD = _FOLD.tobytes()
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first eight bytes, length) of the words of a text, in order: runs of letters (A-Z folded) and of bytes beyond ASCII."""
    folded = raw.translate(_FOLD) + bytes(24)
    inside = np.frombuffer(folded, dtype=np.uint8) != 0
    edge = np.flatnonzero(np.diff(inside)) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    begin, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray((len(raw) + 16,), dtype="<u8", buffer=folded, strides=(1,))
    first = eight[begin] & _MASKS[np.minimum(size, 8)]
    second = eight[begin + 8] & _MASKS[np.clip(size - 8, 0, 8)]
    return mix(first * _ODD + second * np.uint64(0xC2B2AE3D27D4EB4F) + size.astype(np.uint64)), first, size


def starts(first: np.ndarray, size: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Hashes of the words' beginnings of some numbers of bytes."""
    ids = [((first[size >= n] & _MASKS[n]) * _ODD + np.uint64(n)) * _ODD >> np.uint64(64 - bits) for n in sizes]
    return np.concatenate(ids).astype(np.int64)


def hashes(words: frozenset[str]) -> np.ndarray:
    return np.sort(words_of(" ".join(sorted(words)).encode())[0])


def among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values


_insults, _english = hashes(INSULTS), hashes(ENGLISH)


class Tone:
    """The labellers of tone: fixed insults, and two lists of word beginnings learned from annotated texts of any language."""

    def __init__(self, lists: dict[str, list[int]]):
        self.tables = {f: np.zeros(1 << START_BITS, dtype=bool) for f, ids in lists.items() if ids}
        for f, table in self.tables.items():
            table[lists[f]] = True

    def votes(self, raw: bytes) -> list[int]:
        """Insults: one is enough; without any they speak for English texts only.

        List "once": two different words with a listed beginning, counted by beginning; one says nothing. List "twice": two different words that share one.
        """
        words, first, size = words_of(raw)
        english = len(words) and among(words, _english).mean() > 0.05
        out = [BAD if len(words) and among(words, _insults).any() else GOOD if english else ABSTAIN]
        for f, (sizes, least) in FAMILIES.items():
            table = self.tables.get(f)
            if table is None:
                out.append(ABSTAIN)
            elif not table[starts(first, size, sizes, START_BITS)].any():  # most texts
                out.append(ABSTAIN if least == 1 else GOOD)
            else:
                at = np.unique(words, return_index=True)[1]
                ids = starts(first[at], size[at], sizes, START_BITS)
                found, times = np.unique(ids[table[ids]], return_counts=True)
                out.append((BAD if len(found) > 2 else ABSTAIN) if least == 1 else BAD if times.max() >= least else GOOD)
        return out


def worst(labels: DataFrame) -> DataFrame:
    """(doc_id, quality, toxic): repeated labels of an id count as the worst."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))


def drawn(share: float, salt: str):
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


STARTS = T.StructType([T.StructField("family", T.StringType()), T.StructField("start", T.LongType()), T.StructField("bad", T.LongType()), T.StructField("n", T.LongType())])


def learn_starts(docs: DataFrame, labels: DataFrame | None, bound: int = TAUGHT) -> dict[str, list[int]]:
    """Hashes of word beginnings that abusive texts have and others lack, by family, from about `bound` labelled rows.

    A beginning is listed if SEEN or more abusive texts have it, at a share TIMES that of the other texts; at
    most LISTED of a family. Texts of unsound form are left out. Without labels the lists are empty.
    """
    if labels is None:
        return {f: [] for f in FAMILIES}
    told = worst(labels).where("toxic is not null and coalesce(quality, 1) <> 0").select("doc_id", "toxic")
    taught = told.where(drawn(bound / max(1, told.count()), "taught"))

    def rows(part: Iterator[tuple]) -> Iterator[tuple]:
        seen: dict[str, list[tuple[np.ndarray, int]]] = {f: [] for f in FAMILIES}
        for toxic, text in part:
            words, first, size = words_of(text or b"")
            at = np.unique(words, return_index=True)[1]
            for f, (sizes, least) in FAMILIES.items():
                ids, times = np.unique(starts(first[at], size[at], sizes, START_BITS), return_counts=True)
                seen[f].append((ids[times >= least], int(toxic)))
        for f, found in seen.items():
            ids, place, n = np.unique(np.concatenate([i for i, _ in found]), return_inverse=True, return_counts=True)
            bad = np.bincount(place, weights=np.repeat([t for _, t in found], [len(i) for i, _ in found]), minlength=len(ids)).astype(np.int64)
            yield from zip([f] * len(ids), ids.tolist(), bad.tolist(), n.tolist(), strict=True)

    texts = docs.select("doc_id", "text").join(taught, "doc_id").select("toxic", "text")
    counts = map_texts(texts, ["toxic"], rows, STARTS).groupBy("family", "start").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    sizes = taught.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad"), F.count("*").alias("n")).first()
    rate = ((F.col("bad") + 0.5) / (sizes["bad"] + 1.0)) / ((F.col("n") - F.col("bad") + 0.5) / (sizes["n"] - sizes["bad"] + 1.0))
    listed = counts.where(F.col("bad") >= SEEN).withColumn("rate", rate).where(F.col("rate") >= TIMES)
    best = listed.groupBy("family").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("rate")).alias("r"), "start"))), 1, LISTED).alias("best")).collect()
    held = {r["family"]: sorted(b["start"] for b in r["best"]) for r in best}
    return {f: held.get(f, []) for f in FAMILIES}


VOTES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("form", T.StringType()), T.StructField("tone", T.StringType())])
LEARNING = T.StructType([*VOTES.fields, T.StructField("on", T.ArrayType(T.IntegerType()))])


def voted(docs: DataFrame, labels: DataFrame | None, lists: dict[str, list[int]], learning: bool = False) -> DataFrame:
    """(doc_id, form, tone): one character a labeller; the annotators of `labels`, where given, are the last one. With `learning` also the text's features."""

    def rows(part: Iterator[tuple], kept: tuple[Tone, Features]) -> Iterator[tuple]:
        tone, known = kept
        for doc_id, text in part:
            raw = text or b""
            form = form_votes(describe(raw))
            row = doc_id, "".join(map(str, form)), "".join(map(str, tone.votes(raw)))
            yield (*row, known.of(raw, form).tolist()) if learning else row

    out = map_texts(docs, ["doc_id"], rows, LEARNING if learning else VOTES, setup=lambda: (Tone(lists), Features()))
    said = lambda bad, good: F.when(bad, F.lit("1")).when(good, F.lit("2")).otherwise(F.lit("0"))
    joined = out.join(worst(labels), "doc_id", "left") if labels is not None else out.withColumn("quality", F.lit(None).cast("int")).withColumn("toxic", F.lit(None).cast("int"))
    form, tone = F.concat("form", said(F.col("quality") == 0, F.col("quality") == 1)), F.concat("tone", said(F.col("toxic") == 1, F.col("toxic") == 0))
    return joined.select("doc_id", form.alias("form"), tone.alias("tone"), *(["on"] if learning else []))


def fit_labellers(patterns: dict[str, int], rounds: int = 60) -> tuple[dict[str, float], np.ndarray]:
    """EM for labellers that vote independently given a hidden class; not voting says nothing.

    patterns: how many documents have each combination of votes (at most 3^labellers entries). Returns
    P(bad) of each combination, and P(vote | class) of each labeller. It starts from majority votes.
    """
    keys = sorted(patterns)
    if not keys:
        return {}, np.zeros((0, 2, 3))
    v = np.array([[int(c) for c in k] for k in keys])
    n = np.array([patterns[k] for k in keys], dtype=float)
    bad, good = (v == BAD).sum(1), (v == GOOD).sum(1)
    p = np.where(bad > 0, (bad + 1) / (bad + 0.5 * good + 1.5), 0.02)
    hot = np.stack([v == k for k in (BAD, GOOD)], axis=2).astype(float)
    for _ in range(rounds):
        weight = np.stack([n * p, n * (1 - p)])
        prior = (weight.sum(1) + 1) / (n.sum() + 2)
        cast = np.einsum("cp,plv->lcv", weight, hot) + 0.5
        theta = cast / cast.sum(2, keepdims=True)
        log = np.log(prior)[:, None] + np.einsum("plv,lcv->cp", hot, np.log(theta))
        p = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
    return dict(zip(keys, map(float, p), strict=True)), np.concatenate((np.zeros_like(theta[:, :, :1]), theta), axis=2)


class Features:
    """Hashed features: the first three to seven bytes of words, those that different words share once more, and the form labellers' votes. Each kind has numbers of its own."""

    def __init__(self, bits: int = BITS):
        self.bits, half = bits, 1 << bits - 1
        self.votes = (1 << bits) + half
        self.size = self.votes + 8 * 3

    def of(self, raw: bytes, form: list[int]) -> np.ndarray:
        """Sorted distinct features of a text."""
        words, first, size = words_of(raw)
        at = np.unique(words, return_index=True)[1]
        found, times = np.unique(starts(first[at], size[at], SIZES, self.bits), return_counts=True)
        shared = np.unique(found[times > 1] >> 1) + (1 << self.bits)
        return np.concatenate((found, shared, np.arange(8) * 3 + form + self.votes))


WIDTH = Features().size
Scorer = tuple[np.ndarray, float]


def cut_between(margins: np.ndarray, bad: np.ndarray) -> float:
    """The margin that parts bad (weights) from good best: the largest sum of both shares caught, in the middle of where it is reached."""
    if not len(margins) or not 0 < bad.sum() < len(bad):
        return 0.0
    order = np.argsort(margins)
    m, b = margins[order], bad[order]
    caught = 1 - np.concatenate(([0.0], np.cumsum(b))) / b.sum()
    spared = np.concatenate(([0.0], np.cumsum(1 - b))) / (1 - b).sum()
    k = int(np.argmax(np.round(caught + spared, 9)))
    return float(m[0] - 1 if k == 0 else m[-1] + 1 if k == len(m) else (m[k - 1] + m[k]) / 2)


def fit_scorer(rows: DataFrame, target: str) -> Scorer:
    """Logistic regression on soft labels: each row counts as both classes, weighted by its posterior.

    A fifth of the rows, by hash, is held out; the intercept is set so that the cut that parts these best lies at one half.
    """
    known = rows.where(F.col(target).isNotNull())
    sides = F.array(F.struct(F.lit(1.0).alias("label"), F.col(target).alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - F.col(target)).alias("w")))
    both = known.where("not held").select("features", F.explode(sides).alias("e")).select("features", "e.label", "e.w").where("w > 0.001")
    if len(both.groupBy("label").count().head(2)) < 2:
        return np.zeros(WIDTH), -1.0
    model = LogisticRegression(weightCol="w", regParam=2e-4, maxIter=40, standardization=False, aggregationDepth=2).fit(both)
    margin = F.get(vector_to_array("rawPrediction"), F.lit(1))
    held = model.transform(known.where("held")).select(margin, target).collect()  # two numbers a row, a fifth of the bounded sample
    cut = cut_between(*(np.array([r[k] for r in held], dtype=float) for k in (0, 1)))
    return np.asarray(model.coefficients.toArray()), float(model.intercept) - cut


@dataclass
class Judge:
    """What is broadcast: the two scorers."""

    form: Scorer
    tone: Scorer

    def verdict(self, known: Features, raw: bytes) -> tuple[float, float, bool]:
        on = known.of(raw, form_votes(describe(raw)))
        bad = [float(1 / (1 + np.exp(-np.clip(w[on].sum() + b, -50, 50)))) for w, b in (self.form, self.tone)]
        return round(1 - bad[0], 6), round(bad[1], 6), bool(raw.strip()) and max(bad) < 0.5


def fit(docs: DataFrame, labels: DataFrame | None, sample: int = SAMPLE) -> Judge:
    """Train on the label model's posteriors.

    The label model's statistics cover all rows. The scorers see a sample of about `sample` rows, by a
    hash of the id, of which those without any vote on an aspect are left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    lists = learn_starts(docs, labels)
    aspects = F.explode(F.array(*[F.struct(F.lit(a).alias("aspect"), F.col(a).alias("votes")) for a in ("form", "tone")])).alias("e")
    counts = voted(docs, labels, lists).select(aspects).groupBy("e.aspect", "e.votes").agg(F.count("*").alias("n")).collect()
    total = sum(r["n"] for r in counts) // 2
    if not total:
        return Judge((np.zeros(WIDTH), -1.0), (np.zeros(WIDTH), -1.0))
    believed = [(a, k, p) for a in ("form", "tone") for k, p in fit_labellers({r["votes"]: r["n"] for r in counts if r["aspect"] == a})[0].items() if k.strip("0")]
    posteriors = F.broadcast(spark.createDataFrame(believed, "aspect string, votes string, p double"))  # one row a combination of votes
    rows = voted(docs.where(drawn(sample / total, "sample")), labels, lists, learning=True)
    for a in ("form", "tone"):
        rows = rows.join(posteriors.where(F.col("aspect") == a).select(F.col("votes").alias(a), F.col("p").alias(f"p_{a}")), a, "left")
    vector = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(WIDTH).alias("size"), F.col("on").alias("indices"), F.transform("on", lambda _: F.lit(1.0)).alias("values"))
    kept = rows.select(vector.alias("features"), F.col("p_form").alias("form"), F.col("p_tone").alias("tone"), drawn(0.2, "held").alias("held")).repartition(12)
    scratch.save(kept, "sample")
    train = scratch.read("sample", "form double, tone double, held boolean", features=VectorUDT())
    judge = Judge(fit_scorer(train, "form"), fit_scorer(train, "tone"))
    scratch.drop("sample")
    return judge


SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality_score", T.DoubleType()), T.StructField("toxic_score", T.DoubleType()), T.StructField("keep", T.BooleanType())])


def classify(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, quality_score, toxic_score, keep) for every row of docs (doc_id, text).

    quality_score is the scorer's probability of sound form, toxic_score that of abuse; keep needs the
    first above and the second below one half. Null, empty and blank texts are rejected. labels (doc_id,
    quality, toxic; optional) act as one more labeller whose accuracy EM estimates, and teach the tone
    labellers suspect word beginnings; repeated labels of an
    id count as the worst. Repeated rows and null ids are scored like any row; other columns are ignored.
    """
    judge = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def rows(part: Iterator[tuple], known: Features) -> Iterator[tuple]:
        for doc_id, text in part:
            yield doc_id, *judge.value.verdict(known, text or b"")

    return map_texts(docs, ["doc_id"], rows, SCORES, setup=Features)


def keep_sound(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that `classify` keeps, with all their columns."""
    judge = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features()
        for batch in batches:
            raw = batch.column(place).cast(pa.large_binary())
            for at, n in parts(lengths(raw)):
                sound = [judge.value.verdict(known, text or b"")[2] for text in raw.slice(at, n).to_pylist()]
                yield batch.slice(at, n).filter(pa.array(sound, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
