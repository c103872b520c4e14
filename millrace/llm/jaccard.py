"""Near duplicates by exact similarity: texts link if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more.

Prefix filter: with all shingles in one fixed order, two sets of similarity s or more share one of the
first n - ceil(s n) + 1 shingles of each (n: the set's own size), so joining on those finds every pair.
The order is by hash, with the shingles that a sample of texts shows to be common put last; the sample
decides the work only, since any order serves. Equal sets are one node, so copies cost one row.

Two sets pair up in a key only if its places in both leave enough shingles for the two sizes (`met_keys`). Texts that share a
long passage and are not similar have more shingles of their own than that, and these come first; so they
don't meet in the passage's keys at all.

Links that a search by fingerprint finds are compared exactly first; what they join is compared no more.

Copies of one text in many variants would still make a pair for each two of them. So in keys of more than PAIRED nodes two things hold
pairs off. Each node carries a bitmap of its set's parities; bitmaps differ in no more bits than the sets do in shingles, so a pair whose bitmaps
differ in too many is no pair. And first, a few times over, the first time along with the links by fingerprint, a node looks at some 32 others
of its largest key, drawn by hash, and is compared with the one of nearest bitmap. Components are worked out; then nodes of one component are
compared no more. So each pair that could join two components is compared, whatever the size of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Scratch, components, majority, map_texts, signed

SHINGLE = 5
#: Similarity as a fraction: PART / WHOLE.
PART, WHOLE = 4, 5
PAIRED = 64
#: Rounds in which members of large keys ask about ROUND_LEADERS others, and longs of a set's bitmap.
ROUNDS, ROUND_LEADERS, LONGS = 2, 32, 16
SAMPLED, COMMON, LISTED = 16, 8, 1_000_000
BROADCAST_ROWS = 200_000
COMMON_BIT = np.int64(1 << 62)
MULTIPLY, MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingles(text: bytes | None) -> np.ndarray:
    """62-bit hashes of the five-word shingles of the case-folded text, in its order; one of all words where there are fewer, none for no words."""
    words = (text or b"").decode("utf-8", "replace").casefold().split()
    if not words:
        return np.empty(0, dtype=np.int64)
    hash64 = xxhash.xxh64_intdigest
    w = np.array([hash64(x) for x in words], dtype=np.uint64)
    size = min(SHINGLE, len(w))
    h = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        h = h * MULTIPLY + w[k : len(w) - size + 1 + k]
        h ^= h >> np.uint64(29)
    for shift, by in zip((30, 27), MIX, strict=True):
        h = (h ^ h >> np.uint64(shift)) * by
    return ((h ^ h >> np.uint64(31)) >> np.uint64(2)).view(np.int64)


def shingle_set(text: bytes | None) -> np.ndarray:
    """`shingles` sorted and distinct."""
    return np.unique(shingles(text))


def prefix(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(s n) + 1 of n shingles, those in `common` (sorted) last: they get the 63rd bit, so the order is that of the numbers."""
    n = len(shingles)
    if not n:
        return shingles
    if len(common):
        last = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
        shingles = np.concatenate([shingles[~last], shingles[last] | COMMON_BIT])
    return shingles[: n - (PART * n + WHOLE - 1) // WHOLE + 1]


def parities(shingles: np.ndarray) -> np.ndarray:
    """LONGS longs: the parity of how many shingles fall on each bit. Of two sets at most as many bits differ as shingles do."""
    odd = np.bincount(shingles & (LONGS * 64 - 1), minlength=LONGS * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that COMMON or more different texts of a sample by hash hold, at most LISTED of them."""

    def rows(part: Iterator[tuple]) -> Iterator[tuple]:
        for t, text in part:
            yield t, shingle_set(text).tolist()

    schema = T.StructType([T.StructField("t", T.LongType()), T.StructField("hs", T.ArrayType(T.LongType()))])
    drawn = docs.select(F.xxhash64("text").alias("t"), "text").where(F.pmod("t", F.lit(SAMPLED)) == 0)
    distinct = map_texts(drawn.dropDuplicates(["t"]), ["t"], rows, schema)
    counts = distinct.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    return np.sort(counts.orderBy(F.desc("n"), "h").limit(LISTED).select("h").toArrow().column("h").to_numpy())


def row_key() -> Column:
    """Orders rows by id (nulls last) and text hash."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "t")


def sets(docs: DataFrame, held: Broadcast) -> DataFrame:
    """(doc_id, t, node, n, keys, bits, fp): the text's hash, its shingle set's hash and size, the set's prefix (`held`: the common shingles), its parities and its fingerprint."""

    def rows(part: Iterator[tuple]) -> Iterator[tuple]:
        last = held.value
        for doc_id, t, text in part:
            s = shingle_set(text)
            yield doc_id, t, node_of(s), len(s), prefix(s, last).tolist(), parities(s).tolist(), fingerprint(s)

    schema = "doc_id long, t long, node long, n int, keys array<long>, bits array<long>, fp long"
    return map_texts(docs.select("doc_id", F.xxhash64("text").alias("t"), "text"), ["doc_id", "t"], rows, T._parse_datatype_string(schema))


def node_of(shingles: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(shingles.tobytes(), 42))


def fingerprint(shingles: np.ndarray) -> int:
    """SimHash of a set, as a long: the bit majority of its shingles, spread from 62 bits to 64; 0 for none."""
    return signed(majority(shingles.view(np.uint64) * MULTIPLY))


def whole_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, s): the shingle set of each of nodes (node, lead), from the row of docs that lead names."""

    def rows(part: Iterator[tuple]) -> Iterator[tuple]:
        for node, text in part:
            yield node, shingle_set(text).tolist()

    keyed = docs.select("doc_id", F.xxhash64("text").alias("t"), "text").withColumn("lead", row_key())
    few = nodes.count() <= BROADCAST_ROWS
    texts = keyed.join(F.broadcast(nodes) if few else nodes, "lead").select("node", "text")
    return map_texts(texts, ["node"], rows, T._parse_datatype_string("node long, s array<long>")).dropDuplicates(["node"])


def reach(shared: Column) -> Column:
    """Whether sets a and b can reach the similarity, if their prefixes share at most `shared` shingles.

    Of the set whose prefix ends first no prefix shingle is past the other's prefix, so only its other
    shingles can add to those (na, nb: sizes; pa, pb: prefix lengths; la, lb: last shingles of the prefixes).
    """
    beyond = F.when(F.col("la") < F.col("lb"), F.col("na") - F.col("pa")).when(F.col("la") > F.col("lb"), F.col("nb") - F.col("pb")).otherwise(F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")))
    return (PART + WHOLE) * (shared + beyond) >= PART * (F.col("na") + F.col("nb"))


def sided(df: DataFrame, side: str, columns: dict[str, str]) -> DataFrame:
    return df.select(F.col("node").alias(side), *[F.expr(e).alias(c + side) for c, e in columns.items()])


def promising(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose prefixes share enough shingles."""
    columns = {"n": "n", "p": "size(keys)", "l": "try_element_at(keys, -1)", "k": "keys"}
    both = pairs.join(sided(nodes, "a", columns), "a").join(sided(nodes, "b", columns), "b")
    return both.where(reach(F.size(F.array_intersect("ka", "kb")))).select("a", "b")


def similar(scratch: Scratch, docs: DataFrame, nodes: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Those of pairs (a, b) whose sets reach the similarity: prefixes decide which sets are made whole."""
    close = scratch.save(promising(scratch.save(pairs, f"pairs-{name}"), nodes), f"close-{name}")
    wanted = close.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    whole = scratch.save(whole_sets(docs, scratch.save(nodes.join(wanted, "node", "left_semi").select("node", "lead"), f"wanted-{name}")), f"whole-{name}")
    both = close.join(sided(whole, "a", {"s": "s"}), "a").join(sided(whole, "b", {"s": "s"}), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return scratch.save(both.where((PART + WHOLE) * shared >= PART * (F.size("sa") + F.size("sb"))).select("a", "b"), f"found-{name}")


def band(n: str) -> Column:
    """Sizes in steps of a tenth."""
    return F.floor(F.log(F.greatest(F.col(n), F.lit(1)).cast("double")) / np.log(1.1)).cast("int")


def met_keys(nodes: DataFrame) -> DataFrame:
    """(key, node, n, most, m) of keys where some pair can meet first: m nodes hold the key, `most` is the largest partner that a node can have there.

    If a key is the first that two sets share, at places p of n shingles and q of k, they share at most n - p and k - q, and must share
    4/9 of n + k: so k <= (5 n - 9 p) / 4, and the like for the other. The smaller one then has most >= n, so a
    key without such a node is left out, however many share it.
    """
    keyed = nodes.select("node", "n", F.posexplode("keys").alias("p", "key")).select("key", "node", "n", F.floor((5 * F.col("n") - 9 * F.col("p")) / 4).cast("int").alias("most"))
    held = keyed.groupBy("key").agg(F.count("*").alias("m"), F.max(F.col("most") >= F.col("n")).alias("open")).where("m > 1 and open").drop("open")
    return keyed.join(held, "key")


def apart(x: str, y: str) -> Column:
    """Bits in which the bitmaps of two sides differ."""
    return sum((F.bit_count(F.col(f"{x}{k}").bitwiseXOR(F.col(f"{y}{k}"))) for k in range(LONGS)), F.lit(0))


def side(df: DataFrame, x: str, bitmaps: bool, *more: Column) -> DataFrame:
    return df.select("key", *[F.col(c).alias(c + x) for c in ("node", "n", "most", "c")], *[F.get("bits", F.lit(k)).alias(f"bit{x}{k}") for k in range(LONGS if bitmaps else 0)], *more)


def meeting(smaller: DataFrame, larger: DataFrame, bitmaps: bool = False) -> DataFrame:
    """Pairs (a, b) of rows (key, node, n, most, c, bits) of one key and different components that can share enough from there on, and by their bitmaps, if asked."""
    s = side(smaller.where("most >= n"), "x", bitmaps, F.explode(F.sequence(band("n"), band("most"))).alias("band"))
    t = side(larger, "y", bitmaps, band("n").alias("band"))
    both = F.expr("cx <> cy and ny >= nx and ny <= mostx and nx <= mosty")
    if bitmaps:
        both = both & (9 * apart("bitx", "bity") <= F.col("nx") + F.col("ny"))
    t = t.withColumnRenamed("key", "keyy").withColumnRenamed("band", "bandy")
    met = s.join(t, (F.col("key") == F.col("keyy")) & (F.col("band") == F.col("bandy")) & both)
    return met.select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b"))


def asked(hot: DataFrame, round_no: int) -> DataFrame:
    """Pairs (a, b): each node of hot (key, node, n, most, m, c, bits) with the one of nearest bitmap of those that are drawn in its largest key and lie in another component."""
    largest = hot.groupBy("node").agg(F.max_by("key", F.struct("m", "key")).alias("key"))
    drawn = hot.where(F.pmod(F.xxhash64("node", F.lit(round_no)), F.col("m")) < ROUND_LEADERS)
    x, y = side(hot.join(largest, ["node", "key"], "left_semi"), "x", True), side(drawn, "y", True).withColumnRenamed("key", "keyy")
    far = apart("bitx", "bity")
    near = x.join(y, (F.col("key") == F.col("keyy")) & F.expr("cx <> cy") & (9 * far <= F.col("nx") + F.col("ny")))
    best = near.withColumn("far", far).groupBy("nodex").agg(F.min_by("nodey", F.struct("far", "nodey")).alias("nodey"))
    return best.select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b")).distinct()


def placed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (node, ..., c) with c the node's root, where it has one, else the node."""
    return rows.drop("c").join(roots, rows.node == roots.node, "left").select(*[rows[c] for c in rows.columns if c != "c"], F.coalesce("root", rows.node).alias("c"))


def stars(roots: DataFrame) -> DataFrame:
    """roots (node, root) as links (a, b)."""
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def links(scratch: Scratch, docs: DataFrame, nodes: DataFrame, near: DataFrame) -> DataFrame:
    """Links (a, b) between nodes (node, n, keys, bits, lead) whose closure is that of all pairs of the similarity. Pairs `near` are compared first.

    Every pass over pairs and components costs the driver some sixty jobs, so the first round of asking goes
    along with `near`, and later components start from the stars of those before. Rows of keys get their components in tables of their own, once each.
    """
    met = scratch.save(met_keys(nodes).withColumn("c", F.col("node")), "met")
    few, many = met.where(F.col("m") <= PAIRED), met.where(F.col("m") > PAIRED)
    hot = bool(many.head(1))
    if hot:
        many = scratch.save(many.join(nodes.select("node", "bits"), "node"), "many")
        near = near.union(asked(many, 0)).distinct()
    roots = scratch.save(components(Scratch(docs.sparkSession, "jaccard-near"), similar(scratch, docs, nodes, near, "near")), "roots-near")
    for k in range(1, ROUNDS if hot else 0):
        many = scratch.save(placed(many, roots), f"many-{k}")
        fresh = similar(scratch, docs, nodes, asked(many, k), str(k))
        roots = scratch.save(components(Scratch(docs.sparkSession, f"jaccard-{k}"), stars(roots).union(fresh)), f"roots-{k}")
    few = scratch.save(placed(few, roots), "few")
    pairs = meeting(few, few)
    if hot:
        many = scratch.save(placed(many, roots), "many-rest")
        # Of a large key, what lies in its largest component is compared with the rest only.
        largest = many.groupBy("key", "c").agg(F.count("*").alias("x")).groupBy("key").agg(F.max_by("c", F.struct("x", "c")).alias("main"))
        many = many.join(largest, "key")
        rest, main = many.where("c <> main"), many.where("c = main")
        pairs = pairs.union(meeting(rest, many, True)).union(meeting(main, rest, True))
    return stars(roots).union(similar(scratch, docs, nodes, pairs.distinct(), "rest"))


def classes(docs: DataFrame, close: Callable[[Scratch, DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, t, root) of every row of docs (doc_id, text): t is the text's xxhash64, root names the component.

    close gives pairs (a, b) of nodes (node, n, fp) that a search by fingerprint finds; they are compared first.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    held = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))
    rows = scratch.save(sets(docs, held).withColumn("lead", row_key()), "sets")
    held.destroy()
    nodes = scratch.save(rows.groupBy("node").agg(F.min("lead").alias("lead"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"), F.any_value("bits").alias("bits"), F.any_value("fp").alias("fp")), "nodes")
    roots = scratch.save(components(scratch, links(scratch, docs, nodes, close(Scratch(docs.sparkSession, "close"), nodes))), "roots")
    return rows.select("doc_id", "t", "node").join(roots, "node", "left").select("doc_id", "t", F.coalesce("root", "node").alias("root"))
