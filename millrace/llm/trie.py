"""Prefix trie of conversations by block digests.

Turns are digested where they are read; no text moves. A conversation is cut in blocks of BLOCK turns, and a
block's digest chains over all turns before it, so conversations with one digest share every node of the block.
Blocks are grouped first. Only where one parent has several blocks next, that is, where siblings diverge, turns inside these
(distinct) blocks are grouped again.

The chain is a xor of 2 x 64 bits, each turn hashed with its place, so running digests come from ranges
of a conversation and no task needs a whole one. Sums over a subtree need no walk: a node belongs to its smallest member, what
a conversation owns is one run of nodes up to its end, and so leaves and words of a subtree are sums of one
value a member, taken over the same groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch

BLOCK, RANGE = 4, 1024
#: Copies of each diverging parent's row, and conv_ids a piece of a list of ends (as bits).
SALTS, PIECE_BITS = 8, 13
EMPTY = hashlib.sha256(b"").hexdigest()
WORDS = r"[^\x20\x09-\x0D]+"


def digests(talks: DataFrame) -> DataFrame:
    """(conv_id, turn, h1, h2, words) of each turn."""
    said = [F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    return talks.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(F.lit(1), *said).alias("h1"), F.xxhash64(F.lit(2), *said).alias("h2"),
        F.regexp_count(said[1], F.lit(WORDS)).cast("long").alias("words"),
    )


def in_order(scratch: Scratch, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their range and place within it (from 1), and each range's first place: no window holds more than a range of turn numbers."""
    ranged = turns.withColumn("range", F.coalesce(F.floor(F.col("turn") / RANGE), F.lit(-(1 << 62))))
    order = Window.partitionBy("conv_id", "range").orderBy(F.asc_nulls_first("turn"), "h1", "h2")
    placed = scratch.save(ranged.withColumn("at", F.row_number().over(order)).drop("turn"), "placed")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("conv_id", "range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return placed, scratch.save(ranges, "ranges")


def rebuilt(scratch: Scratch, turns: DataFrame, every: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, h1, h2, words) of rebuilt conversations, and all their ids.

    The first h turns are those of conversation c - c % every, with h = crc32(c) % heads; a conversation's own follow after its first h.
    """
    placed, ranges = in_order(scratch, turns)
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    base = F.col("conv_id") - F.col("conv_id") % every
    turn = F.struct("place", "h1", "h2", "words")
    first = placed.join(ranges.where((F.col("conv_id") % every == 0) & (F.col("before") < heads)), ["conv_id", "range"]).withColumn("place", F.col("at") + F.col("before"))
    first = first.where(F.col("place") < heads).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("head"))
    ids = ranges.select("conv_id").distinct().withColumn("base", base).withColumn("h", h)
    ids = ids.join(first, "base", "left").withColumn("head", F.expr("coalesce(slice(head, 1, cast(h as int)), array())"))
    ids = scratch.save(ids.select("conv_id", "h", "head"), "ids")
    shift = ranges.join(ids.select("conv_id", "h", F.size("head").alias("got")), "conv_id").select("conv_id", "range", "before", "h", "got")
    own = placed.join(shift, ["conv_id", "range"]).withColumn("own", F.col("at") + F.col("before")).where("own > h")
    own = own.select("conv_id", (F.col("own") - F.col("h") + F.col("got")).alias("place"), "h1", "h2", "words")
    lent = ids.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.place").cast("long").alias("place"), "t.h1", "t.h2", "t.words")
    return own.union(lent), ids.select("conv_id")


def in_blocks(scratch: Scratch, turns: DataFrame) -> DataFrame:
    """(conv_id, k, range, p1, p2, c1, c2, before, total, turns): each block's digests with and without its own turns, and words before and inside."""
    marked = turns.select("conv_id", "place", F.xxhash64("place", "h1").alias("x1"), F.xxhash64("place", "h2", F.lit(2)).alias("x2"), "words")
    blocks = marked.groupBy("conv_id", F.floor((F.col("place") - 1) / BLOCK).alias("k")).agg(
        F.bit_xor("x1").alias("d1"), F.bit_xor("x2").alias("d2"), F.sum("words").alias("total"), F.array_sort(F.collect_list(F.struct("place", "x1", "x2", "words"))).alias("turns")
    )
    blocks = scratch.save(blocks.withColumn("range", F.floor(F.col("k") / RANGE)), "cut")
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = blocks.groupBy("conv_id", "range").agg(F.bit_xor("d1").alias("r1"), F.bit_xor("d2").alias("r2"), F.sum("total").alias("rw"))
    none = lambda f, c, w: F.coalesce(f(c).over(w), F.lit(0))
    whole = whole.select("conv_id", "range", none(F.bit_xor, "r1", earlier).alias("e1"), none(F.bit_xor, "r2", earlier).alias("e2"), none(F.sum, "rw", earlier).alias("ew"))
    inside = Window.partitionBy("conv_id", "range").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    run = blocks.withColumn("i1", none(F.bit_xor, "d1", inside)).withColumn("i2", none(F.bit_xor, "d2", inside)).withColumn("iw", none(F.sum, "total", inside))
    xor = lambda a, b: F.col(a).bitwiseXOR(F.col(b))
    run = run.join(whole, ["conv_id", "range"]).withColumn("p1", xor("e1", "i1")).withColumn("p2", xor("e2", "i2"))
    return scratch.save(run.select("conv_id", "k", "range", "p1", "p2", xor("p1", "d1").alias("c1"), xor("p2", "d2").alias("c2"), (F.col("ew") + F.col("iw")).alias("before"), "total", "turns"), "blocks")


def refine(groups: DataFrame, parents: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Nodes of grouped blocks: (n1, n2) is a node's digest, (u1, u2) its parent's.

    Blocks that are alone below their parent give their nodes as they are. The others' turns are grouped by digest; `sums` says
    how their columns are added up.
    """
    cases = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    many = parents.withColumn("salt", cases)
    split = groups.withColumn("salt", F.pmod("c1", F.lit(SALTS)).cast("int")).join(many, ["p1", "p2", "salt"], "left").drop("salt")

    def opened(df: DataFrame) -> DataFrame:
        upto = lambda c, a: F.expr(f"aggregate(slice(turns, 1, j + 1), {a}, (a, t) -> a {'+' if c == 'words' else '^'} t.{c})")
        return df.select("*", F.posexplode("turns").alias("j", "t")).select(
            upto("x1", "p1").alias("n1"), upto("x2", "p2").alias("n2"), F.col("t.place").alias("depth"), F.col("t.x1").alias("x1"), F.col("t.x2").alias("x2"), F.col("t.words").alias("words"),
            (upto("words", "before") - F.col("t.words")).alias("before"), *sums,
        )

    same = [F.any_value(c).alias(c) for c in ("depth", "x1", "x2", "words", "before")]
    diverge = F.col("several") | (F.col("k") == 0)
    alone = opened(split.where(~F.coalesce(diverge, F.lit(False))))
    grouped = opened(split.where(diverge)).groupBy("n1", "n2").agg(*same, *[e.alias(c) for c, e in sums.items()])
    nodes = alone.select(grouped.columns).union(grouped)
    return nodes.withColumn("u1", F.col("n1").bitwiseXOR(F.col("x1"))).withColumn("u2", F.col("n2").bitwiseXOR(F.col("x2"))).drop("x1", "x2")


def ends(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """(n1, n2, ends_sha256) of nodes where a conversation ends.

    Ids are joined in pieces of one id range, at most 2^PIECE_BITS each; a node's pieces stream past one digest in order.
    """
    last = blocks.groupBy("conv_id").agg(F.max_by(F.struct("c1", "c2"), "k").alias("c"))
    last = ids.join(last, "conv_id", "left").select("conv_id", F.coalesce("c.c1", F.lit(0)).alias("n1"), F.coalesce("c.c2", F.lit(0)).alias("n2"))
    pieces = last.groupBy("n1", "n2", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(F.expr("array_join(transform(array_sort(collect_list(conv_id)), x -> cast(x as string)), ',')").alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for b in batches:
            for n1, n2, text in zip(*(b.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if (n1, n2) == now:
                    state.update(b"," + text.encode())
                    continue
                if now:
                    done.append((*now, state.hexdigest()))
                now, state = (n1, n2), hashlib.sha256(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["n1", "n2", "ends_sha256"])
                done = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, state.hexdigest())], names=["n1", "n2", "ends_sha256"])

    return pieces.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "piece").mapInArrow(run, "n1 long, n2 long, ends_sha256 string")


def prefix_trie(talks: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """One row per node of the trie of rebuilt conversations; see `rebuilt` for how they are made from talks (conv_id, turn, role, text).

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless
    nodes in its subtree), saved_tokens (over its subtree, words of a node's last text times members but one) and
    ends_sha256 (of the ids that end here, ascending, comma-joined). Turns are ordered by `turn`, null first; ties by a digest
    of role and text, so equal turns are interchangeable. Null roles and texts count as empty. Rows
    without conv_id take no part; a conversation without turns belongs to the root. Other columns are ignored; an empty
    table has no nodes.
    """
    scratch = Scratch(talks.sparkSession, "trie")
    turns, ids = rebuilt(scratch, digests(talks), every, heads)
    blocks = in_blocks(scratch, turns)
    key, one = ["c1", "c2"], [F.any_value(c).alias(c) for c in ("k", "p1", "p2", "before", "turns")]
    groups = scratch.save(blocks.groupBy(*key).agg(*one, F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")), "groups")
    parents = groups.where("k > 0").groupBy("p1", "p2").agg(F.count("*").alias("n")).where("n > 1").select("p1", "p2", F.lit(True).alias("several"))
    parents = scratch.save(parents, "parents")
    nodes = scratch.save(refine(groups, parents, {"conv_id": F.min("conv_id"), "n_convs": F.sum("n_convs")}), "nodes")
    children = scratch.save(nodes.groupBy(F.col("u1").alias("n1"), F.col("u2").alias("n2")).agg(F.count("*").alias("n_children")), "children")
    counted = scratch.save(nodes.join(children, ["n1", "n2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted")

    # What each conversation owns: a run of nodes from its first own turn to its end.
    owned = counted.groupBy("conv_id").agg(F.sum("words").alias("own"), F.min_by("before", "depth").alias("start"), (F.max_by("n_children", "depth") == 0).cast("long").alias("leaf"))
    words = blocks.groupBy("conv_id").agg(F.sum("total").alias("all"))
    of = ids.join(words, "conv_id", "left").join(owned, "conv_id", "left")
    of = scratch.save(of.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("all", "own", "leaf")], "start"), "of")
    ranged = blocks.select("conv_id", "range").distinct().join(of, "conv_id")
    sums = {c: F.sum(c) for c in ("all", "own", "leaf")} | {"first": F.min("first")}
    totals = blocks.select("conv_id", "range", *key).join(ranged, ["conv_id", "range"]).withColumn("first", F.struct("conv_id", "start")).groupBy(*key).agg(*[e.alias(c) for c, e in sums.items()])
    below = refine(groups.drop("conv_id", "n_convs").join(totals, key), parents, sums).select("n1", "n2", *sums)
    full = counted.join(below, ["n1", "n2"])
    # Over members: words from this node on, less one copy of each owned node at or below it.
    saved = F.col("all") - F.col("n_convs") * F.col("before") - (F.col("own") - (F.col("before") - F.col("first.start")))
    full = full.select("n1", "n2", "u1", "u2", "conv_id", "depth", "n_convs", "n_children", F.col("leaf").alias("n_leaves"), saved.alias("saved_tokens"))
    root = of.agg(F.min("conv_id").alias("id"), F.count("*").alias("n"), F.sum("leaf").alias("leaves"), (F.sum("all") - F.sum("own")).alias("saved")).first()
    if not root["n"]:
        return counted.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "n_convs", F.col("n_children"), F.col("n_children").alias("n_leaves"), F.col("words").alias("saved_tokens"), F.lit(EMPTY).alias("ends_sha256"))
    first_turns = children.where("n1 = 0 and n2 = 0").first()
    first_turns = first_turns["n_children"] if first_turns else 0
    top = scratch.spark.range(1).select(*[F.lit(v).cast("long").alias(c) for c, v in {
        "n1": 0, "n2": 0, "conv_id": root["id"], "depth": 0, "parent_conv_id": None, "n_convs": root["n"], "n_children": first_turns, "n_leaves": root["leaves"] if first_turns else 1, "saved_tokens": root["saved"]}.items()])
    full = scratch.save(full, "full")
    # The root is the parent of each first turn; of all deeper nodes the parent is looked up, one row a digest.
    shallow = full.where("depth = 1").withColumn("parent_conv_id", F.lit(root["id"]))
    deeper = full.where("depth > 1").join(full.where("n_children > 0").select(F.col("n1").alias("u1"), F.col("n2").alias("u2"), F.col("conv_id").alias("parent_conv_id")), ["u1", "u2"])
    columns = ["n1", "n2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    every_node = shallow.select(columns).union(deeper.select(columns)).union(top.select(columns))
    return every_node.join(ends(blocks, ids), ["n1", "n2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))).drop("n1", "n2")
