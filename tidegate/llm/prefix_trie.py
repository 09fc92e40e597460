"""A trie of conversations' prefixes, built and searched as a z-fast trie in tables.

Only compacted nodes are stored: where sequences part or end. Each lies under one handle,
the digest of its prefix at the depth within its edge that is divisible by the highest
power of two. A sequence finds the edge where it leaves the trie by fat binary search:
as many joins on handles as the longest sequence's depth has binary digits. Sequences
are inserted in batches: a batch is searched, the edges it leaves are split, and what of
it lies beyond forms new nodes. At the end edges are expanded to a node for every depth.

A prefix is known by its depth and two sums, modulo 2**64, of digests of (depth, turn).
Sequences are kept in blocks of BLOCK turns, so that a very long one is many rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import stage, unstage
from tidegate.llm.ordered import running

BLOCK = 64
#: Parts of the sequences, chosen by a digest of their number, that are inserted together.
BATCHES = (1, 7)
#: Bytes of listed members that are handed on together to be digested.
CHUNK = 1 << 16

_KEY = ["depth", "g1", "g2"]


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes of a turn."""
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def _block(depth: Column) -> Column:
    return F.floor((depth - 1) / BLOCK).cast("long")


def blocks_of(turns: DataFrame) -> DataFrame:
    """(conv, block, at) staged: the prefixes (depth, g1, g2, chars, b1, b2) that end in each block; b1, b2 are those one turn shorter.

    Takes (conv, depth, turn, chars), depths from 1 without gaps.
    """
    terms = {"g1": F.xxhash64("turn", "depth"), "g2": F.xxhash64(F.lit(2), "depth", "turn")}
    rows = turns.withColumns(terms).select("conv", "depth", "g1", "g2", "chars")
    summed, pieces = running(rows, "conv", ["depth"], ["g1", "g2", "chars"])
    one = F.struct("depth", "g1", "g2", "chars", F.col("g1_before").alias("b1"), F.col("g2_before").alias("b2"))
    out = stage(summed.groupBy("conv", _block(F.col("depth")).alias("block")).agg(F.array_sort(F.collect_list(one)).alias("at")), "blocks")
    unstage(pieces)
    return out


def _looked_up(wanted: DataFrame, blocks: DataFrame, rep: str, depth: str) -> DataFrame:
    """`wanted` with `found`: the prefix of sequence `rep` at `depth`, which must be there."""
    there = blocks.select(F.col("conv").alias("_rep"), F.col("block").alias("_block"), "at")
    met = wanted.withColumn("_want", _block(F.col(depth))).join(there, (F.col(rep) == F.col("_rep")) & (F.col("_want") == F.col("_block")))
    return met.withColumn("found", F.get("at", (F.col(depth) - 1 - F.col("_block") * BLOCK).cast("int"))).drop("_want", "_rep", "_block", "at")


def _fattest(lo: Column, hi: Column) -> Column:
    """The number in (lo, hi] divisible by the highest power of two."""
    return F.when(lo < hi, hi.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), F.length(F.bin(lo.bitwiseXOR(hi))) - 1))).cast("long")


def _handles(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(depth, g1, g2, p, rep) with the prefixes at the node's handle (h, h1, h2) and one turn below its parent (c1, c2), staged."""
    nodes = nodes.select(*_KEY, "p", "rep").withColumn("h", _fattest(F.col("p"), F.col("depth")))
    spots = nodes.select("*", F.explode(F.array(F.struct(F.lit(1).alias("kind"), F.col("h").alias("d")), F.struct(F.lit(2).alias("kind"), (F.col("p") + 1).alias("d")))).alias("spot"))
    seen = _looked_up(spots.select("*", "spot.kind", "spot.d").drop("spot"), blocks, "rep", "d")
    pick = lambda kind, part: F.max(F.when(F.col("kind") == kind, F.col(f"found.{part}")))
    return stage(seen.groupBy(*_KEY, "p", "rep", "h").agg(pick(1, "g1").alias("h1"), pick(1, "g2").alias("h2"), pick(2, "g1").alias("c1"), pick(2, "g2").alias("c2")), "handles")


def _searched(batch: DataFrame, trie: DataFrame, blocks: DataFrame, longest: int) -> DataFrame:
    """`batch` (rep, len) with the deepest node (lo, v1, v2) whose handle it has; blind, so it may leave the trie above that node's depth."""
    handles = trie.select(F.col("h").alias("f"), F.col("h1").alias("f1"), F.col("h2").alias("f2"), F.col("depth").alias("e"), F.col("g1").alias("e1"), F.col("g2").alias("e2"))
    first = blocks.where("block = 0").select(F.col("conv").alias("rep"), "at")
    none = F.lit(0).cast("long")
    state = batch.join(first, "rep").withColumns({"lo": none, "v1": none, "v2": none, "hi": F.col("len")})
    done, previous = None, None
    for _ in range(longest.bit_length()):
        state = state.withColumn("f", _fattest(F.col("lo"), F.col("hi")))
        near = state.withColumn("seen", F.get("at", (F.col("f") - 1).cast("int")))
        if longest > BLOCK:  # handles beyond the first block are looked up
            far = _looked_up(state.where(F.col("f") > BLOCK).select("rep", "f"), blocks.where("block > 0"), "rep", "f").select("rep", F.col("found").alias("seen"))
            near = near.where(F.col("f") <= BLOCK).unionAll(state.where(F.col("f") > BLOCK).join(far, "rep").select(*near.columns))
        met = near.select("*", F.col("seen.g1").alias("f1"), F.col("seen.g2").alias("f2")).drop("seen").join(handles, ["f", "f1", "f2"], "left")
        hit = F.col("e").isNotNull()
        met = met.withColumns({"lo": F.when(hit, F.col("e")).otherwise(F.col("lo")), "v1": F.when(hit, F.col("e1")).otherwise(F.col("v1")), "v2": F.when(hit, F.col("e2")).otherwise(F.col("v2")), "hi": F.when(hit, F.col("hi")).otherwise(F.col("f") - 1)})
        met = stage(met.select("rep", "len", "at", "lo", "v1", "v2", "hi"), "search")
        ended = met.where("lo >= hi").select("rep", "len", "lo", "v1", "v2")
        done = ended if done is None else done.unionAll(ended)
        state = met.where("lo < hi")
        if state.isEmpty():
            break
    return done


def _located(batch: DataFrame, trie: DataFrame, blocks: DataFrame, longest: int) -> DataFrame:
    """`batch` (rep, len) with its exit edge's node (x, x1, x2; null where it leaves at the root) and the depth `lcp` where it leaves, staged."""
    found = stage(_searched(batch, trie, blocks, longest), "searched")
    # the turn after the node tells whether an edge goes on
    below = _looked_up(found.where("len > lo").withColumn("next", F.col("lo") + 1), blocks, "rep", "next").select("rep", "next", F.col("found.g1").alias("c1"), F.col("found.g2").alias("c2"))
    child = trie.select((F.col("p") + 1).alias("next"), "c1", "c2", F.col("depth").alias("w"), F.col("g1").alias("w1"), F.col("g2").alias("w2"))
    below = below.join(child, ["next", "c1", "c2"]).select("rep", "w", "w1", "w2")
    on = found.join(below, "rep", "left")
    deeper = F.col("w").isNotNull()
    exits = {"x": F.when(deeper, F.col("w")).when(F.col("lo") > 0, F.col("lo")), "x1": F.when(deeper, F.col("w1")).otherwise(F.col("v1")), "x2": F.when(deeper, F.col("w2")).otherwise(F.col("v2"))}
    on = stage(on.withColumns(exits).select("rep", "len", "x", "x1", "x2"), "exits")
    edges = trie.select(F.col("depth").alias("x"), F.col("g1").alias("x1"), F.col("g2").alias("x2"), "p", F.col("rep").alias("edge_rep"))
    pairs = on.join(edges, ["x", "x1", "x2"]).withColumn("to", F.least("x", "len"))
    # prefixes agree up to where the sequence leaves, so counting those that agree on the edge gives that depth
    spans = pairs.select("rep", "edge_rep", "p", "to", F.explode(F.sequence(_block(F.col("p") + 1), _block(F.col("to")))).alias("block"))
    mine = blocks.select(F.col("conv").alias("rep"), "block", F.col("at").alias("mine"))
    theirs = blocks.select(F.col("conv").alias("edge_rep"), "block", F.col("at").alias("theirs"))
    same = F.filter(F.arrays_zip("mine", "theirs"), lambda z: (z["mine"]["depth"] > F.col("p")) & (z["mine"]["depth"] <= F.col("to")) & (z["mine"]["g1"] == z["theirs"]["g1"]) & (z["mine"]["g2"] == z["theirs"]["g2"]))
    shared = spans.join(mine, ["rep", "block"]).join(theirs, ["edge_rep", "block"]).groupBy("rep").agg((F.max("p") + F.sum(F.size(same))).alias("lcp"))
    out = stage(on.join(shared, "rep", "left").withColumn("lcp", F.coalesce("lcp", F.lit(0).cast("long"))), "located")
    unstage(found, on)
    return out


def _new_nodes(located: DataFrame, blocks: DataFrame) -> DataFrame:
    """(depth, g1, g2, p, rep) of the nodes that sequences form below the places where they leave the trie."""
    rest = located.where("len > lcp").select("rep", "len", "lcp", F.explode(F.sequence(_block(F.col("lcp") + 1), _block(F.col("len")))).alias("block"))
    rest = rest.join(blocks.withColumnRenamed("conv", "rep"), ["rep", "block"])
    rows = rest.select("rep", "len", "lcp", F.explode(F.filter("at", lambda a: a["depth"] > F.col("lcp"))).alias("a")).select("rep", "len", "lcp", "a.*")
    spots = rows.groupBy(*_KEY).agg(F.min("rep").alias("first"), F.max(F.col("depth") == F.col("len")).alias("is_end"), F.max("b1").alias("b1"), F.max("b2").alias("b2"))
    spots = stage(spots, "spots")
    ways = spots.groupBy((F.col("depth") - 1).alias("depth"), F.col("b1").alias("g1"), F.col("b2").alias("g2")).agg(F.count("*").alias("ways"))
    stops = stage(spots.join(ways, _KEY, "left").where("is_end or ways > 1").select(*_KEY, "first"), "stops")
    # the node before each on its way down, taken from the sequence that stands for it
    line = Window.partitionBy("rep").orderBy("depth")
    met = rows.select("rep", "lcp", *_KEY).join(stops, _KEY).withColumn("p", F.coalesce(F.lag("depth").over(line), F.col("lcp")))
    return met.where(F.col("rep") == F.col("first")).select(*_KEY, "p", "rep")


def _split(trie: DataFrame, located: DataFrame, blocks: DataFrame) -> DataFrame:
    """(depth, g1, g2, p, rep) of all nodes of the trie after its edges were cut where sequences leave them."""
    cut = located.where("x is not null and lcp > 0 and lcp < x").groupBy("x", "x1", "x2", "lcp").agg(F.min("rep").alias("rep"))
    cut = _looked_up(cut, blocks, "rep", "lcp").select("x", "x1", "x2", F.col("lcp").alias("depth"), F.col("found.g1").alias("g1"), F.col("found.g2").alias("g2"), "rep")
    old = trie.select(F.col("depth").alias("x"), F.col("g1").alias("x1"), F.col("g2").alias("x2"), *_KEY, "rep", "p")
    # a cut at an edge's upper end is no cut: that node is there
    upper = old.select("x", "x1", "x2", F.col("p").alias("from"))
    cut = cut.join(upper, ["x", "x1", "x2"]).where(F.col("depth") > F.col("from")).withColumn("p", F.col("from")).select(*old.columns)
    line = Window.partitionBy("x", "x1", "x2").orderBy("depth")
    return old.unionAll(cut).withColumn("p", F.coalesce(F.lag("depth").over(line), F.col("p"))).select(*_KEY, "p", "rep")


def compacted(strings: DataFrame, blocks: DataFrame, batches: tuple[int, ...] = BATCHES) -> DataFrame:
    """(depth, g1, g2, p, rep): the compacted nodes of `strings` (rep, len), distinct and not empty, with their parent's depth and a sequence through them; staged."""
    longest = strings.agg(F.max("len")).first()[0] or 0
    part = F.pmod(F.xxhash64("rep"), F.lit(sum(batches)))
    nodes, at = None, 0
    for i, share in enumerate(batches):
        batch = strings.where((part >= at) & (part < at + share)).select("rep", "len")
        at += share
        if not longest or nodes is None:
            out = stage(_new_nodes(batch.withColumn("lcp", F.lit(0).cast("long")), blocks), f"trie-{i}")
        else:
            trie = _handles(nodes, blocks)
            located = _located(batch, trie, blocks, longest)
            out = stage(_split(trie, located, blocks).unionAll(_new_nodes(located, blocks)), f"trie-{i}")
            unstage(trie, located, nodes)
        nodes = out
    return nodes


def _summed_up(nodes: DataFrame, sums: list[str], least: str) -> DataFrame:
    """`nodes` (g1, g2, q1, q2 of the parent or null) with `sums` added up and `least` taken over each one's whole subtree, staged.

    Every node looks twice as far up in each round and takes in what looks to it, so no
    subtree is gathered and rounds grow with the logarithm of the height.
    """
    table = nodes
    turn = 0
    while True:
        up = table.where("q1 is not null").groupBy(F.col("q1").alias("g1"), F.col("q2").alias("g2")).agg(*[F.sum(c).alias(f"_{c}") for c in sums], F.min(least).alias(f"_{least}"))
        more = {c: F.col(c) + F.coalesce(f"_{c}", F.lit(0).cast("long")) for c in sums} | {least: F.least(least, f"_{least}")}
        further = table.select(F.col("g1").alias("q1"), F.col("g2").alias("q2"), F.col("q1").alias("r1"), F.col("q2").alias("r2")).where("r1 is not null")
        # nodes right below the root have nothing further up and need no join
        grown = table.join(up, ["g1", "g2"], "left").withColumns(more).select(*table.columns)
        looks = (F.col("q1") != 0) | (F.col("q2") != 0)
        near = grown.where(~F.coalesce(looks, F.lit(False))).withColumns({"q1": F.lit(None).cast("long"), "q2": F.lit(None).cast("long")})
        far = grown.where(looks).join(further, ["q1", "q2"], "left").withColumns({"q1": F.col("r1"), "q2": F.col("r2")})
        grown = stage(near.unionAll(far.select(*near.columns)), "sums")
        if turn:
            unstage(table)
        table, turn = grown, turn + 1
        if table.where("q1 is not null").isEmpty():
            return table


def _joined(batches):
    """(g1, g2, first, ids): members of each group, in order, comma-joined in chunks."""
    key, first, parts, size = None, 0, [], 0
    out = [[], [], [], []]

    def close():
        for column, value in zip(out, (*key, first, ",".join(parts))):
            column.append(value)

    for batch in batches:
        for g1, g2, conv in zip(*[batch.column(c).to_pylist() for c in ("g1", "g2", "conv")]):
            if key != (g1, g2) or size > CHUNK:
                if parts:
                    close()
                key, first, parts, size = (g1, g2), conv, [], 0
            parts.append(str(conv))
            size += len(parts[-1]) + 1
            if len(out[0]) >= 4096 or len(out[0]) * size > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], ["g1", "g2", "first", "ids"])
                out = [[], [], [], []]
    if parts:
        close()
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], ["g1", "g2", "first", "ids"])


def _digested(batches):
    """(g1, g2, ends_sha256): the digest of all chunks of a group, fed one by one."""
    key, digest, done = None, None, []

    def table():
        columns = list(zip(*done)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["g1", "g2", "ends_sha256"])

    for batch in batches:
        for g1, g2, ids in zip(*[batch.column(c).to_pylist() for c in ("g1", "g2", "ids")]):
            if key != (g1, g2):
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (g1, g2), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield table()
        done = []
    if key is not None:
        done.append((*key, digest.hexdigest()))
    yield table()


def listed_digests(members: DataFrame) -> DataFrame:
    """(g1, g2, ends_sha256): SHA-256 of the ascending, comma-joined `conv` of each group of `members` (g1, g2, conv).

    The digest of a group is one task's work by its nature; ids reach it joined in chunks, and are never held together.
    """
    dealt = members.select("g1", "g2", "conv").repartitionByRange("g1", "g2", "conv").sortWithinPartitions("g1", "g2", "conv")
    chunks = dealt.mapInArrow(_joined, "g1 long, g2 long, first long, ids string")
    return chunks.repartition("g1", "g2").sortWithinPartitions("g1", "g2", "first").select("g1", "g2", "ids").mapInArrow(_digested, "g1 long, g2 long, ends_sha256 string")


def prefix_nodes(turns: DataFrame, members: DataFrame, batches: tuple[int, ...] = BATCHES) -> DataFrame:
    """A row for every distinct prefix of the sequences, down to the empty one at depth 0.

    `turns` holds (conv, depth, turn, chars): the digest of each turn and the code
    points of its text, depths from 1 without gaps; `members` holds (conv) of
    every sequence, those without turns too, each once and not null. Returns conv_id (the
    smallest member), depth, parent_conv_id (null at the root), n_convs, n_children,
    n_leaves (childless nodes below or at it), saved_tokens (over its subtree, each node's
    (n_convs - 1) times the code points of its last turn) and ends_sha256 (of the ids of the
    members that end there). Without members there are no rows. A sequence may be
    very long, and any number may be equal or share turns.
    """
    blocks = blocks_of(turns)
    last = F.element_at("at", -1)
    tops = blocks.groupBy("conv").agg(F.max(F.struct(last["depth"].alias("depth"), last["g1"].alias("g1"), last["g2"].alias("g2"), last["chars"].alias("chars"))).alias("end"))
    zero = F.lit(0).cast("long")
    ends = members.select("conv").join(tops, "conv", "left")
    ends = stage(ends.select("conv", *[F.coalesce(f"end.{c}", zero).alias(c) for c in (*_KEY, "chars")]), "ends")
    strings = stage(ends.groupBy(*_KEY, "chars").agg(F.min("conv").alias("rep"), F.count("*").alias("n")), "strings")
    own = strings.where("depth > 0").select("rep", F.col("depth").alias("len"))
    wanted = own.select(F.col("rep").alias("conv"), F.explode(F.sequence(zero, _block(F.col("len")))).alias("block"))
    spoken = stage(blocks.join(wanted, ["conv", "block"]).select(*blocks.columns), "spoken")
    unstage(blocks)
    nodes = compacted(own, spoken, batches)

    spots = nodes.select("*", F.explode(F.array(F.col("depth"), F.col("p"))).alias("d")).where("d > 0")
    seen = _looked_up(spots, spoken, "rep", "d")
    pick = lambda at, part: F.max(F.when(F.col("d") == F.col(at), F.col(f"found.{part}")))
    seen = seen.groupBy(*_KEY, "p", "rep").agg(pick("depth", "chars").alias("chars"), *[F.coalesce(pick("p", part), zero).alias(name) for part, name in (("g1", "q1"), ("g2", "q2"), ("chars", "p_chars"))])
    null = F.lit(None).cast("long")
    root = members.limit(1).select(zero.alias("depth"), zero.alias("g1"), zero.alias("g2"), null.alias("p"), null.alias("rep"), zero.alias("chars"), null.alias("q1"), null.alias("q2"), zero.alias("p_chars"))
    tree = seen.select(*root.columns).unionAll(root)
    tree = tree.join(strings.select(*_KEY, "n", F.col("rep").alias("least")), _KEY, "left").join(tree.where("p is not null").groupBy(F.col("q1").alias("g1"), F.col("q2").alias("g2")).agg(F.count("*").alias("n_children")), ["g1", "g2"], "left")
    tree = stage(tree.withColumns({"n": F.coalesce("n", zero), "n_children": F.coalesce("n_children", zero)}), "tree")
    values = {"n_leaves": (F.col("n_children") == 0).cast("long"), "total": F.col("n") * F.col("chars"), "edges": F.col("chars") - F.col("p_chars")}
    summed = _summed_up(tree.withColumns(values).select("g1", "g2", "q1", "q2", "n", "least", *values), ["n", *values], "least")
    summed = summed.select("g1", "g2", F.col("n").alias("n_convs"), F.col("least").alias("conv_id"), "n_leaves", "total", "edges")
    parents = summed.select(F.col("g1").alias("q1"), F.col("g2").alias("q2"), F.col("conv_id").alias("above"))
    ended = listed_digests(ends.join(strings.select(*_KEY), _KEY, "left_semi"))
    tree = tree.drop("n", "least").join(summed, ["g1", "g2"]).join(parents, ["q1", "q2"], "left").join(ended, ["g1", "g2"], "left")
    tree = stage(tree.select("depth", "p", "rep", "p_chars", "n_children", "n_convs", "conv_id", "n_leaves", "total", "edges", "above", "ends_sha256"), "trie")

    # the edges, expanded: the node one turn below the parent, and one behind each inner prefix
    top = tree.withColumns({"at": F.coalesce(F.col("p") + 1, zero), "before": F.col("p_chars")})
    inner = tree.where("depth - p > 1").withColumn("block", F.explode(F.sequence(_block(F.col("p") + 1), _block(F.col("depth") - 1))))
    inner = inner.join(spoken.withColumnRenamed("conv", "rep"), ["rep", "block"]).withColumn("a", F.explode("at")).where("a.depth > p and a.depth < depth")
    inner = inner.withColumns({"before": F.col("a.chars")}).withColumn("at", F.col("a.depth") + 1)
    every = top.unionAll(inner.select(*top.columns))
    ends_here = F.col("at") == F.col("depth")
    nothing = hashlib.sha256(b"").hexdigest()
    return every.select(
        "conv_id",
        F.col("at").alias("depth"),
        F.when(F.col("at") == F.col("p") + 1, F.col("above")).when(F.col("at") > 0, F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(ends_here, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"),
        "n_leaves",
        (F.col("total") - F.col("n_convs") * F.col("before") - F.col("edges") + F.col("before") - F.col("p_chars")).alias("saved_tokens"),
        F.when(ends_here, F.coalesce("ends_sha256", F.lit(nothing))).otherwise(F.lit(nothing)).alias("ends_sha256"),
    )


__all__ = ["blocks_of", "compacted", "listed_digests", "prefix_nodes", "turn_digest"]
