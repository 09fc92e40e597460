"""Shards of equal row counts that cut few links: balanced label propagation.

Documents start in shards by chance. In each round, linked documents vote for the
shard that holds most of them, and move there as far as its quota goes; what found no
room votes again among the shards that have some. Documents without links fill
the shards up at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import stage, unstage
from tidegate.llm.ordered import running

#: A cluster of more than this part of a shard is heavy; there are PARTS heavy clusters a shard at most.
PARTS = 64


def _clusters(base: DataFrame, quota: int) -> DataFrame:
    """`base` with `cluster`: rows of one link that shall come together; null for rows without a link to another.

    A link of more rows than a shard takes is dealt into clusters of nine tenths of a shard, as chance makes some larger.
    """
    heavy = max(1, quota // PARTS)
    counts = stage(base.where("link is not null").groupBy("link").count().where("count > 1"), "counts")
    # at most PARTS a shard, as each holds that part of a shard's rows
    hot = counts.where(F.col("count") > heavy).select("link", F.when(F.col("count") > quota, F.col("count") / F.lit(0.9 * quota)).otherwise(1.0).alias("pieces"))
    piece = F.floor(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("pieces"))
    salted = base.join(F.broadcast(hot), "link").withColumn("cluster", F.xxhash64("link", piece))
    rest = base.where("link is not null").join(F.broadcast(hot), "link", "left_anti").join(counts.where(F.col("count") <= heavy).select("link", F.xxhash64("link").alias("cluster")), "link", "left")
    alone = base.where("link is null").withColumn("cluster", F.lit(None).cast("long"))
    out = stage(salted.select(*base.columns, "cluster").unionAll(rest.select(*base.columns, "cluster")).unionAll(alone.select(*base.columns, "cluster")), "clusters")
    unstage(counts)
    return out


def _taken(sums: list[tuple[int, int, int]], room: list[int]) -> list[tuple[int, int, float]]:
    """For each (shard, size class, rows), a class being a whole logarithm, the share of them the shard takes; larger ones first."""
    out, left = [], list(room)
    for shard, size, rows in sorted(sums, reverse=True):
        out.append((shard, size, min(1.0, max(0, left[shard]) / rows)))
        left[shard] -= rows
    return out


def _listed(values: list[int]) -> Column:
    return F.expr(f"array({','.join(f'{v}L' for v in values)})")


def propagate(votes: DataFrame, shards: int, quota: int, rounds: int) -> DataFrame:
    """(cluster, target, m): the shard each cluster of m rows comes to, from `votes` (cluster, shard, n).

    What fits in no shard as a whole is left out.
    """
    heavy = max(1, quota // PARTS)
    room = [quota] * shards
    floating, settled = votes, None
    for turn in range(rounds):
        space = _listed(room)
        fits = lambda s: F.get(space, s) >= F.col("m")
        per = floating.groupBy("cluster").agg(F.sum("n").alias("m"), F.collect_list(F.struct("n", F.xxhash64("cluster", "shard").alias("h"), "shard")).alias("votes"))
        most = F.array_max(F.filter("votes", lambda v: fits(v["shard"])))
        others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: fits(s))
        other = F.get("others", F.pmod(F.xxhash64("cluster", F.lit(turn)), F.size("others")).cast("int"))
        per = per.withColumn("others", others).select("cluster", "m", F.coalesce(most["shard"], F.when(F.size("others") > 0, other)).alias("target"))
        wanted = stage(per.where("target is not null"), "wanted")
        # heavy clusters one after another, the largest first: a bounded number
        line = Window.partitionBy("target").orderBy(F.desc("m"), "cluster").rowsBetween(Window.unboundedPreceding, 0)
        large = wanted.where(F.col("m") > heavy).withColumn("upto", F.sum("m").over(line)).where(F.col("upto") <= F.get(space, F.col("target"))).drop("upto")
        large = stage(large, "large")
        left = list(room)
        for target, m in large.groupBy("target").agg(F.sum("m")).collect():
            left[target] -= m
        size = F.length(F.bin("m")) - 1
        light = wanted.where(F.col("m") <= heavy).withColumn("size", size)
        sums = [tuple(r) for r in light.groupBy("target", "size").agg(F.sum("m")).collect()]  # shards x size classes
        share = votes.sparkSession.createDataFrame(_taken(sums, left), "target int, size int, share double")
        chance = F.pmod(F.xxhash64("cluster", F.lit(-1 - turn)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        small = light.join(F.broadcast(share), ["target", "size"]).where(chance < F.col("share")).select("cluster", "m", "target")
        came = stage(large.unionAll(small), "came")
        unstage(wanted, large)
        moved = 0
        for target, m in came.groupBy("target").agg(F.sum("m")).collect():
            room[target] -= m
            moved += m
        settled = came if settled is None else settled.unionAll(came)
        if not moved:
            break
        rest = stage(floating.join(came.select("cluster"), "cluster", "left_anti"), "floating")
        if turn:
            unstage(floating)
        floating = rest
        if floating.isEmpty():
            break
    return settled


def balanced_shards(rows: DataFrame, shards: int = 40, rounds: int = 8) -> DataFrame:
    """`rows` with `shard` (from 0) and `slot` (from 0 in each shard): counts of shards differ by one at most.

    Rows with equal `link` are linked; null links to nothing. A row has one link at
    most, so documents of one link see the same neighbours and move together, as
    one entry of the tables that rounds join. A link with more rows than a
    shard takes is spread over as many shards as it fills. Rows that are equal or
    repeat ids are rows of their own. An empty table gives an empty result.
    Columns `row`, `cluster`, `target`, `place` of `rows` are not allowed.
    """
    base = stage(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    total = base.count()
    if not total:
        return rows.limit(0).withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    quota = max(1, total // shards)
    clustered = _clusters(base, quota)
    unstage(base)
    linked = clustered.where("cluster is not null")
    votes = stage(linked.groupBy("cluster", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("n")), "votes")
    settled = stage(propagate(votes, shards, quota, rounds).select("cluster", "target", F.col("m") > max(1, quota // PARTS)), "settled").toDF("cluster", "target", "is_heavy")

    # heavy clusters, a bounded number, meet their rows in place, so that no key of the join below is hot
    large = clustered.join(F.broadcast(settled.where("is_heavy").select("cluster", F.col("target").alias("heavy"))), "cluster", "left")
    light = settled.where("not is_heavy").select(F.col("cluster").alias("key"), F.col("target").alias("light"))
    key = F.when(F.col("heavy").isNull(), F.col("cluster"))
    # rows that need no partner get a key of their own
    placed = large.where(key.isNull()).withColumn("target", F.col("heavy")).unionAll(large.where(key.isNotNull()).join(light, F.col("cluster") == F.col("key"), "left").withColumn("target", F.col("light")).drop("key", "light"))
    placed = placed.drop("heavy").withColumn("target", F.coalesce("target", F.lit(shards)))
    ranked, pieces = running(placed, "target", [F.col("cluster").isNull(), "cluster", "row"])

    counts = [0] * (shards + 1)
    for target, n in pieces.groupBy("target").count().collect():
        counts[target] = n
    by_size = sorted(range(shards), key=lambda s: -counts[s])
    size = [total // shards] * shards
    for s in by_size[: total % shards]:
        size[s] += 1
    own = [min(counts[s], size[s]) for s in range(shards)]
    # rows beyond a shard's size and rows without a target are in one line, which fills the shards in turn
    line, at = [], 0
    for s in range(shards):
        line.append(at)
        at += counts[s] - own[s]
    line.append(at)
    opens, at = [], 0
    for s in range(shards):
        opens.append(at)
        at += size[s] - own[s]
    pick = lambda values, i: F.get(_listed(values), i)
    stays = F.col("place") < pick([*own, 0], F.col("target"))
    ranked = ranked.withColumn("at", F.col("place") - pick([*own, 0], F.col("target")) + pick(line, F.col("target")))
    filled = F.expr(f"size(filter(array({','.join(f'{o}L' for o in opens)}), o -> o <= at)) - 1")
    # of shards that open at one place, the last has room
    ranked = ranked.withColumn("shard", F.when(stays, F.col("target")).otherwise(filled).cast("int"))
    slot = F.when(stays, F.col("place")).otherwise(pick(own, F.col("shard")) + F.col("at") - pick(opens, F.col("shard")))
    return ranked.withColumn("slot", slot).select(*rows.columns, "shard", "slot")
