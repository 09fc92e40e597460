"""Connected components of an edge table, by joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidegate.llm.common import stage, unstage


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): each node of `edges` with the least node it is linked to.

    Alternates two contractions until nothing changes: every node's larger
    neighbours move to its least neighbour ("large star"), then its smaller ones
    ("small star"). A round is two grouped minima and two joins on the node; the
    number of rounds grows with the logarithm of the longest chain, and edges
    never outnumber those put in. Minima are taken before the shuffle, so a node
    with very many neighbours is never gathered. Each round is a staged table.
    Null ends and self-links are left out.
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.select(F.col("u"), F.col("v"))
        if large:
            both = both.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        if large:
            moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    def kept(links: DataFrame):
        """The staged links with their number and a sum of their digests, both taken while they are written."""
        seen = Observation()
        out = stage(links.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest")), "links")
        return out, (seen.get["n"], seen.get["digest"])

    links, before = kept(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct())
    while before[0]:
        now, after = kept(star(star(links, True), False))
        unstage(links)
        links = now
        if after == before:
            break
        before = after
    pairs = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return pairs.unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
