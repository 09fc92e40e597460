"""Shards of equal counts that cut few links."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidegate.llm import queries, sharding
from tidegate.llm.ordered import running


def lawful(rows, shards):
    """Counts at most one apart, slots without gaps; the number of links whose rows lie in several shards."""
    counts, spread = Counter(r.shard for r in rows), defaultdict(set)
    full = [counts[s] for s in range(shards)]
    assert max(full) - min(full) <= 1 and sum(full) == len(rows)
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(full[s]))
    for r in rows:
        if r.link is not None:
            spread[r.link].add(r.shard)
    return sum(len(s) > 1 for s in spread.values())


@pytest.mark.parametrize("n,shards,link", [(1000, 8, "id % 300"), (997, 8, "case when id % 3 = 0 then -1 else id end"), (40, 40, "id % 2"), (7, 40, "1"), (500, 7, "id div 2"), (640, 8, "id % 16")])
def test_counts_are_equal_and_links_kept(spark, n, shards, link):
    rows = spark.range(n).withColumn("link", F.expr(link).cast("long"))
    got = sharding.balanced_shards(rows, shards).collect()
    assert sorted(r.id for r in got) == list(range(n))
    cut = lawful(got, shards)
    # a link is cut only if it is larger than a shard, or its shard is full
    sizes = Counter(r.link for r in got)
    assert cut <= sum(k > n // shards for k in sizes.values()) + shards


def test_a_hot_link_fills_few_shards(spark):
    rows = spark.range(3000).withColumn("link", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")))
    got = sharding.balanced_shards(rows, 10).collect()
    lawful(got, 10)
    assert len({r.shard for r in got if r.link == -1}) <= 5  # 1000 rows; a shard takes 300


def test_nulls_repeats_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, None)] * 5 + [(1, 7)] * 4 + [(2, None)] * 3, "id long, link long")
    got = sharding.balanced_shards(rows, 3).collect()
    assert len(got) == 12 and lawful(got, 3) == 0
    empty = sharding.balanced_shards(rows.limit(0), 3)
    assert empty.columns == ["id", "link", "shard", "slot"] and empty.count() == 0


def test_running_totals_across_pieces(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 5 < 3, 0).otherwise(F.col("id") % 7).cast("long").alias("k"), (F.col("id") * 37 % 1009).alias("o"), "id", (F.col("id") % 11 - 5).alias("v"))
    got = defaultdict(list)
    spread, _ = running(rows, "k", ["o", "id"], ["v"])
    for r in spread.collect():
        got[r.k].append(r)
    want = defaultdict(list)
    for r in rows.collect():
        want[r.k].append(r)
    assert set(got) == set(want)
    for k, own in want.items():
        total = 0
        have = sorted(got[k], key=lambda r: r.place)
        for i, (r, h) in enumerate(zip(sorted(own, key=lambda r: (r.o, r.id)), have, strict=True)):
            assert (h.place, h.v_before, h.id) == (i, total, r.id)
            total += r.v
            assert h.v == total


def test_running_totals_wrap(spark):
    rows = spark.range(6).select(F.lit(1).alias("k"), "id", F.lit(2**62).alias("v"))
    got = [r.v for r in running(rows, "k", ["id"], ["v"])[0].orderBy("id").collect()]
    assert got == [(2**62 * (i + 1) + 2**63) % 2**64 - 2**63 for i in range(6)]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_keeps_every_row_and_its_law(spark, data, folder):
    path = data.replace("sf0.001", folder)
    got = queries.op13_sharding(spark, path).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    import zlib

    counts, where = Counter(), defaultdict(set)
    for r in got:
        text = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "rows", None)
        counts[r.shard] += 1
        where[docs[r.doc_id]].add(r.shard)
    assert len(got) == len(docs) and set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(len(s) == 1 for s in where.values())
    assert sorted((r.shard, r.slot) for r in got) == sorted((s, i) for s in counts for i in range(counts[s]))
