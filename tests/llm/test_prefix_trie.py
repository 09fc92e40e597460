"""The trie of prefixes: against plain dictionaries of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidegate.llm import prefix_trie, queries


def plain_nodes(sequences):
    """Rows of the trie from {conv: [(role, text), ...]}."""
    members = defaultdict(list)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        below = children[key]
        leaves[key] = sum(leaves[k] for k in below) or 1
        saved[key] = sum(saved[k] for k in below) + (len(members[key]) - 1) * (len(key[-1][1]) if key else 0)
    rows = []
    for key, convs in members.items():
        ends = sorted(c for c in convs if len(sequences[c]) == len(key))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        rows.append((min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs), len(children[key]), leaves[key], saved[key], digest))
    return sorted(rows, key=repr)


def plain_rebuilt(rows):
    """{conv: turns} of (conv_id, turn, role, text) rows as the query rebuilds them."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def taken(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def grown(spark, sequences, batches=prefix_trie.BATCHES):
    rows = [(c, d + 1, role, text) for c, turns in sequences.items() for d, (role, text) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv long, depth long, role string, text string")
    turns = turns.select("conv", "depth", prefix_trie.turn_digest(F.col("role"), F.col("text")).alias("turn"), F.length("text").cast("long").alias("chars"))
    members = spark.createDataFrame([(c,) for c in sequences], "conv long")
    return prefix_trie.prefix_nodes(turns, members, batches)


@pytest.mark.parametrize("seed,batches", [(1, (1, 7)), (2, (1, 1, 2, 4)), (3, (1,))])
def test_nodes_match_plain_prefixes(spark, seed, batches):
    rng = random.Random(seed)
    sequences = {}
    for c in range(60):
        turns = [("user", "ab"[rng.randrange(2)] * rng.randint(1, 2)) for _ in range(rng.randint(0, 9))]
        if c > 5 and rng.random() < 0.6:  # much in common with an earlier one, or equal to it
            base = sequences[rng.randrange(c)]
            turns = base[: rng.randint(0, len(base))] + turns[: rng.choice([0, 0, 1, 3])]
        sequences[c * 3 - 20] = turns
        sequences = {**sequences, c: sequences.get(c, turns)}
    assert taken(grown(spark, sequences, batches)) == plain_nodes(sequences)


def test_long_sequences_leave_edges_in_any_block(spark):
    trunk = [("user", f"t{i}") for i in range(300)]
    sequences = {0: trunk, 1: trunk[:64], 2: trunk[:65], 3: trunk + [("user", "more")], 4: []}
    sequences |= {10 + i: trunk[:d] + [("bot", f"x{i}")] * k for i, (d, k) in enumerate([(1, 1), (63, 2), (64, 1), (65, 70), (127, 3), (128, 1), (200, 130), (299, 1), (300, 1)])}
    assert taken(grown(spark, sequences)) == plain_nodes(sequences)


def test_query_edges(spark, tmp_path):
    rows = [(100, 1, "user", "a"), (100, 2, "bot", "b"), (100, None, None, "first"), (101, 1, "user", None), (101, 1, "user", None), (101, 3, "bot", "z"), (None, 1, "user", "gone")]
    rows += [(c, t, "user", f"w{t % 3}") for c in (205, 206, 207, 300, 301, 305) for t in range(c % 7 + 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash")).withColumn("place", F.lit("clash"))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert taken(queries.op11_prefix_trie(spark, str(tmp_path))) == plain_nodes(plain_rebuilt(rows))
    df.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries.op11_prefix_trie(spark, f"{tmp_path}/none").count() == 0


def test_members_are_digested_in_chunks(spark, monkeypatch):
    rows = [(1, 1, c) for c in range(30000)] + [(2, 2, c) for c in range(5)]
    got = {r.g1: r.ends_sha256 for r in prefix_trie.listed_digests(spark.createDataFrame(rows, "g1 long, g2 long, conv long").repartition(5)).collect()}
    assert got == {g: hashlib.sha256(",".join(str(c) for a, _, c in rows if a == g).encode()).hexdigest() for g in (1, 2)}


def test_query_matches_plain_prefixes(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert taken(queries.op11_prefix_trie(spark, data)) == plain_nodes(plain_rebuilt(rows))


def test_sql_gives_the_same_nodes(data):
    import duckdb

    con = duckdb.connect()
    for folder in (data, data.replace("sf0.001", "sf0.01")):
        con.execute(f"create or replace view conversations as select * from '{folder}/conversations.parquet'")
        got = con.execute(queries.oracle_sql()["op11_prefix_trie"])
        order = [[c[0] for c in got.description].index(c) for c in COLUMNS]
        rows = con.execute("select conv_id, turn, role, text from conversations").fetchall()
        got = con.execute(queries.oracle_sql()["op11_prefix_trie"]).fetchall()
        assert sorted((tuple(r[i] for i in order) for r in got), key=repr) == plain_nodes(plain_rebuilt(rows))
