"""Lookups over tables, against plain Python."""

import random

from tidegate.operators import catalog as K


def test_markers_are_found_as_by_plain_search(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abAB é") for _ in range(n))
    texts = [(i, word(rng.randint(0, 200)) if i % 9 else None, "more") for i in range(200)]
    needles = sorted({word(rng.randint(1, 4)).lower() for _ in range(300)} | {"", "b", "ab", "bab"})
    found = K.marker_scan(spark.createDataFrame(texts, "id int, text string, other string").repartition(3), "text", spark.createDataFrame([(n,) for n in needles] + [(None,), ("b",)], "needle string"))
    assert found.columns == ["id", "other", "needle"]
    got = sorted((r.id, r.needle) for r in found.collect())
    assert got == sorted((i, n) for i, t, _ in texts if t is not None for n in needles if n in t.lower())


def test_many_markers_cost_one_pass(spark):
    needles = spark.range(10_000).selectExpr("concat('needle', id, 'x') needle")
    texts = spark.range(300).selectExpr("id", "concat('some text ', repeat('filler words ', 50), 'needle', id * 7, 'x needle', id, 'y') text")
    got = {r.id: r.needle for r in K.marker_scan(texts, "text", needles).collect()}
    assert got == {i: f"needle{7 * i}x" for i in range(300)}
