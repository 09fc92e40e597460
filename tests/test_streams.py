"""Lifecycles as streams: states, expiry, quota, watches, screening and derived work."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegate.sources.publish import published, publish
from tidegate.streaming import lifecycle as L

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "upload_key string, action string, owner string, bytes long, size long, ts timestamp, seq long"


def at(s):
    return T0 + dt.timedelta(seconds=s)


def streamed(spark, tmp_path, batches, make, mode="append"):
    """Rows of a stream whose input arrives as one file per batch."""
    source, out = tmp_path / "in", []
    source.mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        part = next((tmp_path / f"b{i}").glob("part*"))
        part.rename(source / f"{i}.parquet")
        L.run_available(make(stream), lambda df, n: out.extend(df.collect()), str(tmp_path / "state"), mode).awaitTermination()
    return out


def test_upload_states(spark, tmp_path):
    first = [
        ("a", "create", "o", 0, 100, at(0), 1), ("a", "upload", "o", 10, 100, at(1), 2), ("a", "complete", "o", 100, 100, at(2), 3), ("a", "upload", "o", 1, 100, at(3), 4),
        ("b", "create", "o", 0, 9, at(0), 1), ("b", "cancel", "o", None, None, at(1), 2), ("b", "upload", "o", None, None, at(2), 3),
        ("c", "upload", "o", 1, 1, at(0), 1), ("d", "create", "p", 0, 5, at(0), 1),
    ]
    later = [("z", "create", "p", 0, 1, at(500), 1)]
    rows = streamed(spark, tmp_path, [first, later, [("z", "upload", "p", 0, 1, at(501), 2)]], L.upload_state)
    by = {}
    for r in rows:
        by.setdefault(r.upload_key, []).append((r.status, r.error))
    assert by["a"] == [("key_created", None), ("uploading", None), ("uploaded", None), ("uploaded", "upload_already_completed")]
    assert by["b"] == [("key_created", None), ("canceled", None), ("canceled", "upload_canceled")]
    assert by["c"][0] == (None, "upload_key_not_found")
    assert by["d"] == [("key_created", None), ("expired", None)]


def test_quota(spark, tmp_path):
    rows = [(f"k{i}", "create", "o", 0, 1, at(i), i) for i in range(3)] + [("k0", "complete", "o", 1, 1, at(4), 4), ("k9", "create", "o", 0, 1, at(5), 5)]
    got = streamed(spark, tmp_path, [rows], lambda s: L.quota_stream(s, 2))
    assert [(r.upload_key, r.active, r.code) for r in got] == [("k0", 1, None), ("k1", 2, None), ("k2", 2, "too_many_upload_keys"), ("k9", 2, None)]


def test_keys_of_many_rows_are_sorted_in_parts(monkeypatch):
    """No frame is as large as the key, and the order is that of one sort, nulls last."""
    monkeypatch.setattr(L, "HELD", 50)
    monkeypatch.setattr(L, "PART", 10)
    monkeypatch.setattr(L, "FAN", 3)
    rng = np.random.default_rng(1)
    for n in (0, 1, 49, 50, 51, 700, 2000):
        rows = pd.DataFrame({"ts": pd.Timestamp(T0) + pd.to_timedelta(rng.integers(0, 50, n), unit="s"), "seq": rng.permutation(n), "action": [f"a{i}" for i in range(n)], "bytes": rng.random(n), "owner": [None if i < 90 else "o" for i in range(n)]})
        rows.loc[rows.index[::97], "ts"] = None
        frames = list(L.in_order((rows[i : i + 23] for i in range(0, n, 23)), ["ts", "seq"]))
        assert all(len(f) <= 50 for f in frames)
        want = rows.sort_values(["ts", "seq"], ignore_index=True)
        if n:
            pd.testing.assert_frame_equal(pd.concat(frames, ignore_index=True), want, check_dtype=False)


def test_progress_agrees_with_batch(spark, tmp_path):
    rows = [("a", "progress", "o", b, 100, at(b), b) for b in (10, 50, 100)] + [("b", "complete", "o", 100, 100, at(1), 1)]
    got = {r.upload_key: r.shown for r in streamed(spark, tmp_path, [rows], L.progress, "update")}
    assert got == {"a": 98, "b": 100}


def test_watch(spark):
    requests = spark.createDataFrame([("c1", "a", "watch", 1, 1), ("c1", "a", "watch", 2, 2), ("c2", "a", "watch", 1, 1), ("c2", "a", "unwatch", 2, 2), ("c1", "x", "watch", 1, 1)], "client string, upload_key string, action string, ts int, seq int")
    items = spark.createDataFrame([("a", "uploading")], "upload_key string, status string")
    updates = spark.createDataFrame([("a", "uploaded")], "upload_key string, status string")
    got = sorted((r.client, r.upload_key, r.type, r.message) for r in L.watch_messages(requests, items, updates).collect())
    assert got.count(("c1", "a", "snapshot", None)) == 2 and got.count(("c1", "a", "update", None)) == 1
    assert ("c1", "x", "error", "upload key not found") in got and ("c2", "a", "update", None) not in got


@pytest.fixture
def drop(tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    (folder / "a.txt").write_text("fine text\n")
    (folder / "b.sh").write_text("#!/bin/sh\n")
    return folder


def test_screen_and_derive(spark, tmp_path, drop):
    path = lambda n: str(tmp_path / n)
    L.screen_stream(spark, str(drop), path("ok"), path("bad"), path("s1")).awaitTermination()
    assert [r.original_name for r in spark.read.parquet(path("ok")).collect()] == ["a.txt"]
    assert [(r.original_name, r.verdict) for r in spark.read.parquet(path("bad")).collect()] == [("b.sh", "script_upload_rejected")]
    accepted = spark.readStream.schema(spark.read.parquet(path("ok")).drop("batch").schema).parquet(path("ok"))
    L.derive_stream(accepted, path("texts"), path("tasks"), path("s2")).awaitTermination()
    assert "fine text" in spark.read.parquet(path("texts")).select(F.col("body")).first()[0]
    schema = "object_key string, kind string, status string, batch int"
    pending, done = published(spark, path("tasks/pending"), schema), published(spark, path("tasks/done"), schema, path("s2") + "/published")
    assert pending.count() == done.count() == 1 and L.pending_tasks(pending.unionAll(done)).count() == 0


def numbered(rows):
    """Events in order of time, as a watermark of no delay needs them."""
    rows = sorted(rows, key=lambda r: r[3])
    return [(k, a, o, 0, 1, at(t), i) for i, (k, a, o, t) in enumerate(rows)]


LIFE = numbered([
    ("a", "create", "o", 0), ("a", "upload", "o", 5), ("b", "create", "o", 1), ("b", "upload", "o", 2), ("b", "complete", "o", 9), ("b", "upload", "o", 50), ("c", "create", "o", 3),
    ("c", "fail", "o", 4), ("c", "upload", "o", 14), ("a", "complete", "o", 20), ("a", "create", "o", 21), ("b", "create", "o", 62), ("x", "upload", "o", 200), ("x", "create", "o", 400), ("y", "upload", "o", 900),
])


@pytest.mark.parametrize("size", [1, 4, 20])
def test_deadlines_fire_whatever_has_begun_and_however_events_fall(spark, tmp_path, size):
    """An upload under way expires at its start deadline; one batch or many give the same rows."""
    rows = streamed(spark, tmp_path, [LIFE[i : i + size] for i in range(0, len(LIFE), size)], lambda s: L.upload_state(s, watermark="0 seconds"))
    by = {}
    for r in sorted(rows, key=lambda r: (r.ts, r.error is None)):
        by.setdefault(r.upload_key, []).append((r.status, (r.ts - T0).total_seconds(), r.error))
    assert by["a"] == [("key_created", 0, None), ("uploading", 5, None), ("expired", 10, None), (None, 20, "upload_key_not_found"), ("key_created", 21, None), ("expired", 31, None)]
    assert by["b"] == [("key_created", 1, None), ("uploading", 2, None), ("uploaded", 9, None), ("uploaded", 50, "upload_already_completed"), ("key_created", 62, None), ("expired", 72, None)]
    assert by["c"] == [("key_created", 3, None), ("failed", 4, None), ("expired", 13, None), (None, 14, "upload_key_not_found")]
    assert by["x"][1:] == [("key_created", 400, None), ("expired", 410, None)]


def test_quota_keys_expire_and_leave_no_state(spark, tmp_path):
    rows = numbered([("k1", "create", "o", 0), ("k2", "create", "o", 1), ("k3", "create", "o", 10), ("k4", "create", "o", 11), ("k5", "create", "", 11), ("k6", "create", "o", 12)])
    got = streamed(spark, tmp_path, [rows], lambda s: L.quota_stream(s, 2))
    assert [(r.upload_key, r.active, r.code) for r in got] == [("k1", 1, None), ("k2", 2, None), ("k3", 2, "too_many_upload_keys"), ("k4", 2, None), ("k6", 2, None)]
    source = tmp_path / "quiet"
    source.mkdir()
    seen = []
    stream = spark.readStream.schema(SCHEMA).parquet(str(source))
    for i, rows in enumerate([LIFE[:4], numbered([("z", "cancel", "zz", 5000)]), numbered([("z", "cancel", "zz", 6000)])]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"q{i}"))
        next((tmp_path / f"q{i}").glob("part*")).rename(source / f"{i}.parquet")
        query = L.run_available(L.quota_stream(stream, 5), lambda df, n: df.count(), str(tmp_path / "qs"))
        query.awaitTermination()
        seen.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert seen[0] == 1 and seen[-1] == 0


def test_watches_live_through_batches_and_restarts(spark, tmp_path):
    schema = "upload_key string, kind string, client string, status string, ts timestamp, seq long"
    steps = [
        [("k", "watch", "c1", None, at(0), 1), ("k", "update", None, "key_created", at(1), 2)],
        [("k", "watch", "c2", None, at(2), 3), ("k", "watch", "c1", None, at(3), 4)],
        [("k", "unwatch", "c1", None, at(4), 5), ("k", "update", None, "uploading", at(5), 6), ("other", "update", None, "uploaded", at(5), 7)],
        [("k", "update", None, "uploaded", at(300), 8), ("k", "watch", "c3", None, at(301), 9)],
    ]
    source, out = tmp_path / "in", []
    source.mkdir()
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        next((tmp_path / f"b{i}").glob("part*")).rename(source / f"{i}.parquet")
        stream = L.watch_stream(spark.readStream.schema(schema).parquet(str(source)), 100)
        L.run_available(stream, lambda df, n: out.extend(df.collect()), str(tmp_path / "state")).awaitTermination()
    got = [(r.client, r.type, r.status, r.message) for r in sorted(out, key=lambda r: r.seq)]
    assert got == [
        ("c1", "error", None, "upload key not found"), ("c1", "update", "key_created", None), ("c2", "snapshot", "key_created", None), ("c1", "snapshot", "key_created", None),
        ("c2", "update", "uploading", None), ("c3", "snapshot", "uploaded", None),
    ]


def test_a_batch_that_is_taken_again_shows_once(spark, tmp_path):
    """Killed between the two writings of a batch: nothing shows; taken again, all shows once."""
    ok, bad, ledger = (str(tmp_path / n) for n in ("ok", "bad", "ledger"))
    rows = spark.range(10).withColumn("verdict", F.when(F.col("id") % 2 == 0, "bad"))
    spark.conf.set("spark.sql.ansi.enabled", "true")
    broken = rows.where("verdict is not null").withColumn("verdict", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception):
        publish(0, {ok: rows.where("verdict is null"), bad: broken}, ledger)
    read = lambda p: published(spark, p, "id long, verdict string", ledger)
    assert read(ok).count() == read(bad).count() == 0
    for _ in range(2):
        publish(0, {ok: rows.where("verdict is null"), bad: rows.where("verdict is not null")}, ledger)
    publish(1, {ok: rows.where("id = 1"), bad: rows.where("id = 99")}, ledger)
    assert (read(ok).count(), read(bad).count()) == (6, 5)


def test_sweep_runs_by_the_clock(spark, tmp_path):
    markers = [("a", "2024-01-01T00:00:10Z", "2024-01-01T00:01:00Z"), ("b", "2999-01-01T00:00:10Z", "2999-01-01T00:01:00Z"), ("c", "2999-01-01T00:00:10Z", "2024-01-01T00:01:00Z")]
    left, seen = {m[0]: m for m in markers}, []
    read = lambda: spark.createDataFrame(list(left.values()), "upload_key string, upload_start_deadline string, upload_finish_deadline string")

    def each(gone, number):
        keys = [r.upload_key for r in gone.collect()]
        seen.append(keys)
        for k in keys:
            del left[k]

    query = L.sweep_stream(spark, read, each, str(tmp_path / "sweep"), "1 second")
    for _ in range(60):
        if len(seen) >= 2:
            break
        query.awaitTermination(1)
    query.stop()
    assert sorted(seen[0]) == ["a", "c"] and not any(seen[1:]) and set(left) == {"b"}
