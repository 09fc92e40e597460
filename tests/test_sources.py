"""Objects, control records, publishing and the catalog on files."""

import json
import threading

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from tidegate.operators.screen import screen
from tidegate.sources import catalog as C
from tidegate.sources import listing
from tidegate.sources import objects as O


def test_scan_and_ranges(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("a/1.txt", "a/b/2.txt", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    rows = O.scan_objects(spark, str(tmp_path), "a/").select("object_key", "content").collect()
    assert sorted((r.object_key, bytes(r.content)) for r in rows) == [("a/1.txt", b"a/1.txt"), ("a/b/2.txt", b"a/b/2.txt")]
    heads = O.object_heads(spark, str(tmp_path))
    assert {r.object_key: r.size for r in heads.collect()} == {"a/1.txt": 7, "a/b/2.txt": 9, "c.txt": 5}
    assert heads.select("size").agg(F.sum("size")).first()[0] == 21
    df = spark.createDataFrame([(b"0123456789",)], "c binary")
    cut = lambda a, b: df.select(O.byte_range(F.col("c"), a, b)).first()[0]
    assert (bytes(cut(2, 4)), bytes(cut(8, 99)), cut(10, 12)) == (b"234", b"89", None)


def test_control_records(spark, tmp_path):
    rows = [("1", '{"object_key": "k", "kind": ""}', {"Kind": "text"}), ("2", "{oops", {"object-key": "m"}), ("3", None, None)]
    df = spark.createDataFrame(rows, "id string, body string, metadata map<string,string>")
    got = {r.id: (r.object_key, r.kind) for r in O.parse_control_records(df, "task").collect()}
    assert got == {"1": ("k", "text"), "2": ("m", None), "3": (None, None)}

    shares = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("t", "c", 1)], "shared_key string, target_object_key string, n int")
    full = shares.withColumns({c: F.lit("") for c in ("original_name", "content_type", "created_at", "created_by", "expires_at")}).withColumn("revoked", F.lit(False))
    O.write_control_records(full, "share", str(tmp_path / "out"), ["n"])
    back = spark.read.json(str(tmp_path / "out"))
    assert {r.record_key: json.loads(r.body)["target_object_key"] for r in back.collect()} == {"shared/s": "b", "shared/t": "c"}


def test_publish(spark, tmp_path):
    rows = [("1", "a.txt", "text/plain", b"fine"), ("2", "a.sh", "text/plain", b"#!/bin/sh\n")]
    screened = screen(spark.createDataFrame(rows, "object_key string, original_name string, declared_type string, content binary"))
    O.split_publish(screened, str(tmp_path / "ok"), str(tmp_path / "bad"))
    assert [r.object_key for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == ["1"]
    assert [(r.object_key, r.verdict) for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [("2", "script_upload_rejected")]


def test_catalog(spark, tmp_path):
    assert O.read_catalog(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "c.json").write_text(json.dumps([{"id": "1", "name": "a", "size": 3}, {"id": "2", "name": "b"}]))
    catalog = O.read_catalog(spark, str(tmp_path / "c.json"))
    more = O.append_catalog(catalog, spark.createDataFrame([("3", "c")], "id string, name string"))
    left = O.delete_from_catalog(more, spark.createDataFrame([("1",)], "id string"))
    assert sorted((r.id, r.name) for r in left.collect()) == [("2", "b"), ("3", "c")]
    (tmp_path / "blank.json").write_text("")
    assert O.read_catalog(spark, str(tmp_path / "blank.json")).count() == 0


class Counted:
    """A store that notes what is listed, opened and read."""

    def __init__(self, store):
        self.store, self.listed, self.opened, self.read = store, [], [], 0

    def get_file_info(self, selector):
        self.listed.append(selector.base_dir)
        return self.store.get_file_info(selector)

    def open_input_file(self, path):
        self.opened.append(path.rsplit("/", 1)[-1])
        file, outer = self.store.open_input_file(path), self

        class Source:
            def read(self, *n):
                found = file.read(*n)
                outer.read += len(found)
                return found

            seek, size, close = file.seek, file.size, file.close

            def __enter__(self):
                return self

            def __exit__(self, *_):
                file.close()

        return Source()


def test_only_what_is_asked_for_is_listed_and_read(tmp_path, monkeypatch):
    for name in ("a/1.bin", "a/2.bin", "ab/3.bin", "b/c/4.bin", "b/5.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(bytes(range(256)) * 4000)
    store = Counted(pafs.LocalFileSystem())
    monkeypatch.setattr(listing, "opened", lambda path: (store, path))

    def scanned(**options):
        reader = listing._Reader({"path": str(tmp_path), **options})
        return [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]

    assert [r["object_key"] for r in scanned(prefix="a/")] == ["a/1.bin", "a/2.bin"] and store.opened == ["1.bin", "2.bin"] and store.listed == [f"{tmp_path}/a"]
    store.listed.clear()
    assert [r["object_key"] for r in scanned(prefix="b/c")] == ["b/c/4.bin"] and store.listed == [f"{tmp_path}/b", f"{tmp_path}/b/c"]
    assert [r["object_key"] for r in scanned(prefix="a")] == ["a/1.bin", "a/2.bin", "ab/3.bin"] and scanned(prefix="zz/") == scanned(prefix="a/9") == []
    store.opened.clear()
    assert [(r["size"], r["content"]) for r in scanned(bodies="false")] == [(1_024_000, None)] * 5 and store.opened == []
    store.read = 0
    asked = pa.RecordBatch.from_pydict({"object_key": ["a/1.bin", "a/1.bin", "a/2.bin", "a/1.bin", "gone", None, "a/2.bin"], "start": [0, 1_023_999, 300, 5, 0, 0, 1_024_000], "end": [9, 1 << 40, 303, 4, 1, 1, 1_024_001]})
    (found,) = list(listing.pieces([asked], str(tmp_path), asked.schema.names))
    assert found.column("piece").to_pylist() == [bytes(range(10)), b"\xff", bytes([44, 45, 46, 47]), None, None, None, None] and store.read == 15


def test_ranges_and_pushed_prefixes(spark, tmp_path):
    for name in ("x/1", "x/2", "y/1"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name * 3)
    wanted = spark.createDataFrame([("x/1", 0, 2, "p"), ("y/1", 4, 99, "q")], "object_key string, start long, end long, more string")
    got = {r.more: bytes(r.piece) for r in O.object_ranges(spark, str(tmp_path), wanted).collect()}
    assert got == {"p": b"x/1", "q": b"/1y/1"}
    by_spark = {r.object_key: bytes(r.content) for r in listing.spark_listing(spark, f"file://{tmp_path}", "x/").select(O.object_key(F.col("path"), str(tmp_path)).alias("object_key"), "content").collect()}
    assert by_spark == {"x/1": b"x/1" * 3, "x/2": b"x/2" * 3} and listing.spark_listing(spark, f"file://{tmp_path}", "zz") is None
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = O.scan_objects(spark, str(tmp_path)).where(F.col("object_key").startswith("x/") & (F.col("size") > 1))
        assert sorted(r.object_key for r in rows.collect()) == ["x/1", "x/2"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_catalog_keeps_every_change(spark, tmp_path):
    """Two writers from one version: the later one takes the other's change in and writes again."""
    path = str(tmp_path / "catalog")
    row = lambda i: spark.createDataFrame([(str(i), f"n{i}")], "id string, name string")
    assert C.read(spark, path).count() == 0
    assert C.change(spark, path, lambda c: O.append_catalog(c, row(1))) == 1
    raced = []

    def slow(catalog):
        if not raced:  # another writer is faster, once
            raced.append(C.change(spark, path, lambda c: O.append_catalog(c, row(2))))
        return O.append_catalog(catalog, row(3))

    assert C.change(spark, path, slow) == 3 and raced == [2]
    C.change(spark, path, lambda c: O.delete_from_catalog(c, row(1)))
    assert sorted(r.id for r in C.read(spark, path).collect()) == ["2", "3"]
    assert sorted(r.id for r in C.read(spark, path, 3).collect()) == ["1", "2", "3"]
    threads = [threading.Thread(target=C.change, args=(spark, path, lambda c, i=i: O.append_catalog(c, row(i)))) for i in range(10, 14)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r.id for r in C.read(spark, path).collect()) == ["10", "11", "12", "13", "2", "3"]
