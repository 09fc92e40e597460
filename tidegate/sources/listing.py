"""A data source of objects in a store: what it lists and reads is what a query asks for.

`spark.read.format("objects")` takes `path`, and options `prefix` (keys that start with
it are listed, nothing else), `bodies` (false: no object is opened) and `filters` (true: a filter on the start of
`object_key` is pushed into the listing; `read_objects` sets it where `spark.sql.python.filterPushdown.enabled` holds). Stores are those that Arrow opens by their
address; others are read by Spark's own binary files, whose listing takes the prefix as well.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, StringStartsWith

SCHEMA = "object_key string, size long, last_modified timestamp, content binary"
#: Bytes of objects a task reads, and how many it opens, at most (one at least).
TASK_BYTES, TASK_OBJECTS = 64 << 20, 2000
#: Bytes of bodies handed on at once.
_BATCH = 8 << 20


def opened(path: str):
    """(store, folder) of an address, or None if Arrow has no such store."""
    try:
        return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path.rstrip("/") or "/")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


def listed(path: str, prefix: str = ""):
    """(key, size, time) of each object whose key starts with `prefix`, in order of key; only the folder that holds them is listed."""
    store, root = opened(path)
    root = root.rstrip("/")
    folder, _, stem = prefix.rpartition("/")
    base = f"{root}/{folder}" if folder else root
    cut = len(root) + 1
    found = []
    for info in store.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        if not info.base_name.startswith(stem):
            continue  # neither it nor anything below it has the prefix
        inside = store.get_file_info(pafs.FileSelector(info.path, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        found += [(i.path[cut:], i.size, i.mtime) for i in inside if i.type == pafs.FileType.File]
    return sorted(found)


@dataclass
class _Objects(InputPartition):
    objects: list

    def __init__(self, objects):
        super().__init__(objects)
        self.objects = objects


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.prefix = options["path"], options.get("prefix", "")
        self.bodies = options.get("bodies", "true").lower() != "false"

    def partitions(self):
        parts, size = [[]], 0
        for found in listed(self.path, self.prefix):
            cost = found[1] if self.bodies else 0
            if parts[-1] and (size + cost > TASK_BYTES or len(parts[-1]) == TASK_OBJECTS):
                parts.append([])
                size = 0
            parts[-1].append(found)
            size += cost
        return [_Objects(p) for p in parts]

    def read(self, partition):
        store, root = opened(self.path)
        rows, held = [], 0
        for key, size, time in partition.objects:
            body = None
            if self.bodies:
                with store.open_input_file(f"{root.rstrip('/')}/{key}") as f:
                    body = f.read()
            rows.append((key, size, time, body))
            held += len(body or b"")
            if held > _BATCH:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows):
        kinds = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["object_key", "size", "last_modified", "content"])


class _FilteredReader(_Reader):
    """A reader that Spark hands filters to."""

    def pushFilters(self, filters):
        for f in filters:
            # a longer prefix lists less; any other is left to Spark
            if isinstance(f, StringStartsWith) and f.attribute == ("object_key",) and f.value.startswith(self.prefix):
                self.prefix = f.value
            else:
                yield f


class ObjectSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (_FilteredReader if self.options.get("filters") == "true" else _Reader)(self.options)


def read_objects(spark: SparkSession, path: str, prefix: str = "", bodies: bool = True) -> DataFrame:
    """The objects under a path of a store that Arrow opens, through the data source."""
    spark.dataSource.register(ObjectSource)
    options = {"path": path, "prefix": prefix, "bodies": str(bodies).lower(), "filters": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")}
    return spark.read.format("objects").options(**options).load()


def read_ranges(wanted: DataFrame, path: str) -> DataFrame:
    """`wanted` (object_key, start, end and others) with `piece`: bytes start to end of the object, both counted, read by seeking to them.

    The end is cut to the object's; null if the range starts beyond it, ends before it starts, or any of the three is null
    or no such object is there. One object's ranges may lie in many tasks; a task opens an object once for those that follow each other.
    """
    columns = wanted.columns
    schema = ", ".join([*(f"`{n}` {t}" for n, t in wanted.dtypes), "piece binary"])
    return wanted.mapInArrow(lambda batches: pieces(batches, path, columns), schema)


def pieces(batches, path: str, columns: list[str]):
    """The batches with the bytes their rows ask for."""
    store, root = opened(path)
    name = source = None
    for batch in batches:
        found, held, first = [], 0, 0
        for i, (key, start, end) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("object_key", "start", "end")))):
            piece = None
            if key is not None and start is not None and end is not None and 0 <= start <= end:
                if key != name:
                    if source:
                        source.close()
                    name = key
                    try:
                        source = store.open_input_file(f"{root.rstrip('/')}/{key}")
                    except FileNotFoundError:
                        source = None
                if source and start < source.size():
                    source.seek(start)
                    piece = source.read(min(end + 1, source.size()) - start)
            found.append(piece)
            held += len(piece or b"")
            if held > _BATCH or i + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(found)) for c in columns), pa.array(found, pa.binary())], [*columns, "piece"])
                found, held, first = [], 0, i + 1
    if source:
        source.close()


def spark_listing(spark: SparkSession, path: str, prefix: str) -> DataFrame | None:
    """The objects by Spark's own reader, for stores that only it opens; the prefix becomes part of the path that it lists."""
    target = path.rstrip("/") + "/" + "".join(f"\\{c}" if c in "\\*?[]{}" else c for c in prefix)
    target += "" if target.endswith("/") else "*"
    where = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where):
        return None
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(target)


def no_objects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


__all__ = ["ObjectSource", "listed", "no_objects", "opened", "read_objects", "read_ranges", "spark_listing"]
