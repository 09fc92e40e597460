"""The catalog as versions: a change writes a new one, and none is lost to another writer.

A version is a table of its own and a mark that names it. Marks are made only where there is none
yet, so of two writers that start from one version the second finds its mark taken, reads
what the first has written and makes its change again. Readers see whole versions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tidegate.sources.objects import CATALOG
from tidegate.sources.work import file_system


class Taken(Exception):
    """The catalog was changed by others as often as the change was tried."""


def versions(spark: SparkSession, path: str) -> dict[int, str]:
    """The folder of each version, by its number."""
    fs, marks = file_system(spark, f"{path.rstrip('/')}/_versions")
    if not fs.exists(marks):
        return {}
    found: dict[int, str] = {}
    for status in fs.listStatus(marks):
        name = status.getPath().getName()
        if name.isdigit():
            source = fs.open(status.getPath())
            try:
                found[int(name)] = source.readUTF()
            finally:
                source.close()
    return found


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The catalog's newest version, or another one; empty if there is none."""
    known = versions(spark, path)
    if not known:
        return spark.createDataFrame([], CATALOG)
    return spark.read.schema(CATALOG).parquet(f"{path.rstrip('/')}/{known[max(known) if version is None else version]}")


def change(spark: SparkSession, path: str, make: Callable[[DataFrame], DataFrame], tries: int = 20) -> int:
    """Write what `make` makes of the newest version as the next one; the number it got. `make` is called again if another writer was faster."""
    root = path.rstrip("/")
    for _ in range(tries):
        known = versions(spark, path)
        newest = max(known, default=0)
        before = spark.read.schema(CATALOG).parquet(f"{root}/{known[newest]}") if known else spark.createDataFrame([], CATALOG)
        names = before.columns
        folder = f"snapshot-{uuid.uuid4().hex}"
        make(before).select(*names).write.parquet(f"{root}/{folder}")
        if _claim(spark, f"{root}/_versions/{newest + 1}", folder):
            return newest + 1
        fs, at = file_system(spark, f"{root}/{folder}")
        fs.delete(at, True)
    raise Taken(path)


def _claim(spark: SparkSession, mark: str, folder: str) -> bool:
    """Make a mark that no other writer has made: it is written apart, whole, and then gets its name unless that is taken."""
    fs, target = file_system(spark, mark)
    _, draft = file_system(spark, f"{mark.rpartition('/')[0]}/.draft-{folder}")
    sink = fs.create(draft, False)
    sink.writeUTF(folder)
    sink.close()
    jvm = spark._jvm
    try:
        if fs.getUri().getScheme() == "file":
            # a link is made by one writer only, where a renaming would replace
            at = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (fs.makeQualified(target), fs.makeQualified(draft))]
            jvm.java.nio.file.Files.createLink(*at)
        else:
            rename = jvm.org.apache.hadoop.fs.Options.Rename
            how = spark.sparkContext._gateway.new_array(rename, 1)
            how[0] = rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(target), how)
            return True
    except Py4JJavaError:
        return False
    finally:
        if fs.exists(draft):
            fs.delete(draft, False)
    return True
