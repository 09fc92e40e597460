"""Tables written batch by batch, each batch once: a batch that is written again replaces itself, and shows only as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegate.sources.work import file_system


def _folder(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/batch={number:012d}"


def publish(number: int, tables: dict[str, DataFrame], ledger: str | None = None) -> None:
    """Write batch `number` of several tables, each to a folder of its own that a second writing replaces.

    A folder counts once Spark has marked it as written; with a `ledger`, the batch shows in none of the
    tables before all are written, as a mark in the ledger is made last.
    """
    for path, rows in tables.items():
        rows.write.mode("overwrite").parquet(_folder(path, number))
    if ledger:
        fs, at = file_system(next(iter(tables.values())).sparkSession, f"{ledger.rstrip('/')}/{number:012d}")
        fs.create(at, True).close()


def batches(spark: SparkSession, path: str, ledger: str | None = None) -> list[str]:
    """The folders of batches that were written to their end, in order."""
    fs, root = file_system(spark, path)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    found = sorted(n for n in names if n.startswith("batch=") and fs.exists(root.suffix(f"/{n}/_SUCCESS")))
    if ledger:
        fs, marks = file_system(spark, ledger)
        done = {s.getPath().getName() for s in fs.listStatus(marks)} if fs.exists(marks) else set()
        found = [n for n in found if n.removeprefix("batch=") in done]
    return [f"{path.rstrip('/')}/{n}" for n in found]


def published(spark: SparkSession, path: str, schema: str, ledger: str | None = None) -> DataFrame:
    """All rows that were published to a table; none if there is no batch yet."""
    folders = batches(spark, path, ledger)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
