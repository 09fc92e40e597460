"""Places and running totals in groups of any size: sorted pieces are folded on their own, then joined up.

A window would read a whole group in one task. Here the table is sorted across all tasks by
group and order; each sorted piece counts and sums by itself, and the groups that cross the
border of a piece, two for each piece at most, get the totals of the pieces before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegate.llm.common import stage


def _folded(group: str, sums: list[str], names: list[str]):
    def run(batches):
        last, count, totals = None, 0, {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(group)
            opens = np.ones(n, bool)
            opens[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            opens[0] = last is None or keys[0].as_py() != last
            start = np.maximum.accumulate(np.where(opens, np.arange(n), -1))
            goes_on = start < 0
            out = {c: batch.column(c) for c in batch.schema.names}
            place = np.arange(n) - start
            place[goes_on] = count + np.arange(int(goes_on.sum()))
            out["place"] = pa.array(place.astype(np.int64))
            for c in sums:
                values = batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                run_up = np.cumsum(values)
                outside = np.full(n, -totals.get(c, np.int64(0)), np.int64)
                outside[~goes_on] = (run_up - values)[start[~goes_on]]
                run_up = run_up - outside
                totals[c] = run_up[-1]
                out[c], out[f"{c}_before"] = pa.array(run_up), pa.array(run_up - values)
            last, count = keys[-1].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([out[c] for c in names], names)

    return run


def _joined_up(group: str, sums: list[str], offsets, names: list[str]):
    def run(batches):
        known = offsets.value
        for batch in batches:
            out = {c: batch.column(c) for c in names}
            pieces = batch.column("piece").to_numpy(zero_copy_only=False)
            # a batch of a file read back may hold several pieces; within one, only the first group goes on from before
            for piece in np.unique(pieces).tolist():
                if piece not in known:
                    continue
                key, place, *totals = known[piece]
                hit = (pieces == piece) & pc.equal(batch.column(group), pa.scalar(key, batch.column(group).type)).to_numpy(zero_copy_only=False)
                for c, more in zip(("place", *sums, *(f"{c}_before" for c in sums)), (place, *totals, *totals)):
                    out[c] = pa.array(out[c].to_numpy(zero_copy_only=False) + np.where(hit, np.int64(more), np.int64(0)))
            yield pa.RecordBatch.from_arrays([out[c] for c in names], names)

    return run


def _wrapped(n: int) -> int:
    return (n + (1 << 63)) % (1 << 64) - (1 << 63)


def running(rows: DataFrame, group: str, order: list[str | Column], sums: list[str] = (), keep: list[str | Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(`rows`, or what `keep` selects of them once they are in order, with `place`; the staged table behind it, to be deleted when done).

    `place` counts from 0 in each group in the given order; each long column c of
    `sums` becomes its running total up to and with the row, modulo 2**64, and
    `c_before` is the total without the row. `group` and `sums` must hold no nulls.
    Equal rows may come in any order.
    """
    sums = list(sums)
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = dealt.select(*(keep or rows.columns), F.spark_partition_id().alias("piece"))
    kept = StructType([*dealt.schema.fields, *StructType.fromDDL(", ".join(["place long", *(f"{c}_before long" for c in sums)])).fields])
    pieces = stage(dealt.mapInArrow(_folded(group, sums, kept.names), kept), "pieces")
    last = [F.max("place").alias("place"), *[F.max_by(c, "place").alias(c) for c in sums]]
    ends = pieces.groupBy(group, "piece").agg(*last).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("piece", "place", *sums))).alias("ends"))
    offsets = {}
    for key, found in ends.where(F.size("ends") > 1).collect():  # two entries a piece at most
        before = [0] * (1 + len(sums))
        for end in found:
            if any(before):
                offsets[end["piece"]] = (key, *before)
            before = [before[0] + end["place"] + 1, *[_wrapped(b + end[c]) for b, c in zip(before[1:], sums)]]
    schema = StructType([f for f in kept.fields if f.name != "piece"])
    return pieces.mapInArrow(_joined_up(group, sums, spark.sparkContext.broadcast(offsets), schema.names), schema), pieces
