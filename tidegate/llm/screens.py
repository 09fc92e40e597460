"""Bloom screens: a set of long values of bounded size that tasks test rows against in place.

A screen lets rows through that are in the set, and some that are not. Behind it stands an exact
join, so it only spares the shuffle of rows that cannot meet anything. A set too large for the
bound makes it let more through, never less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


#: Bound of a screen in bits (8 MB).
MAX_BITS = 1 << 26
_SHIFTS = (0, 13, 29, 37)


def _slot(values: np.ndarray, shift: int, bits: int) -> np.ndarray:
    return ((values >> np.uint64(shift)) & np.uint64(bits - 1)).astype(np.int64)


def _filled(bits: int):
    def run(batches):
        table = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shift in _SHIFTS:
                slot = _slot(values, shift, bits)
                np.bitwise_or.at(table, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        words = table.view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(words[at])], ["place", "bits"])

    return run


def screen(values: DataFrame, count: int):
    """A broadcast screen of the one long column of `values`, sized for `count` of them; nulls must not be among them.

    The tables of all tasks are united by place before one of MAX_BITS at most reaches the driver.
    """
    bits = min(MAX_BITS, max(1 << 16, 1 << (64 * count).bit_length()))
    words = np.zeros(bits // 64, np.int64)
    found = values.mapInArrow(_filled(bits), "place int, bits long").groupBy("place").agg({"bits": "bit_or"}).toDF("place", "bits").toArrow()
    words[found.column("place").to_numpy()] = found.column("bits").to_numpy()
    return values.sparkSession.sparkContext.broadcast(words.view(np.uint8))


def passing(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the 64-bit values may be in the set."""
    bits = len(table) * 8
    ok = np.ones(len(values), bool)
    for shift in _SHIFTS:
        slot = _slot(values, shift, bits)
        ok &= (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
    return ok


def may_hold(shared, column: pa.Array) -> np.ndarray:
    """Which rows' keys may be in the set; a null is in none."""
    ok = passing(shared.value, column.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
    return ok & column.is_valid().to_numpy(zero_copy_only=False)


def screened(rows: DataFrame, shared, key: str, schema) -> DataFrame:
    """The rows whose long column `key` may be in the set; the key is left out of `schema`, which names the other columns."""

    def run(batches):
        for batch in batches:
            yield batch.drop_columns([key]).filter(pa.array(may_hold(shared, batch.column(key))))

    return rows.mapInArrow(run, schema)


__all__ = ["MAX_BITS", "may_hold", "passing", "screen", "screened"]
