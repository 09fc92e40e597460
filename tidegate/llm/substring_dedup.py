"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of every `min_words` consecutive words the smallest
digest of `ANCHOR` consecutive words. Equal passages of `min_words` words have
equal anchors, so only anchors that occur twice can lie in a repeat. Documents
are joined on those anchors. Each seed is extended both ways, as far as it is the
anchor, to passages of `min_words` words; a passage meets its first occurrence,
found by a grouped minimum over two 64-bit digests made apart from each other.
Passages that are no first occurrence and touch or overlap merge to maximal
repeats, whose words are removed.

Extending the occurrences of an anchor pair by pair would make all pairs of a hot
one. Meeting the first occurrence of each passage finds the same words: a group
is only ever counted or reduced to its minimum, both before the shuffle, and is
never gathered.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegate.llm.common import stage, unstage
from tidegate.llm.screens import may_hold, screen, screened
from tidegate.llm.text_arrays import NOT_SPACE, Words, rolling, sliding, text_slices, utf8

ANCHOR = 8


def _passages(words: Words, min_words: int):
    """For each word: does a passage start there, and its anchor (0 where none starts); the anchor-size digests."""
    n, anchor = len(words), min(ANCHOR, min_words)
    digests = words.digests()
    if n < min_words:
        return digests, np.zeros(n, bool), np.zeros(n, np.uint64), np.zeros(0, np.uint64)
    grams = rolling(digests, anchor)
    grams[grams == 0] = 1
    starts = np.zeros(n, bool)
    starts[: n - min_words + 1] = words.row_ends()[: n - min_words + 1] - np.arange(n - min_words + 1) >= min_words
    low = np.zeros(n, np.uint64)
    least = sliding(grams, min_words - anchor + 1, np.minimum)
    low[: len(least)] = least
    low[~starts] = 0
    return digests, starts, low, grams


def _anchors(min_words: int):
    def run(batches):
        for batch in text_slices(batches, "text"):
            words = Words(*utf8(batch.column("text")), NOT_SPACE)
            _, _, low, grams = _passages(words, min_words)
            width = min_words - min(ANCHOR, min_words) + 1
            if not len(grams):
                continue
            # a gram is an anchor if it is the least of a passage around it
            highest = sliding(np.concatenate([np.zeros(width - 1, np.uint64), low]), width, np.maximum)
            picked = np.flatnonzero(highest[: len(grams)] == grams)
            row = np.searchsorted(words.bounds, picked, "right") - 1
            ids = [batch.column(c).take(pa.array(row)) for c in ("doc_id", "part")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(grams[picked].view(np.int64))], ["doc_id", "part", "anchor"])

    return run


def _listed(column: pa.Array) -> np.ndarray:
    return np.unique(column.flatten().to_numpy(zero_copy_only=False)).astype(np.int64)


def _candidates(batch, min_words: int):
    words = Words(*utf8(batch.column("text")), NOT_SPACE)
    digests, starts, low, _ = _passages(words, min_words)
    seeds = _listed(batch.column("seeds"))
    at = np.flatnonzero(starts & np.isin(low.view(np.int64), seeds))
    return words, digests, at


def _marks(passages: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A long of a passage's digest and start in its document."""
    return passages.view(np.int64) ^ (starts.astype(np.int64) << 32)


def _extended(min_words: int):
    def run(batches):
        for batch in text_slices(batches, "text"):
            words, digests, at = _candidates(batch, min_words)
            if not len(at):
                continue
            row = np.searchsorted(words.bounds, at, "right") - 1
            out = [
                pa.array(rolling(digests, min_words)[at].view(np.int64)),
                pa.array(rolling(words.digests(second=True), min_words, second=True)[at].view(np.int64)),
                batch.column("doc_id").take(pa.array(row)),
                pa.array((at - words.bounds[row]).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(out, ["h1", "h2", "doc_id", "start"])

    return run


def _repeats(batch, min_words: int) -> dict[int, np.ndarray]:
    """For each row that has some: the starts of its passages that are no first occurrence."""
    out: dict[int, np.ndarray] = {}
    rows = np.flatnonzero(batch.column("seeds").is_valid().to_numpy(zero_copy_only=False))
    if not len(rows):
        return out
    part = batch.take(pa.array(rows))
    words, digests, at = _candidates(part, min_words)
    if not len(at):
        return out
    firsts = part.column("firsts")
    passages = rolling(digests, min_words)[at]
    where = np.searchsorted(words.bounds, at, "right") - 1
    edges = np.searchsorted(where, np.arange(len(rows) + 1))
    for i, r in enumerate(rows):
        lo, hi = edges[i : i + 2]
        own = at[lo:hi] - words.bounds[i]
        if len(own) and firsts[i].is_valid:
            own = own[~np.isin(_marks(passages[lo:hi], own), firsts[i].values.to_numpy(zero_copy_only=False))]
        if len(own):
            out[r] = own
    return out


def _stripped(min_words: int, carry: list[str], names: list[str]):
    def run(batches):
        for batch in text_slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            copies = batch.column("is_copy").to_pylist()
            found = _repeats(batch, min_words)
            counts, removed, kept, spans = [], [], [], []
            for r, text in enumerate(texts):
                own = text.encode().split() if text else []
                counts.append(len(own))
                edge = np.zeros(len(own) + 1, np.int32)
                if copies[r] and len(own) >= min_words:
                    edge[0], edge[-1] = 1, -1
                elif r in found:
                    edge[found[r]] += 1
                    np.subtract.at(edge, found[r] + min_words, 1)
                stays = np.cumsum(edge)[:-1] == 0
                n = len(own) - int(stays.sum())
                removed.append(n)
                kept.append(b" ".join(compress(own, stays.tolist()) if n else own).decode())
                turns = np.flatnonzero(np.diff(np.concatenate([[True], stays, [True]]))) if n else np.zeros(0, np.int64)
                spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(turns[::2], turns[1::2])])
            out = [batch.column(c) for c in carry] + [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def remove_repeats(docs: DataFrame, min_words: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every document with its words and what is left after repeats are removed.

    Takes `doc_id` and `text`; words are runs of other than ASCII white space.
    Returns doc_id, the `carry` columns, n_words, n_removed, kept_text (kept
    words joined by one space) and repeats: (start, length) in words of each
    maximal repeat that was removed. A word goes if a passage of `min_words` words
    over it also starts earlier: in a smaller doc_id, or before in the document.

    Null and empty texts have no words. Rows with a null doc_id are counted but
    neither lose words nor make others lose any. Rows that repeat a doc_id are one
    document: a passage loses to one that starts before it in any of them, and
    those that start at the same word tie and stay. Other columns are left aside.
    """
    carry = ["doc_id", *(c for c in carry if c not in ("doc_id", "n_words", "n_removed", "kept_text", "repeats"))]
    others = [c for c in carry if c not in ("doc_id", "text")]
    # in one column, so that no name meets those used here
    carried = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(True)
    docs = docs.select("doc_id", "text", carried.alias("carried"))
    kind = dict(docs.dtypes)["doc_id"]
    # part tells the texts of a repeated doc_id apart
    parted = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("part"))
    # read and hashed twice rather than kept: that costs less than the disk it would take
    anchors = parted.mapInArrow(_anchors(min_words), f"doc_id {kind}, part long, anchor long")
    # tables of their own, so that the joins below can split a hot anchor or text
    twice = stage(anchors.groupBy("anchor").count().where("count > 1").select("anchor"), "twice")
    digests = parted.select("doc_id", "part", F.unhex(F.md5("text")).alias("digest"))
    shared = stage(digests.groupBy("digest").agg(F.min("doc_id").alias("original"), F.count("*").alias("n")).where("n > 1").select("digest", "original"), "shared")
    copies = digests.join(shared, "digest").where("doc_id > original").select("doc_id", "part").distinct().withColumn("is_copy", F.lit(True))
    listed = anchors.join(twice, "anchor", "left_semi").groupBy("doc_id", "part").agg(F.collect_set("anchor").alias("seeds")).join(copies, ["doc_id", "part"], "left")
    seeds = stage(listed.select("doc_id", "part", F.when(F.col("is_copy"), F.array().cast("array<bigint>")).otherwise(F.col("seeds")).alias("seeds"), F.coalesce("is_copy", F.lit(False)).alias("is_copy")), "seeds")
    unstage(twice, shared)

    key = F.xxhash64("doc_id", "part")
    own = seeds.where("not is_copy")
    inside = screened(parted.withColumn("key", key), screen(own.select(key.alias("key")), own.count()), "key", parted.schema)
    firsts = (
        inside.join(own.select("doc_id", "part", "seeds"), ["doc_id", "part"])
        .mapInArrow(_extended(min_words), f"h1 long, h2 long, doc_id {kind}, start int")
        .groupBy("h1", "h2")
        .agg(F.min(F.struct("doc_id", "start")).alias("first"))
        .groupBy(F.col("first.doc_id").alias("doc_id"))
        .agg(F.collect_list(F.col("h1").bitwiseXOR(F.shiftleft(F.col("first.start").cast("long"), 32))).alias("firsts"))
    )
    known = stage(seeds.join(firsts, "doc_id", "left"), "known")
    unstage(seeds)

    # documents without a seed keep all their words and need not be moved
    rows = docs.withColumns({"part": F.xxhash64("text"), "is_copy": F.lit(False)})
    rows = rows.withColumn("key", F.when(F.col("doc_id").isNotNull() & F.col("text").isNotNull(), key))
    shared_screen = screen(known.select(key.alias("key")), known.count())
    schema = StructType([*docs.schema.fields, *StructType.fromDDL("n_words long, n_removed long, kept_text string, repeats array<struct<start:int,length:int>>").fields])
    stripped = _stripped(min_words, docs.columns, schema.names)

    def untouched(batches):
        """What has no seed, in one worker: no rows, masks or lists of it travel on."""
        none = pa.array([None], pa.list_(pa.int64()))
        for batch in batches:
            batch = batch.filter(pa.array(~may_hold(shared_screen, batch.column("key"))))
            empty = none.take(pa.array(np.zeros(batch.num_rows, np.int64)))
            yield batch.append_column("seeds", empty).append_column("firsts", empty)

    apart = rows.mapInArrow(lambda batches: stripped(untouched(batches)), schema)
    met = screened(rows, shared_screen, "key", rows.drop("key").schema).drop("is_copy").join(known, ["doc_id", "part"], "left")
    met = met.select(*docs.columns, "is_copy", "seeds", "firsts").mapInArrow(stripped, schema)
    place = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col("carried").getField(c).alias(c) for c in others}
    return met.unionAll(apart).select(*[place[c] for c in carry], "n_words", "n_removed", "kept_text", "repeats")
