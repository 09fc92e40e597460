"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over consecutive words; words at its open
positions do not enter the hash, so a substitution there goes unseen. Seeds of
the benchmark and of the training texts are joined on their hashes. Around each
hit the benchmark text is laid over the document and the words are compared: an
overlap counts if enough words agree and few were substituted.

Training seeds are screened in place by a Bloom filter of bounded size, so only
hits are shuffled. A benchmark too large for the filter makes it let more
through, never less.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import stage
from tidegate.llm.screens import passing, screen
from tidegate.llm.text_arrays import ALNUM, Words, mix, text_slices, utf8

#: Fixed masks of seven words: together they hit every overlap of 13 agreeing words with a fifth substituted.
MASKS = ("111011011", "111000010111", "11000010010111", "1101010100011", "110011001011", "1000000111111")
MIN_WORDS = 5
MIN_AGREE = 13


def least(length: int) -> int:
    """Words of an item that must agree: an item too short for 13 may miss a fifth too."""
    return min(MIN_AGREE, -(-4 * length // 5))


def seeds(digests: np.ndarray, row_ends: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of each place where `mask` fits into the row."""
    n = len(digests) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(n, len(mask), np.uint64)
    for j, sign in enumerate(mask):
        if sign == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + digests[j : j + n]
    at = np.flatnonzero(row_ends[:n] - np.arange(n) >= len(mask))
    return mix(out[at] ^ np.uint64(int(mask, 2))), at


def _benchmark_words(batches):
    for batch in text_slices(batches, "text"):
        words = Words(*utf8(batch.column("text"), lower=True), ALNUM)
        lists = pa.ListArray.from_arrays(pa.array(words.bounds.astype(np.int32)), pa.array(words.digests().view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), lists], ["item_id", "words"])


@cache
def _masks_for(length: int) -> tuple[str, ...]:
    """Masks for items of `length` words; for one too short for MASKS, a set that hits wherever enough of its words agree."""
    bent = length - least(length)
    if least(length) == MIN_AGREE:
        return MASKS
    weight = length - 1 if bent == 1 else min(7, length - 4)
    holes = np.array([sum(1 << i for i in c) for c in combinations(range(length), bent)])
    masks = [sum(1 << i for i in (0, *c)) for c in combinations(range(1, length), weight - 1)]
    fits = np.array([np.any([holes & (m << i) == 0 for i in range(length - m.bit_length() + 1)], axis=0) for m in masks])
    chosen, left = [], np.ones(len(holes), bool)
    while left.any():
        best = int(np.argmax(fits[:, left].sum(axis=1)))
        chosen.append(f"{masks[best]:b}"[::-1])
        left &= ~fits[best]
    return tuple(chosen)


def _benchmark_seeds(batches):
    for batch in batches:
        hashes, items, places = [], [], []
        for item, words in zip(batch.column("item_id").to_pylist(), batch.column("words").to_pylist()):
            digests = np.array(words, np.int64).view(np.uint64)
            if len(digests) < MIN_WORDS:
                continue
            for mask in _masks_for(len(digests)):
                h, at = seeds(digests, np.full(len(digests), len(digests)), mask)
                hashes.append(h.view(np.int64))
                items += [item] * len(h)
                places.append(at)
        if hashes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(items, batch.schema.field("item_id").type), pa.array(np.concatenate(places).astype(np.int32))], ["seed", "item_id", "place"])


def _hits(shared, masks: list[str]):
    def run(batches):
        table = shared.value
        for batch in text_slices(batches, "text"):
            words = Words(*utf8(batch.column("text"), lower=True), ALNUM)
            digests, ends = words.digests(), words.row_ends()
            found_hash, found_at = [], []
            for mask in masks:
                h, at = seeds(digests, ends, mask)
                ok = passing(table, h)
                found_hash.append(h[ok])
                found_at.append(at[ok])
            if not sum(map(len, found_at)):
                continue
            h, at = np.concatenate(found_hash), np.concatenate(found_at)
            row = np.searchsorted(words.bounds, at, "right") - 1
            order = np.argsort(row, kind="stable")
            rows, first = np.unique(row[order], return_index=True)
            edges = pa.array(np.append(first, len(order)).astype(np.int32))
            seed = pa.ListArray.from_arrays(edges, pa.array(h[order].view(np.int64)))
            place = pa.ListArray.from_arrays(edges, pa.array((at - words.bounds[row])[order].astype(np.int32)))
            text = pa.array([digests[words.bounds[r] : words.bounds[r + 1]].view(np.int64) for r in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), seed, place, text], ["doc_id", "seeds", "places", "words"])

    return run


def overlap(item: np.ndarray, words: np.ndarray, shift: int) -> int:
    """Most words that agree in a stretch of `item` laid over `words` from `shift` on that counts as an overlap; 0 if none does.

    A word that agrees counts 1 and one that differs -4, so that a stretch whose
    sum is 0 or more has a share of 0.8 or more. For each end the first start of no
    higher sum holds the most words.
    """
    lo, hi = max(0, -shift), min(len(item), len(words) - shift)
    if hi <= lo:
        return 0
    same = item[lo:hi] == words[lo + shift : hi + shift]
    agree = np.concatenate([[0], np.cumsum(same)])
    sums = 5 * agree - 4 * np.arange(len(agree))
    start = np.searchsorted(-np.minimum.accumulate(sums), -sums)
    most = int((agree - agree[start]).max())
    return most if most >= least(len(item)) else 0


def _overlaps(batches):
    for batch in batches:
        out = []
        columns = [batch.column(c) for c in ("item_words", "words", "shifts")]
        for i in range(batch.num_rows):
            item, words, shifts = (c[i].values.to_numpy() for c in columns)
            out.append(max(overlap(item, words, shift) for shift in shifts.tolist()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item_id"), pa.array(out, pa.int32())], ["doc_id", "item_id", "agree"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words): documents with the benchmark items they overlap and how many words agree at most.

    Words are lower-cased runs of letters and digits. An overlap needs 13 agreeing
    words (four fifths of an item of under 16) and at most a fifth substituted. Items of under
    five words and null texts match nothing; rows with a null doc_id are left out,
    rows that repeat a doc_id or item_id are judged together. An empty side gives
    an empty result. Other columns are left aside.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    doc_kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    items = stage(benchmark.where("item_id is not null and text is not null").select("item_id", "text").mapInArrow(_benchmark_words, f"item_id {item_kind}, words array<long>"), "items")
    wanted = stage(items.mapInArrow(_benchmark_seeds, f"seed long, item_id {item_kind}, place int").distinct(), "seeds")
    lengths = [r[0] for r in items.where(F.size("words").between(MIN_WORDS, 15)).select(F.size("words")).distinct().collect()]
    masks = sorted({*MASKS, *(m for n in lengths for m in _masks_for(n))})
    shared = screen(wanted.select("seed"), wanted.count())

    hits = stage(docs.mapInArrow(_hits(shared, masks), f"doc_id {doc_kind}, seeds array<long>, places array<int>, words array<long>"), "hits")
    placed = (
        hits.select("doc_id", F.explode(F.arrays_zip("seeds", "places")).alias("hit"))
        .select("doc_id", F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("at"))
        .join(wanted, "seed")
        .groupBy("doc_id", "item_id")
        .agg(F.collect_set(F.col("at") - F.col("place")).alias("shifts"))
    )
    checked = (
        placed.join(hits.select("doc_id", "words"), "doc_id")
        .join(items.withColumnRenamed("words", "item_words"), "item_id")
        .select("doc_id", "item_id", "item_words", "words", "shifts")
        .mapInArrow(_overlaps, f"doc_id {doc_kind}, item_id {item_kind}, agree int")
    )
    return checked.where("agree > 0").groupBy("doc_id", "item_id").agg(F.max("agree").cast("long").alias("n_words"))
