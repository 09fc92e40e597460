"""Toxicity severity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(threshold[k] - w . x): all thresholds share one weight
vector over hashed words, so grades stay in order. The expected grade is the
severity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.text_arrays import ALNUM, Words, text_slices, utf8

BITS = 18
#: Bound of the labelled rows the weights are fitted on, those of least hash.
SAMPLE = 12_000
#: Words get a weight if so many rows of the sample hold them, and if harmful
#: rows do so more or less often than by chance, in standard deviations.
RARE, SURPRISE = 3, 4.0
STEPS, RATE, PULL = 150, 0.1, 1e-3


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, word slot), each once: which hashed words a text holds."""
    words = Words(*utf8(column, lower=True), ALNUM)
    slot = words.digests() >> np.uint64(64 - BITS)
    row = np.repeat(np.arange(len(column), dtype=np.uint64), words.counts)
    key = (row << np.uint64(BITS)) | slot
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def chances(score: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Rows x grades: the chance of each grade."""
    below = sigmoid(cuts[None, :] - score[:, None])
    edge = np.ones((len(score), 1))
    return np.clip(np.diff(np.concatenate([0 * edge, below, edge], 1), axis=1), 1e-9, 1)


def fit(row: np.ndarray, slot: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of highest penalised likelihood, by Adam on all rows."""
    n_rows, grades = len(grade), int(grade.max()) + 1
    seen = np.bincount(slot, minlength=1 << BITS)
    harmful = np.bincount(slot, grade[row] > 0, minlength=1 << BITS)
    rate = (grade > 0).mean()
    surprise = np.abs(harmful - seen * rate) / np.sqrt(np.maximum(seen, 1) * rate * (1 - rate))
    kept = np.flatnonzero((seen >= RARE) & (surprise >= SURPRISE))
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))
    ok = place[slot] >= 0
    row, col = row[ok], place[slot[ok]]
    share = np.cumsum(np.bincount(grade, minlength=grades))[:-1] / n_rows
    first = np.log(share / (1 - share))
    steps = np.log(np.maximum(np.diff(first), 1e-2))  # later thresholds lie above earlier ones
    x = np.concatenate([np.zeros(len(kept)), first[:1], steps])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, STEPS + 1):
        w, a, d = x[: len(kept)], x[len(kept)], np.exp(x[len(kept) + 1 :])
        cuts = a + np.concatenate([[0], np.cumsum(d)])
        score = np.bincount(row, w[col], n_rows)
        below = sigmoid(cuts[None, :] - score[:, None])
        p = chances(score, cuts)[np.arange(n_rows), grade]
        slope = below * (1 - below)
        up = np.where(grade < grades - 1, slope[np.arange(n_rows), np.minimum(grade, grades - 2)], 0) / p
        down = np.where(grade > 0, slope[np.arange(n_rows), np.maximum(grade - 1, 0)], 0) / p
        g_score = up - down  # of the negative log likelihood
        g_cuts = np.array([down[grade == k + 1].sum() - up[grade == k].sum() for k in range(grades - 1)])
        tail = np.cumsum(g_cuts[::-1])[::-1]
        g = np.concatenate([np.bincount(col, g_score[row], len(kept)) / n_rows + PULL * w, tail[:1] / n_rows, tail[1:] * d / n_rows])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = x[: len(kept)]
    return weights, x[len(kept)] + np.concatenate([[0], np.cumsum(np.exp(x[len(kept) + 1 :]))])


def train(docs: DataFrame, labels: DataFrame, grade: Column):
    """(weights, thresholds, limit of the score) from the labelled documents; None without two grades.

    Uses at most SAMPLE labelled rows. `grade` is a column of `labels`, 0 for
    harmless; rows where it is null teach nothing.
    """
    chosen = labels.select("doc_id", grade.cast("int").alias("grade")).where("doc_id is not null and grade >= 0").orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(SAMPLE)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in text_slices(batches, "text"):
            row, slot = features(batch.column("text"))
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.ListArray.from_arrays(pa.array(edges), pa.array(slot.astype(np.int32)))], ["doc_id", "grade", "slots"])

    table = rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, grade int, slots array<int>").toArrow()
    if not table.num_rows:
        return None
    table = table.sort_by("doc_id")
    known, grades = np.unique(table.column("grade").to_numpy(), return_inverse=True)
    if len(known) < 2:
        return None
    lists = table.column("slots").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    row, slot = np.repeat(np.arange(len(sizes)), sizes), lists.values.to_numpy().astype(np.int64)
    weights, cuts = fit(row, slot, grades)
    return weights, cuts, limit(1 - chances(np.bincount(row, weights[slot], len(sizes)), cuts)[:, 0], grades > 0)


def limit(score: np.ndarray, harmful: np.ndarray) -> float:
    """The score from which a row counts as harmful: halfway into the gap where the shares of rows judged right, harmful and harmless, add up to most.

    The weights are pulled towards 0, so the chances are too low to be held against one half.
    """
    order = np.argsort(-score, kind="stable")
    score, harmful = score[order], harmful[order]
    right = np.cumsum(harmful) / harmful.sum() - np.cumsum(~harmful) / (~harmful).sum()
    right[:-1][score[:-1] == score[1:]] = -1  # no limit parts equal scores
    best = int(np.argmax(right))
    return float((score[best] + score[min(best + 1, len(score) - 1)]) / 2)


def severity(docs: DataFrame, trained) -> DataFrame:
    """(doc_id, severity, grade, toxic, score): expected grade, likeliest grade, and the chance of any grade above 0.

    `toxic` is a chance at or above the limit that parts the labelled rows best. A null or empty text holds no word
    and gets the chances of the thresholds alone; without a model all is 0. Each
    row is judged by itself. Other columns are left aside.
    """
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(trained)

    def run(batches):
        for batch in text_slices(batches, "text"):
            size = batch.num_rows
            p, least = np.zeros((size, 1)), np.inf
            p[:, 0] = 1
            if shared.value:
                weights, cuts, least = shared.value
                row, slot = features(batch.column("text"))
                p = chances(np.bincount(row, weights[slot], size), cuts)
            score = 1 - p[:, 0]
            out = [batch.column("doc_id"), pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(1).astype(np.int32)), pa.array(score >= least), pa.array(score)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "severity", "grade", "toxic", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, severity double, grade int, toxic boolean, score double")
