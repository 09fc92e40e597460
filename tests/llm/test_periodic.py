"""Runs of repeated periods: against plain comparison at every distance."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidegate.llm import periodic_runs, queries


def plain_runs(words, least=6, times=4):
    """Every maximal stretch where words q apart agree, for every q that may fit."""
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes, out = np.array([known[w] for w in words], np.int64), []
    for q in range(1, len(codes) // times + 1):
        turns = np.flatnonzero(np.diff(np.concatenate([[0], codes[q:] == codes[:-q], [0]])))
        for first, end in zip(turns[::2].tolist(), turns[1::2].tolist()):
            own = codes[first : end + q]
            if len(own) >= max(least, times * q) and not any((own[d:] == own[:-d]).all() for d in range(1, q)):
                out.append((first, len(own), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def found_runs(words, least, times):
    codes = np.array(words, np.uint64) * np.uint64(7919) + np.uint64(1)
    spans = periodic_runs.stretches(codes, np.array([0, len(words)]), least, times)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    found = {r for lo, hi in spans for r in periodic_runs.runs_within(codes, lo, hi, least, times)}
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,times", [(6, 4), (1, 2), (4, 3), (6, 2)])
def test_runs_match_plain_comparison(least, times):
    rng = random.Random(least * 10 + times)
    for _ in range(400):
        n, k = rng.randint(0, 60), rng.choice([1, 2, 3, 5])
        words = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert found_runs(words, least, times) == plain_runs(words, least, times)


def test_access_gives_the_last_occurrence_of_every_suffix():
    rng = random.Random(5)
    for _ in range(60):
        words = [rng.randrange(2) for _ in range(rng.randint(1, 40))]
        link, longest, ends = periodic_runs.automaton(words)
        paths = periodic_runs.Paths(link)
        for i, state in enumerate(ends):
            found, got = paths.access(state, i), {}
            for k, (node, place) in enumerate(found):
                shorter = longest[found[k + 1][0]] if k + 1 < len(found) else 0
                got |= {n: place for n in range(shorter + 1, longest[node] + 1)}
            for n in range(1, i + 2):
                suffix = words[i - n + 1 : i + 1]
                before = [j for j in range(n - 1, i) if words[j - n + 1 : j + 1] == suffix]
                assert got[n] == (before[-1] if before else -1)


def test_a_text_of_one_word_and_fibonacci_words():
    assert found_runs([1] * 5000, 6, 4) == [(0, 5000, 1)]
    a, b = [0], [0, 1]
    while len(b) < 200:
        a, b = b, b + a
    assert found_runs(b, 2, 2) == plain_runs(b, 2, 2)


def test_edges(spark, frame, edges):
    rows = periodic_runs.periodic_runs(edges).collect()
    assert len(rows) == edges.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_words == 0 and by_id[1].runs == [] and by_id[1].collapsed_text == ""
    assert by_id[3].n_words == 0 and by_id[None].n_words == 3
    # the long text repeats 977 words thirty times
    assert [(r.start, r.length, r.period) for r in by_id[7].runs] == [(0, 30_000, 977)]
    assert by_id[7].n_dropped == 30_000 - 977 and len(by_id[7].collapsed_text.split()) == 977
    assert periodic_runs.periodic_runs(edges.limit(0)).count() == 0
    again = frame([(1, "a b a b a b a b"), (1, "a b a b a b a b"), (2, "x x x x x"), (3, "x x " * 6)])
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.periodic_runs(again).collect()}
    assert got == {1: [(0, 8, 2)], 2: [], 3: [(0, 6, 1)]}


def test_best_run_compares_exactly(spark):
    rows = spark.sql("select array(named_struct('start', 3L, 'length', 13L, 'period', 3L), named_struct('start', 5L, 'length', 9L, 'period', 2L), named_struct('start', 9L, 'length', 18L, 'period', 4L)) runs")
    assert tuple(rows.select(periodic_runs.best_run(rows.runs).alias("b")).first().b) == (5, 9, 2)


def test_query_matches_plain_python(spark, data):
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(docs) == len(got)
    for doc in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", doc.text or "")
        h, n = zlib.crc32(str(doc.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs, row = plain_runs(words), got[doc.doc_id]
        assert row.n_runs == len(runs) and row.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
        assert (row.start, row.length, row.period) == best
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
