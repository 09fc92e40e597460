"""Substring dedup, BPE, license scan and fingerprints against plain versions."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegate.llm import bpe, decontamination, fingerprints, license_scan, near_dedup, queries, substring_dedup

from .conftest import EDGES, LONG

WORD = r"[^\x20\x09-\x0D]+"


def plain_repeats(rows, k=20):
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = re.findall(WORD, text or "")
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            if key in seen:
                gone[s : s + k] = [True] * k
            seen.add(key)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def words(seed, n, kinds=400):
    rng = np.random.default_rng(seed)
    return [f"t{x}" for x in rng.integers(0, kinds, n)]


def test_substring_dedup(frame):
    shared, tail = words(1, 60), words(2, 25)
    rows = [
        (1, " ".join(words(3, 50) + shared + words(4, 30))),
        (2, "\n".join(words(5, 10) + shared[:40] + words(6, 10) + tail)),
        (3, "  ".join(tail + words(7, 5) + tail + shared[10:])),
        (4, " ".join(["la"] * 70)),
        (5, " ".join(shared[:19])),
        (6, " ".join(words(3, 50) + shared + words(4, 30))),
        (7, "ab ba " * 15),
        (8, None),
        (9, ""),
    ]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(frame(rows)).collect()}
    assert got == plain_repeats(rows)


def test_substring_dedup_edges(edges, frame):
    got = substring_dedup.remove_repeats(edges).collect()
    assert len(got) == len(EDGES)
    by = {r.doc_id: r for r in got}
    assert (by[1].n_words, by[2].n_words, by[3].n_words, by[None].n_words) == (0, 0, 0, 3)
    assert by[8].n_words == 1  # only ASCII white space parts words
    assert by[7].n_removed == plain_repeats([(7, LONG)])[7][1] > 0
    assert substring_dedup.remove_repeats(frame([])).count() == 0


def test_substring_dedup_of_a_table(spark, data):
    """The registered query over a whole table against plain Python, and the maximal repeats it found."""
    big = data.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    want = plain_repeats([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op7_substring_dedup(spark, big).collect()}
    assert got == {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, (n, gone, kept) in want.items()}
    for r in substring_dedup.remove_repeats(docs).where("n_removed > 0").collect():
        assert sum(x.length for x in r.repeats) == r.n_removed and all(x.length >= 20 for x in r.repeats)


def test_substring_dedup_repeated_ids(frame):
    """Each text of a repeated id is judged for itself; columns of clashing names are carried."""
    u, v, w = words(11, 30), words(12, 30), words(13, 30)
    rows = [(1, " ".join(u)), (6, " ".join(u)), (6, " ".join(v)), (6, " ".join(w)), (7, " ".join(v + w)), (6, " ".join(["x", *w]))]
    docs = frame(rows).withColumns({c: F.lit(c) for c in ("part", "key", "is_copy", "firsts")})
    got = substring_dedup.remove_repeats(docs, carry=("text", "part", "key", "seeds", "is_copy", "firsts"))
    assert got.columns == ["doc_id", "text", "part", "key", "seeds", "is_copy", "firsts", "n_words", "n_removed", "kept_text", "repeats"]
    by = {r.text: r.n_removed for r in got.collect() if r.doc_id != 1}
    assert by == {" ".join(u): 30, " ".join(v): 0, " ".join(w): 0, " ".join(v + w): 60, " ".join(["x", *w]): 30}
    assert {(r.part, r.seeds, r.key) for r in got.collect()} == {("part", "clash", "key")}


def test_words_whose_patterns_would_cancel():
    """Thue-Morse words and their complements have other digests, as have words that differ in one place."""
    tm = "a"
    for _ in range(11):
        tm += tm.translate(str.maketrans("ab", "ba"))
    many = [tm[:n] for n in range(1, 2049)] + [tm[:n].translate(str.maketrans("ab", "ba")) for n in range(1, 2049)]
    many += ["x" * i + "y" + "x" * (99 - i) for i in range(100)] + ["\x00" * n for n in range(1, 70)]
    from tidegate.llm.text_arrays import NOT_SPACE, Words, utf8

    found = Words(*utf8(pa.array([" ".join(many), *many])), NOT_SPACE)
    for second in (False, True):
        digests = found.digests(second)
        assert len(set(digests.tolist())) == len(set(many)) and (digests[: len(many)] == digests[len(many) :]).all()
    assert (found.digests() != found.digests(True)).all()


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(queries.vocabulary_path())


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary_path())


SAMPLES = ["", " ", "Hello  world\n\n  x", "don't we'll I'M", "1234 5,6", "日本語 текст ñandú", "a<|endoftext|>b", "  x", "x" * 3000, "\t\tb\r\n", "🙂🙃 ok", "<|endoftext|>", "é" * 200 + " \n"]


@pytest.mark.parametrize("text", SAMPLES)
def test_bpe_samples(vocabulary, public, text):
    want = public.encode(text, add_special_tokens=False).ids
    assert vocabulary.encode(text) == want
    assert vocabulary.decode(want) == public.decode(want, skip_special_tokens=False) == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_bpe_any_text(vocabulary, public, text):
    assert vocabulary.encode(text) == public.encode(text, add_special_tokens=False).ids


def test_bpe_forced_boundaries(vocabulary):
    """A fragment is never longer than what merges could reach, and cuts change nothing."""
    token = "internationalisation".encode()
    assert b"".join(vocabulary.fragments(token)) == token
    assert [i for f in vocabulary.fragments(token) for i in vocabulary.merge(f)] == vocabulary.merge(token)
    assert len(vocabulary.fragments(b"a b")) > 1


def test_bpe_table(edges, public):
    rows = bpe.encode_digests(edges, queries.vocabulary_path()).collect()
    want = sorted((str(i), len(public.encode(t or "", add_special_tokens=False).ids), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in EDGES)
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256) for r in rows) == want
    ids = bpe.encode_texts(edges, queries.vocabulary_path()).where("doc_id = 7").first()
    assert ids.decoded == LONG and list(ids.ids) == public.encode(LONG, add_special_tokens=False).ids


def test_license_words_and_places():
    text = "CC-BY 4.0; cc by! All  RIGHTS reserved. general public license éa9"
    n, places, found = license_scan.scan_text(text)
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    assert n == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))
    assert places == [(0, "cc-by"), (4, "cc-by"), (6, "reserved"), (9, "gpl")]
    assert {x[3] for x in found} >= {"cc-by", "reserved"}


def test_license_containment():
    a, b, c = (30, 0, 40, "gpl"), (10, 5, 20, "fdl"), (10, 35, 60, "mit")
    assert license_scan.resolve([b, a, c]) == [a, c]
    assert license_scan.resolve([b, b]) == [b]
    labels = [x[3] for x in license_scan.scan_text("Licensed under CC BY-NC 4.0.")[2]]
    assert labels == ["cc-by-nc"]
    assert len(license_scan.rules()) > 300


def test_license_signatures():
    """Hand-written signatures hold their keywords, and find the license in the wording it comes in."""
    from tidegate.llm.license_signatures import SIGNATURES

    assert len(set(SIGNATURES)) == len(SIGNATURES) > 200 and all(key in phrase for _, _, phrase, key in SIGNATURES)
    texts = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\n of this software and associated documentation files (the \"Software\"), to deal",
        "bsd-3-clause": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without",
        "apache": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.',
        "gpl": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published",
        "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "unlicense": "This is free and unencumbered software released into the public domain.",
        "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "json": "The Software shall be used for Good, not Evil.",
        "zlib": "Altered source versions must be plainly marked as such, and must not be\n misrepresented as being the original software.",
        "proprietary": "may not be reproduced in whole or in part without the prior written permission of",
        "bsl-1.1": "Change Date: 2026-01-01\n\nChange License: Apache License, Version 2.0",
    }
    for label, text in texts.items():
        assert label in {x[3] for x in license_scan.scan_text(text)[2]}, label


def test_license_suppression_of_many():
    """As by comparing all with all, and fast where a text has very many detections."""
    rng = np.random.default_rng(2)
    for _ in range(30):
        found = [(int(p), int(a), int(a + n), "abc"[k]) for p, a, n, k in zip(rng.integers(1, 5, 60), rng.integers(0, 80, 60), rng.integers(1, 30, 60), rng.integers(0, 3, 60))]
        kept = []
        for x in sorted(set(found), key=lambda x: (-x[0], x[1] - x[2], x[1], x[3])):
            if not any(k[1] <= x[1] and x[2] <= k[2] for k in kept):
                kept.append(x)
        assert license_scan.resolve(found) == sorted(kept, key=lambda x: (x[1], x[2], x[3]))
    assert len(license_scan.resolve([(9, i, i + 5, "x") for i in range(100_000)])) == 100_000


def test_license_query_of_a_table(spark, data):
    """All contract columns over a whole table against plain expressions."""
    big = data.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in queries.op10_license_scan(spark, big).collect()}
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    hits = 0
    for doc in spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text").collect():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), doc.text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, label) for i in range(len(w)) for p, label in phrases.items() if tuple(w[i : i + len(p)]) == p]
        r = rows[doc.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), *((min(at)[0], max(at)[0]) if at else (None, None)))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and {x for _, x in at} <= set(r.labels.split(","))
        assert list(r.labels.split(",")) == sorted(set(r.labels.split(","))) and 0 <= r.score <= 1
        hits += bool(at)
    assert hits > 5


def test_license_rules_pass_their_own_gates():
    samples = [
        ("copyright", "see (c) 2020 Jane Doe"), ("copyright", "see \u00a9 2020 Jane Doe"), ("copyright", "\u00a9 2019-2020"), ("copyright", "Copyright 2020 Jane"), ("copyright", "Copyright (C) 2020 Jane"),
        ("spdx", "SPDX-License-Identifier: MIT"), ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
        ("isc", "permission to use, copy, modify, and distribute this software for any purpose"), ("bsd", "Redistribution and use in source and binary forms, with or without modification"),
        ("bsd", "neither the name of X nor the names of its contributors"), ("zlib", "this software is provided 'as-is', without any express or implied warranty"),
        ("disclaimer", 'the software is provided "as is", without warranty of any kind'), ("public-domain", "released into the public domain"), ("proprietary", "confidential and proprietary"),
        ("proprietary", "unauthorised copying"), ("gpl", "either version 2 of the license, or (at your option) any later version"), ("reserved", "All rights reserved"),
        ("cc-by", "creativecommons.org/licenses/by/4.0"), ("cc-by-sa", "creativecommons.org/licenses/by-sa/4.0"), ("cc-by-nc", "creativecommons.org/licenses/by-nc/4.0"),
        ("cc0", "creativecommons.org/publicdomain/zero/1.0"), ("gpl", "gnu.org/licenses/gpl-3.0"), ("apache", "apache.org/licenses/license-2.0"), ("mpl", "mozilla.org/mpl/2.0"),
    ]
    assert {label for label, _, _, _ in license_scan._OTHERS} == {label for label, _ in samples}
    for label, text in samples:
        found = license_scan.scan_text(text)[2]
        assert label in {x[3] for x in found}, text
        assert len(found) == len(set(found))


def test_license_table(edges, frame):
    rows = {r.doc_id: r for r in license_scan.scan(edges).collect()}
    assert rows[1].n_words == 0 and rows[1].score == 0 and rows[7].n_words == 30_000
    assert license_scan.scan(frame([])).count() == 0


def test_fingerprints(spark, frame):
    texts = ["\n".join(f"line {i} of {d} and more words to fill it" for i in range(n)) for d, n in enumerate((3, 30, 12, 200, 1))]
    rows = [*enumerate(texts), (10, None), (11, ""), (12, texts[0]), (13, "aa\naa\naa\nbb")]
    got = {r.doc_id: r for r in fingerprints.compare_versions(frame(rows)).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        want = [likeness(text, edited), likeness(text, after)]
        assert [got[i].near_edited, got[i].near_next] == pytest.approx(want)
        if text == edited:
            assert got[i].fingerprint == got[i].edited_fingerprint
    assert got[0].fingerprint == got[12].fingerprint != got[1].fingerprint
    assert fingerprints.compare_versions(frame([])).count() == 0


def likeness(a, b):
    from collections import Counter

    units = lambda t: Counter(re.findall(r"[^\n]{1,%d}" % fingerprints.UNIT, t))
    x, y = units(a), units(b)
    both = sum((x & y).values())
    total = sum(x.values()) + sum(y.values()) - both
    return 1.0 if not total else both / total


def test_fingerprint_edges(edges):
    assert fingerprints.compare_versions(edges).count() == len(EDGES)


def test_probability_jaccard():
    a, b = np.array([1, 2, 3, 4], np.uint64), np.array([2, 3, 4, 5], np.uint64)
    one = np.ones(4)
    assert near_dedup.probability_jaccard(a, one, b, one) == pytest.approx(3 / 5)
    w, v = np.array([1.0, 2, 3, 4]), np.array([2.0, 1, 4, 3])
    pairs = {1: (1, 0), 2: (2, 2), 3: (3, 1), 4: (4, 4), 5: (0, 3)}
    want = sum(1 / sum(max(x / p, y / q) for x, y in pairs.values()) for p, q in pairs.values() if p and q)
    assert near_dedup.probability_jaccard(a, w, b, v) == pytest.approx(want)


def test_sketch_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    agree = []
    for _ in range(60):
        ids = rng.integers(1, 1 << 48, 120).astype(np.uint64)
        a, b = np.sort(ids[:100]), np.sort(ids[20:])
        row = np.repeat([0, 1], 100)
        s = near_dedup.sketch(2, row, np.concatenate([a, b]), np.ones(200))
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - 80 / 120) < 0.03


def test_overlap_tolerates_substitutions():
    item = np.arange(30)
    doc = np.concatenate([np.full(7, -1), item, np.full(5, -2)])
    assert decontamination.overlap(item, doc, 7) == 30
    doc[[10, 20]] = -9
    assert decontamination.overlap(item, doc, 7) == 28
    assert decontamination.overlap(item, doc, 40) == 0
