"""License scan by ordered signature rules.

A rule is a regular expression over lower-cased text, with a label, a priority
and keywords. A rule runs only on texts that hold all its keywords, found in one
pass. Detections that overlap are resolved in order: one that lies within another
of higher priority, or of equal priority and greater length, is suppressed.

Most rules are the hand-written signatures of `license_signatures`, and those
below; names of license families, with and without versions and words of a grant,
are spelled out from a table.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidegate.llm.license_signatures import SIGNATURES
from tidegate.llm.text_arrays import text_slices

WORD = r"[0-9a-z\x80-\xff]"
GAP = r"[^0-9a-z\x80-\xff]+"

#: Phrases whose places always count: words in a row, label, and the keyword that gates them.
BASE = (("cc by", "cc-by", "cc"), ("general public license", "gpl", "license"), ("all rights reserved", "reserved", "reserved"))

# family: (label, names as words, versions)
_FAMILIES = (
    ("apache", ("apache license", "apache software license", "asl"), ("1.0", "1.1", "2.0")),
    ("gpl", ("gnu general public license", "gnu gpl", "gpl"), ("1", "2", "2.0", "3", "3.0")),
    ("lgpl", ("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"), ("2", "2.1", "3", "3.0")),
    ("agpl", ("gnu affero general public license", "affero gpl", "agpl"), ("1.0", "3", "3.0")),
    ("fdl", ("gnu free documentation license", "gfdl"), ("1.1", "1.2", "1.3")),
    ("mpl", ("mozilla public license", "mpl"), ("1.0", "1.1", "2.0")),
    ("epl", ("eclipse public license", "epl"), ("1.0", "2.0")),
    ("cddl", ("common development and distribution license", "cddl"), ("1.0", "1.1")),
    ("eupl", ("european union public licence", "eupl"), ("1.1", "1.2")),
    ("osl", ("open software license", "osl"), ("2.1", "3.0")),
    ("artistic", ("artistic license", "perl artistic license"), ("1.0", "2.0")),
    ("boost", ("boost software license", "bsl"), ("1.0",)),
    ("bsd", ("bsd license", "bsd 2 clause license", "bsd 3 clause license", "new bsd license", "simplified bsd license"), ()),
    ("mit", ("mit license", "expat license", "x11 license"), ()),
    ("isc", ("isc license", "internet systems consortium license"), ()),
    ("zlib", ("zlib license", "zlib libpng license"), ()),
    ("unlicense", ("unlicense", "the unlicense"), ()),
    ("wtfpl", ("wtfpl", "do what the fuck you want to public license"), ()),
    ("psf", ("python software foundation license", "psf license"), ()),
    ("cc-by", ("creative commons attribution license", "cc by", "cc-by"), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", ("creative commons attribution sharealike license", "cc by sa"), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", ("creative commons attribution noncommercial license", "cc by nc"), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nd", ("creative commons attribution noderivs license", "cc by nd"), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-sa", ("creative commons attribution noncommercial sharealike license", "cc by nc sa"), ("2.0", "3.0", "4.0")),
    ("cc-by-nc-nd", ("creative commons attribution noncommercial noderivs license", "cc by nc nd"), ("2.0", "3.0", "4.0")),
    ("cc0", ("cc0", "creative commons zero", "cc0 universal"), ("1.0",)),
    ("ofl", ("sil open font license", "ofl"), ("1.0", "1.1")),
    ("odbl", ("open database license", "odbl"), ("1.0",)),
)
# how a grant names a license: lead words, and a priority above the bare name's
_LEADS = (("licensed under", 30), ("released under", 30), ("distributed under", 30), ("available under", 25), ("subject to", 25), ("under the terms of", 30))
_COPYRIGHT = r"(?:copyright|\xc2\xa9|\(c\))[ \t]*(?:\(c\)|\xc2\xa9)?[ \t]*(?:19|20)[0-9]{2}(?:[ \t]*[-,][ \t]*(?:19|20)[0-9]{2})*[^\n]{0,80}"
# free wording: label, priority, regular expression, keywords that must all be there; alternatives are rules of their own
_OTHERS = (
    ("spdx", 40, r"spdx-license-identifier:[ \t]*[a-z0-9.+-]+(?:[ \t]+(?:or|and|with)[ \t]+[a-z0-9.+-]+)*", ("spdx-license-identifier",)),
    *(("copyright", 10, _COPYRIGHT, (k,)) for k in ("copyright", "(c)", "\u00a9")),
    ("mit", 35, r"permission is hereby granted, free of charge, to any person obtaining a copy", ("permission is hereby granted",)),
    ("isc", 35, r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose", ("permission to use",)),
    ("bsd", 35, r"redistribution and use in source and binary forms, with or without modification", ("redistribution and use",)),
    ("bsd", 20, r"neither the name of [^\n]{1,80} nor the names of its contributors", ("neither the name of",)),
    ("zlib", 35, r"this software is provided 'as-is', without any express or implied warranty", ("provided 'as-is'",)),
    ("disclaimer", 5, r"the software is provided [\"']?as is[\"']?,? without warranty of any kind", ("without warranty of any kind",)),
    ("public-domain", 20, r"(?:released|dedicated|placed) (?:in|in?to) the public domain", ("public domain",)),
    ("proprietary", 20, r"(?:proprietary and confidential|confidential and proprietary)", ("confidential",)),
    ("proprietary", 15, r"unauthori[sz]ed (?:copying|use|reproduction|distribution)", ("unauthori",)),
    ("gpl", 40, r"either version [0-9](?:\.[0-9])? of the license, or \(at your option\) any later version", ("any later version",)),
    ("reserved", 20, rf"all{GAP}rights{GAP}reserved", ("reserved",)),
    ("cc-by", 25, r"creativecommons\.org/licenses/by/[0-9.]+", ("creativecommons.org",)),
    ("cc-by-sa", 26, r"creativecommons\.org/licenses/by-sa/[0-9.]+", ("creativecommons.org",)),
    ("cc-by-nc", 26, r"creativecommons\.org/licenses/by-nc/[0-9.]+", ("creativecommons.org",)),
    ("cc0", 26, r"creativecommons\.org/publicdomain/zero/[0-9.]+", ("creativecommons.org",)),
    ("gpl", 25, r"gnu\.org/licenses/(?:old-licenses/)?gpl[-.0-9a-z]*", ("gnu.org/licenses",)),
    ("apache", 25, r"apache\.org/licenses/license-[0-9.]+", ("apache.org/licenses",)),
    ("mpl", 25, r"mozilla\.org/mpl/[0-9.]*", ("mozilla.org/mpl",)),
)


class Rule:
    def __init__(self, label: str, priority: int, pattern: str, keywords: tuple[str, ...]):
        self.label, self.priority, self.pattern = label, priority, pattern
        self.keywords = tuple(k.encode() for k in keywords)
        self.find = regex.compile(rf"(?<!{WORD})(?:{pattern})(?!{WORD})".encode("latin-1")).finditer


def _spelled(words: str) -> str:
    return GAP.join(map(regex.escape, words.replace("-", " ").split()))


def _in_a_row(phrase: str) -> str:
    """A signature with its spaces written out as gaps between words."""
    return phrase.replace(" ?", GAP[:-1] + "*").replace(" ", GAP)


@lru_cache(1)
def rules() -> list[Rule]:
    """All rules, highest priority first; equal ones in the order of the tables."""
    out = []
    for label, names, versions in _FAMILIES:
        for name in names:
            key = max(name.replace("-", " ").split(), key=len)
            version = rf"(?:{GAP}(?:version|v|only|or later))*{GAP}(?:v)?(?:{'|'.join(map(regex.escape, versions))})" if versions else ""
            out.append(Rule(label, 10 + len(name) // 8, _spelled(name), (key,)))
            if versions:
                out.append(Rule(label, 20 + len(name) // 8, _spelled(name) + version, (key,)))
            for lead, priority in _LEADS:
                out.append(Rule(label, priority + len(name) // 8, rf"{_spelled(lead)}{GAP}(?:(?:the|an?){GAP})?{_spelled(name)}(?:{version})?", (lead.split()[0], key)))
    out += [Rule(*x) for x in _OTHERS]
    out += [Rule(label, priority, _in_a_row(phrase), (key,)) for label, priority, phrase, key in SIGNATURES]
    return sorted(out, key=lambda r: -r.priority)


@lru_cache(1)
def _base():
    return [(label, regex.compile(rf"(?<!{WORD}){_spelled(phrase)}(?!{WORD})".encode("latin-1")).finditer) for phrase, label, _ in BASE]


@lru_cache(1)
def _keywords():
    """The automaton of all keywords, and for each keyword the rules that need it."""
    words = sorted({k for r in rules() for k in r.keywords} | {k.encode() for _, _, k in BASE})
    automaton = ahocorasick.Automaton()
    for i, word in enumerate(words):
        automaton.add_word(word.decode(), i)
    automaton.make_automaton()
    place = {w: i for i, w in enumerate(words)}
    return automaton, [(r, frozenset(place[k] for k in r.keywords)) for r in rules()], [place[k.encode()] for _, _, k in BASE]


_IS_WORD = np.array([48 <= i <= 57 or 97 <= i <= 122 or i >= 0x80 for i in range(256)])


def resolve(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Detections (priority, start, end, label) left after suppression, by place.

    Kept ones are held by start in a tree of largest ends, so that a text of very many detections takes n log n steps.
    """
    found = sorted(set(found), key=lambda x: (-x[0], x[1] - x[2], x[1], x[3]))
    place = {start: i + 1 for i, start in enumerate(sorted({x[1] for x in found}))}
    furthest = [-1] * (len(place) + 1)
    kept = []
    for x in found:
        i, reach = place[x[1]], -1
        while i:
            reach = max(reach, furthest[i])
            i &= i - 1
        if reach >= x[2]:
            continue
        kept.append(x)
        i = place[x[1]]
        while i < len(furthest):
            furthest[i] = max(furthest[i], x[2])
            i += i & -i
    return sorted(kept, key=lambda x: (x[1], x[2], x[3]))


def scan_text(text: str):
    """(n_words, base places as (word, label), detections as (priority, start, end, label) by byte) of one text."""
    low = text.encode().lower()
    inside = _IS_WORD[np.frombuffer(low, np.uint8)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    n_words = int(np.count_nonzero(first))
    automaton, gated, base_keys = _keywords()
    have = {i for _, i in automaton.iter(low.decode())}
    if not have:
        return n_words, [], []
    found = [(r.priority, m.start(), m.end(), r.label) for r, needed in gated if needed <= have for m in r.find(low)]
    places = [(m.start(), label) for key, (label, find) in zip(base_keys, _base()) if key in have for m in find(low)]
    if places:
        starts = np.flatnonzero(first)
        places = sorted((int(np.searchsorted(starts, at)), label) for at, label in places)
    return n_words, places, resolve(found)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, places, detections, labels, score) of each document.

    `places` are the base phrases' (word, label), `detections` the surviving
    rules' (label, start, length in bytes, priority); `labels` are distinct and
    sorted, `score` is the strongest evidence: 0.5 for a bare name or phrase, up
    to 1 for a full grant, 0 for none. A null or empty text has no word and no
    detection. Each row is scanned by itself. Other columns are left aside.
    """
    kind = dict(docs.dtypes)["doc_id"]
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    detection = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("priority", pa.int32())]))
    top = max(r.priority for r in rules())

    def run(batches):
        for batch in text_slices(batches, "text"):
            n, places, found, labels, score = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                words, at, kept = scan_text(text or "")
                n.append(words)
                places.append([{"word": w, "label": x} for w, x in at])
                found.append([{"label": x, "start": a, "length": b - a, "priority": p} for p, a, b, x in kept])
                labels.append(sorted({x for _, x in at} | {k[3] for k in kept}))
                score.append(max([0.5 * bool(at), *(0.5 + 0.5 * k[0] / top for k in kept)]))
            out = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(places, place), pa.array(found, detection), pa.array(labels, pa.list_(pa.string())), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "places", "detections", "labels", "score"])

    schema = f"doc_id {kind}, n_words long, places array<struct<word:long,label:string>>, detections array<struct<label:string,start:int,length:int,priority:int>>, labels array<string>, score double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
