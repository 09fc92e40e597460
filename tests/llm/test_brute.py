"""Queries held against plain Python over whole tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidegate.llm import decontamination, language_id, queries


def rows_of(spark, folder, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(*columns).collect()]


def test_bpe_ids_of_a_table(spark, data):
    """Every digest of ids and of decoded text, against the public tokenizer."""
    public = Tokenizer.from_file(queries.vocabulary_path())
    public.no_truncation()
    public.no_padding()
    want = {}
    for i, text in rows_of(spark, data, "documents", "doc_id", "text"):
        ids = public.encode(text or "", add_special_tokens=False).ids
        decoded = public.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op4_bpe(spark, data).collect()}
    assert got == want


def plain_overlap(item, words):
    """Most agreeing words of any stretch of the item laid over the words, a fifth substituted at most."""
    best = 0
    need = decontamination.least(len(item))
    for shift in range(1 - len(item), len(words)):
        same = [i for i in range(len(item)) if 0 <= i + shift < len(words) and item[i] == words[i + shift]]
        if len(same) < need:
            continue
        for a in range(len(same)):
            for b in range(a + need - 1, len(same)):
                if (b - a + 1) * 5 >= 4 * (same[b] - same[a] + 1):
                    best = max(best, b - a + 1)
    return best


def test_decontamination_of_a_table(spark, data):
    """Every document against every item that shares a word pair with it, all placements and stretches."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower())
    docs = {i: split(t) for i, t in rows_of(spark, data, "documents", "doc_id", "text")}
    items = {i: split(t) for i, t in rows_of(spark, data, "benchmark", "item_id", "text")}
    pairs = defaultdict(set)
    for i, words in items.items():
        for p in zip(words, words[1:]):
            pairs[p].add(i)
    want = defaultdict(dict)
    for d, words in docs.items():
        near = Counter(i for p in set(zip(words, words[1:])) for i in pairs.get(p, ()))
        for i, shared in near.items():
            # four of five agreeing words have a pair that agrees; few pairs leave no room for an overlap
            if shared >= 3 and len(items[i]) >= decontamination.MIN_WORDS and (found := plain_overlap(items[i], words)):
                want[d][i] = found
    got = {r.doc_id: (r.n_items, r.n_words, sorted(r["items"])) for r in queries.op2_decontamination(spark, data).collect()}
    assert got == {d: (len(f), max(f.values()), sorted(f)) for d, f in want.items()} and got


class PlainModel:
    """Interpolated Kneser-Ney over lists of signs, by dictionaries and the textbook's recursion."""

    def __init__(self, texts, order, size):
        self.order, self.size = order, size
        self.counts = [None] + [Counter() for _ in range(order)]
        for signs in texts:
            for i in range(1, len(signs)):
                self.counts[order][tuple(signs[max(0, i - order + 1) : i + 1])] += 1
        full = Counter()
        for gram, n in self.counts[order].items():
            full[(0,) * (order - len(gram)) + gram] += n
        self.counts[order] = full
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.discount, self.total, self.followers = {}, {}, {}
        for n in range(1, order + 1):
            once, twice = (sum(1 for v in self.counts[n].values() if v == k) for k in (1, 2))
            self.discount[n] = min(0.9, max(0.1, once / (once + 2 * twice) if once + 2 * twice else 0.5))
            total, followers = Counter(), Counter()
            for g, v in self.counts[n].items():
                total[g[:-1]] += v
                followers[g[:-1]] += 1
            self.total[n], self.followers[n] = total, followers

    def p(self, gram):
        n = len(gram)
        if n == 0:
            return 1 / self.size
        context, lower = gram[:-1], self.p(gram[1:])
        if not self.total[n][context]:
            return lower
        d = self.discount[n]
        return max(self.counts[n][gram] - d, 0) / self.total[n][context] + d * self.followers[n][context] / self.total[n][context] * lower


def test_language_models_against_the_textbook(spark, data):
    """Entropies of held-out texts under the trained arrays and under plain dictionaries of the same sample."""
    docs = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet").where("length(text) < 1500")
    where = ~language_id.held_out()
    model, _ = language_id.train(docs, where)
    sample = language_id.labelled_sample(docs, where).where("not held").select("lang", "text").collect()
    signs = lambda t: [0, *[x.item() for x in language_id.symbols(pa.array([t]), model.alphabet)[0]][1:]]
    texts = defaultdict(list)
    for r in sample:
        texts[r.lang].append(signs(r.text))
    plain = {lang: PlainModel(own, language_id.ORDER, len(model.alphabet) + 2) for lang, own in texts.items()}
    judged = [r.text for r in docs.where(language_id.held_out()).orderBy("doc_id").select("text").limit(6).collect()]
    entropy, _ = model.entropies(pa.array(judged))
    for text, row in zip(judged, entropy):
        own = signs(text)
        for x, lang in enumerate(model.languages):
            logs = [math.log(plain[lang].p(tuple([0] * max(0, language_id.ORDER - 1 - i) + own[max(0, i - language_id.ORDER + 1) : i + 1])[-language_id.ORDER :])) for i in range(1, len(own))]
            assert row[x] == pytest.approx(-sum(logs) / len(logs), rel=1e-3)


def units(text):
    """A text's lines, long ones in blocks, as a set: equal ones by their number."""
    seen, out = Counter(), set()
    for unit in re.findall(r"[^\n]{1,120}", text):
        seen[unit] += 1
        out.add((unit, seen[unit]))
    return out


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_fingerprints_of_a_table(spark, data, folder):
    """Edited texts, likeness to them and to the next document, against sets of units."""
    path = data.replace("sf0.001", folder)
    docs = [(i, t or "") for i, t in rows_of(spark, path, "documents", "doc_id", "text")]
    docs.sort(key=lambda d: -d[0])
    share = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
    got = {r.doc_id: r for r in queries.op8_fingerprints(spark, path).collect()}
    assert len(got) == len(docs)
    prints = {}
    for n, (i, text) in enumerate(docs):
        follower = docs[(n + 1) % len(docs)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follower[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(share(units(text), units(edited))) and r.near_next == pytest.approx(share(units(text), units(follower)))
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        if edited == text:
            assert r.edited_fingerprint == r.fingerprint
    assert len(set(prints.values())) == len({frozenset(units(t)) for t in prints})


def test_kept_words_and_repeats_agree(spark, data):
    """The maximal repeats that op7 returns are the words it removed."""
    for r in queries.op7_substring_dedup(spark, data).collect():
        assert sum(x["length"] for x in r.repeats) == r.n_removed
        ends = [(x["start"], x["start"] + x["length"]) for x in r.repeats]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:])) and all(0 <= a < b <= r.n_words for a, b in ends)
