"""Byte-level BPE encoding and decoding with forced boundaries.

No vocabulary token holds certain pairs of neighbouring bytes, so no merge can
ever join them: between such bytes a cut is certain. Texts are cut there and at
the vocabulary's own pre-token borders, each fragment is encoded on its own, and
the results are put together. Fragments repeat a lot, so a worker remembers the
ones it met, within a fixed bound.
"""

from __future__ import annotations

import json
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from tidegate.llm.text_arrays import text_slices

#: Fixed value: the published pre-token pattern of this vocabulary.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pre-tokens a worker remembers at most, half of them met lately.
REMEMBERED = 240_000
#: Fragments longer than this are merged with a queue.
SHORT = 48
_ID = (1 << 20) - 1
_NONE = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The published stand-in characters of bytes: printable ones as they are, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merge ranks, token bytes and the forced boundaries of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        model = spec["model"]
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t.encode() for t, i in self.specials.items()}
        self.bytes = [self.ids[bytes([b])] for b in range(256)]
        #: of two neighbouring ids: their merge's rank, and the merged id in the low bits
        self.pairs: dict[int, int] = {}
        for rank, m in enumerate(model["merges"]):
            left, right = (raw(x) for x in (m if isinstance(m, list) else m.split(" ")))
            self.pairs.setdefault(self.ids[left] << 20 | self.ids[right], rank << 20 | self.ids[left + right])
        joined = np.zeros((256, 256), bool)
        for token in self.ids:
            b = np.frombuffer(token, np.uint8)
            joined[b[:-1], b[1:]] = True
        #: forced[a << 8 | b] is 1 where no token has byte b behind byte a
        self.forced = (~joined).astype(np.uint8).tobytes()
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def fragments(self, token: bytes) -> list[bytes]:
        """`token` cut at its forced boundaries."""
        forced = self.forced
        cuts = [i for i, (a, b) in enumerate(zip(token, token[1:]), 1) if forced[a << 8 | b]]
        if not cuts:
            return [token]
        edges = [0, *cuts, len(token)]
        return [token[a:z] for a, z in zip(edges, edges[1:])]

    def merge(self, fragment: bytes) -> list[int]:
        """The ids of one fragment: the pair of lowest rank, the first of equal ones, is joined until none has a rank."""
        if len(fragment) > SHORT:
            return self._merge_long(fragment)
        get, of = self.pairs.get, self.bytes
        parts = [of[b] for b in fragment]
        found = [get(a << 20 | b, _NONE) for a, b in zip(parts, parts[1:])]
        while found:
            best = min(found)
            if best == _NONE:
                break
            i = found.index(best)
            parts[i] = new = best & _ID
            del parts[i + 1], found[i]
            if i:
                found[i - 1] = get(parts[i - 1] << 20 | new, _NONE)
            if i < len(found):
                found[i] = get(new << 20 | parts[i + 1], _NONE)
        return parts

    def _merge_long(self, fragment: bytes) -> list[int]:
        """As `merge`, in n log n steps: neighbours are linked and candidate pairs queued."""
        get = self.pairs.get
        parts = [self.bytes[b] for b in fragment]
        right = [*range(1, len(parts)), -1]
        left = [*range(-1, len(parts) - 1)]
        queue = [(m, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (m := get(parts[i] << 20 | parts[i + 1])) is not None]
        heapify(queue)
        while queue:
            m, i, a, b = heappop(queue)
            j = right[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = m & _ID, -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (m := get(parts[i] << 20 | parts[k])) is not None:
                    heappush(queue, (m, i, parts[i], parts[k]))
            if (h := left[i]) >= 0 and (m := get(parts[h] << 20 | parts[i])) is not None:
                heappush(queue, (m, h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def _learn(self, pretoken: str) -> tuple[int, ...]:
        ids = self.older.get(pretoken)
        if ids is None:
            ids = tuple(i for f in self.fragments(pretoken.encode()) for i in self.merge(f))
        if len(self.known) >= REMEMBERED // 2:
            self.known, self.older = {}, self.known
        if len(pretoken) <= 64:
            self.known[pretoken] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                out.append(self.specials[part])
                continue
            for pretoken in PRETOKEN.findall(part):
                out += self.known.get(pretoken) or self._learn(pretoken)
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def _vocabulary(name: str) -> Vocabulary:
    return Vocabulary(SparkFiles.get(name))


def encode_texts(docs: DataFrame, vocabulary: str, carry: tuple[str, ...] = ("doc_id",), text: str = "text", decode: bool = True) -> DataFrame:
    """`carry` columns with ids (array<int>) and decoded (string, made from the ids; null without `decode`).

    `vocabulary` is a tokenizer file on the driver, which Spark hands to the
    executors. Null counts as empty; an empty text has no ids and decodes to an
    empty string. Added tokens in a text are read as such. Every row is encoded
    by itself, so repeated rows give repeated results, and columns beside `carry`
    are left aside; a carried column named ids or decoded gives way to the result.
    """
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]
    carry = [c for c in carry if c not in ("ids", "decoded")]
    kinds = dict(docs.dtypes)

    def run(batches):
        vocab = _vocabulary(name)
        for batch in text_slices(batches, text):
            ids = [vocab.encode(t) if t else [] for t in batch.column(text).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            decoded = pa.array([vocab.decode(x) if decode else None for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), lists, decoded], [*carry, "ids", "decoded"])

    wanted = docs.select(*carry, *([] if text in carry else [text]))
    return wanted.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "ids array<int>, decoded string"]))


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document; ids as little-endian unsigned 32-bit integers."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]

    def run(batches):
        vocab = _vocabulary(name)
        for batch in text_slices(batches, "text"):
            counts, id_digests, text_digests = [], [], []
            for text in batch.column("text").to_pylist():
                ids = vocab.encode(text) if text else []
                counts.append(len(ids))
                id_digests.append(sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                text_digests.append(sha256(vocab.decode(ids).encode()).hexdigest())
            out = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
