"""Words of many texts at once as numpy arrays: spans, digests and rolling digests.

All functions work on the UTF-8 bytes of an Arrow string column. Memory is
bounded by `text_slices`, which hands out a few megabytes of rows at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_SECOND_BASE = 0xA0761D6478BD642F
_FIRST_SEED, _SECOND_SEED = 0x243F6A8885A308D3, 0x13198A2E03707344
#: Bytes of a word that is digested in one go with the others, at most.
LONG_WORD = 64
_BYTE_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: Bytes of a word where only space and \t \n \v \f \r part words.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of a word where every ASCII sign that is no letter or digit parts words.
ALNUM = np.array([i >= 0x80 or chr(i).isalnum() for i in range(256)])

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16) * 5 // 4
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        have = _powers[base] = (tables[0], tables[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(offsets):
        return raw[:0], np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(batches, column: str, limit: int = 1 << 20):
    """Parts of record batches whose `column` holds about `limit` bytes, one row at least and 2**16 at most."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(at).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(sizes)])
        lo = 0
        while lo < batch.num_rows:
            hi = min(lo + (1 << 16), max(lo + 1, int(np.searchsorted(total, total[lo] + limit, "right")) - 1))
            yield batch.slice(lo, hi - lo)
            lo = hi


class Words:
    """Word spans over `data`; row r holds the words bounds[r]:bounds[r+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        inside = is_word[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
        self.data = data
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def row_ends(self) -> np.ndarray:
        """For each word, the index behind the last word of its row."""
        return np.repeat(self.bounds[1:], self.counts)

    def digests(self, second: bool = False) -> np.ndarray:
        """A 64-bit digest of each word's bytes, or another one, made apart from it.

        The bytes are taken eight at a time, and each step scrambles all that came before, so no
        pattern within a word cancels out. Words over LONG_WORD bytes are digested by blake2b.
        """
        starts, data = self.starts, self.data
        size = self.ends - starts
        seed = _SECOND_SEED if second else _FIRST_SEED
        out = mix(size.astype(np.uint64) * np.uint64(_BYTE_BASE) + np.uint64(seed))
        if not len(starts):
            return out
        whole = np.zeros((len(data) + 23) // 8 * 8, np.uint8)
        whole[: len(data)] = data
        eights = whole.view("<u8")
        short = size <= LONG_WORD

        def take(out, starts, size):
            """The words' digests so far with their next eight bytes; a copy is changed in place."""
            block = starts >> 3
            shift = ((starts & 7) << 3).astype(np.uint64)
            value = eights[block] >> shift
            value |= (eights[block + 1] << (np.uint64(63) - shift)) << np.uint64(1)
            value &= _BYTE_MASKS[np.minimum(size, 8)]
            value ^= out
            value *= np.uint64(_WORD_BASE)
            value += np.uint64(seed)
            return mix(value)

        out = take(out, starts, size)
        todo = np.flatnonzero(short & (size > 8))
        lane = 8
        while len(todo):
            out[todo] = take(out[todo], starts[todo] + lane, size[todo] - lane)
            lane += 8
            todo = todo[size[todo] > lane]
        for i in np.flatnonzero(~short):
            digest = hashlib.blake2b(data[starts[i] : self.ends[i]].tobytes(), digest_size=16).digest()
            out[i] = np.frombuffer(digest, "<u8")[int(second)]
        return out


def rolling(digests: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """The digest of each k consecutive words from their digests; `second` asks for another function of them. Rows are not regarded."""
    n = len(digests)
    if n < k:
        return np.zeros(0, np.uint64)
    base = _SECOND_BASE if second else _WORD_BASE
    up, down = powers(base | 1, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(digests * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1] + np.uint64(k))


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each `width` consecutive values."""
    have, out = 1, x
    while have * 2 <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = best(out[: len(out) - (width - have)], out[width - have :])
    return out
