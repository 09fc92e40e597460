"""Stretches of a text that repeat a period: suffix automaton with link-cut access.

Words are appended to a suffix automaton one by one. The path of suffix links from
the state of the newest prefix to the root holds all its suffixes; it falls into
segments whose suffixes ended at the same earlier place. Each access recolours the
path. A segment with previous end j under the new end i is a square of period
i - j if its longest suffix is that long and the next segment's is not; a square is
then extended to the run it lies in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegate.llm.text_arrays import NOT_SPACE, Words, mix, text_slices, utf8

RUNS = "array<struct<start:long,length:long,period:long>>"


def automaton(codes: list) -> tuple[list[int], list[int], list[int]]:
    """(link, longest, prefix states) of the suffix automaton of `codes`; state 0 is the root and links below itself to -1."""
    link, longest, moves, ends = [-1], [0], [{}], []
    last = 0
    for code in codes:
        new = len(link)
        link.append(0)
        longest.append(longest[last] + 1)
        moves.append({})
        p = last
        while p >= 0 and code not in moves[p]:
            moves[p][code] = new
            p = link[p]
        if p >= 0:
            q = moves[p][code]
            if longest[q] != longest[p] + 1:
                clone = len(link)
                link.append(link[q])
                longest.append(longest[p] + 1)
                moves.append(moves[q].copy())
                while p >= 0 and moves[p].get(code) == q:
                    moves[p][code] = clone
                    p = link[p]
                link[q] = clone
                q = clone
            link[new] = q
        last = new
        ends.append(new)
    return link, longest, ends


class Paths:
    """Preferred paths of a forest as splay trees ordered by depth, each with the place of its last access."""

    def __init__(self, link: list[int]):
        # node 0, the root, is left out: it stands for the empty suffix
        self.up = [max(p, 0) for p in link]
        self.shallow = [0] * len(link)
        self.deep = [0] * len(link)
        self.seen = [-1] * len(link)

    def _splay(self, x: int) -> None:
        """Make x the root of its path's tree, which hands it the path's last access."""
        up, shallow, deep = self.up, self.shallow, self.deep
        y = up[x]
        top = 0
        while y and (shallow[y] == x or deep[y] == x):
            z = up[y]
            inner = z and (shallow[z] == y or deep[z] == y)
            if inner and (shallow[z] == y) == (shallow[y] == x):
                turns = ((y, z), (x, y))
            elif inner:
                turns = ((x, y), (x, z))
            else:
                turns = ((x, y),)
            for a, b in turns:
                c = up[b]
                if shallow[b] == a:
                    m = deep[a]
                    shallow[b] = m
                    deep[a] = b
                else:
                    m = shallow[a]
                    deep[b] = m
                    shallow[a] = b
                if m:
                    up[m] = b
                up[b] = a
                up[a] = c
                if c:
                    if shallow[c] == b:
                        shallow[c] = a
                    elif deep[c] == b:
                        deep[c] = a
            top = z if inner else y  # the last of these was the tree's root
            y = up[x]
        if top:
            self.seen[x] = self.seen[top]

    def access(self, node: int, now: int) -> list[tuple[int, int]]:
        """(deepest node, place of the last access) of each segment from `node` up to the root; the path is recoloured to `now`."""
        found, below, x = [], 0, node
        while x:
            self._splay(x)
            place = self.seen[x]
            found.append((x, place))
            if rest := self.deep[x]:
                self.seen[rest] = place  # what lies deeper keeps its colour
            self.deep[x] = below
            below = x
            x = self.up[x]
        self.seen[below] = now
        self._splay(node)
        return found


def squares(codes: list):
    """(last place, period) of squares of `codes`: at least one, the first to end, in every run."""
    link, longest, ends = automaton(codes)
    paths = Paths(link)
    for i, state in enumerate(ends):
        found = paths.access(state, i)
        for k, (node, place) in enumerate(found):
            if place < 0:
                continue
            period = i - place
            if period <= longest[node] and (k + 1 == len(found) or longest[found[k + 1][0]] < period):
                yield i, period


def _reach(codes: np.ndarray, at: int, period: int, step: int, lo: int, hi: int) -> int:
    """The last place from `at` on in steps of 1 or -1, within lo..hi, where all words agree with those `period` before."""
    width = 16
    while True:
        end = min(hi, at + width) if step > 0 else max(lo, at - width)
        a = np.arange(at, end + step, step)
        differ = np.flatnonzero(codes[a] != codes[a - period])
        if len(differ):
            return at + step * (int(differ[0]) - 1)
        if end in (hi if step > 0 else lo,):
            return end
        at, width = end, width * 2


def runs_within(codes: np.ndarray, lo: int, hi: int, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of `codes` with a square in lo..hi that are at least `least` and `times` periods long."""
    out, known = [], {}
    for place, period in squares(codes[lo:hi].tolist()):
        place += lo
        if known.get(period, -1) > place:
            continue
        first = _reach(codes, place, period, -1, period, len(codes) - 1) - period
        end = _reach(codes, place, period, 1, period, len(codes) - 1) + 1
        known[period] = end
        if end - first >= max(least, times * period):
            out.append((first, end - first, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray, bounds: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Spans outside which no run can lie, apart from each other, of rows of words bounds[r]:bounds[r+1].

    Behind its first period every word of a run has met itself within one period. For periods in
    (Q/2, Q] that makes a stretch of words with a distance of Q at most to their last occurrence,
    times - 1 periods long; the run starts Q words before it at the earliest.
    """
    n = len(codes)
    if not n:
        return []
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    keys = mix(codes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    distance = np.full(n, n + 1, np.int64)
    distance[order[1:][same]] = order[1:][same] - order[:-1][same]
    longest = int(np.diff(bounds).max())
    spans, width = [], 1
    while True:
        smallest = width // 2 + 1
        if smallest * times > longest or (width > 1 and not (distance <= n).any()):
            break
        near = np.zeros(n + 2, np.int8)
        near[1:-1] = distance <= width
        turn = np.flatnonzero(np.diff(near))
        first, end = turn[::2], turn[1::2]
        ok = end - first >= max(least - min(width, least), (times - 1) * smallest, 1)
        first, end = first[ok], end[ok]
        if len(first):
            start = np.maximum(first - width, bounds[row[first]])
            spans.append(np.stack([start, end], 1))
        width *= 2
    if not spans:
        return []
    spans = np.concatenate(spans)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    opens = np.flatnonzero(np.concatenate([[True], spans[1:, 0] >= reach[:-1]]))
    return list(zip(spans[opens, 0].tolist(), reach[np.append(opens[1:], len(spans)) - 1].tolist()))


def _judged(least: int, times: int, names: list[str]):
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in text_slices(batches, "text"):
            words = Words(*utf8(batch.column("text")), NOT_SPACE)
            codes, bounds = words.digests(), words.bounds
            runs: list[list] = [[] for _ in range(batch.num_rows)]
            for lo, hi in stretches(codes, bounds, least, times):
                r = int(np.searchsorted(bounds, lo, "right")) - 1
                own = codes[bounds[r] : bounds[r + 1]]
                # two stretches may lie in one run
                runs[r] += runs_within(own, lo - int(bounds[r]), hi - int(bounds[r]), least, times)
            dropped, kept = [], []
            data = words.data.tobytes()
            row_starts = utf8(batch.column("text"))[1]
            for r in range(batch.num_rows):
                runs[r] = sorted(set(runs[r]), key=lambda x: (x[0], x[2]))
                own = data[row_starts[r] : row_starts[r + 1]].split()
                n = 0
                if runs[r]:
                    edge = np.zeros(len(own) + 1, np.int64)
                    for start, length, period in runs[r]:
                        edge[start + period] += 1
                        edge[start + length] -= 1
                    stays = np.cumsum(edge)[:-1] == 0
                    n = len(own) - int(stays.sum())
                    own = [own[i] for i in np.flatnonzero(stays)]
                dropped.append(n)
                kept.append(b" ".join(own).decode())
            out = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            listed = [[{"start": s, "length": k, "period": q} for s, k, q in found] for found in runs]
            out |= {"n_words": pa.array(words.counts.astype(np.int64)), "n_dropped": pa.array(dropped, pa.int64())}
            out |= {"runs": pa.array(listed, run_type), "collapsed_text": pa.array(kept, pa.string())}
            yield pa.RecordBatch.from_arrays([out[c] for c in names], names)

    return run


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """(doc_id, n_words, n_dropped, runs, collapsed_text) of each row of `docs`, which holds `doc_id` and `text`.

    Words are runs of other than ASCII white space. `runs` lists (start, length,
    period) of every stretch of words with least period `period` that no
    neighbouring word extends and that is at least `least` words and `times` periods
    long (two at least), by start, then period; `collapsed_text` is what is left, joined by one
    space, when each run keeps its first period only.

    Only stretches that can hold such a run go through the automaton; which can is
    told from each word's distance to its last occurrence, without loss. Words are
    compared by digests of 64 bits. One row is one task's work; memory grows with
    the longest such stretch, some 1 kB a word. Null and empty texts have no words
    and no runs. Each row is judged alone, so null, repeated and equal ids give a
    row each; an empty table gives none. Other columns are left aside.
    """
    if times < 2:
        raise ValueError("a run holds a square: times must be 2 or more")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL(f"n_words long, n_dropped long, runs {RUNS}, collapsed_text string").fields])
    return rows.mapInArrow(_judged(least, times, schema.names), schema)


def best_run(runs: Column) -> Column:
    """The run of greatest exact length / period; the first of equal ones, null if there is none."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, 0), lambda best, r: F.when(more(r, best), r).otherwise(best))


def listing(runs: Column) -> Column:
    """Every run as `start,length,period` and a line break."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
