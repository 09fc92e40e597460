"""Near-duplicate classes by ProbMinHash, banding and verification.

Texts become sets of five-word shingles weighted by how often each occurs. A
shingle's arrivals are a Poisson process of that rate whose points fall on
registers at random; a register keeps its earliest shingle. A shingle stops once
its arrivals come later than every register's, so each costs little more than
one point. Two sketches agree on a register with their probability Jaccard.

Registers are joined in bands. Copies of a text count once. In a band's bucket
every text is linked to one centre only; links are verified on the texts
themselves, and components formed. Where a bucket still holds several
components, its texts meet those of other components.
They do so in blocks of bounded size, where two tests rule out nearly all that are not
alike before any pair is put out: the registers that agree, and a bound from parity maps. A parity map has a bit for
each hash value, set if an odd number of shingles have it; bits in which two maps
differ are shingles that one text has alone, so the bound is exact and no link
within a bucket is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import stage, unstage
from tidegate.llm.components import connected_components
from tidegate.llm.screens import screen, screened
from tidegate.llm.text_arrays import NOT_SPACE, Words, mix, rolling, text_slices, utf8

SHINGLE = 5
ROWS, BANDS = 5, 24
REGISTERS = ROWS * BANDS
#: Registers are compared by their low byte, eight in a long.
PACKED = REGISTERS // 8
#: Longs of a parity map.
PARITY = 16
#: Texts of a bucket that meet in one go, about.
BLOCK = 4096
#: Registers that must agree before two texts of one bucket are compared: the
#: expected share at the threshold, less five standard deviations.
SLACK = 5.0


def weighted_shingles(column: pa.Array):
    """(row, shingle, weight) of all texts, by row; a shingle is a 48-bit digest.

    A text of one to four words has one shingle, all its words.
    """
    words = Words(*utf8(column, lower=True), NOT_SPACE)
    digests = words.digests()
    counts = words.counts
    grams = rolling(digests, SHINGLE)
    at = np.flatnonzero(words.row_ends()[: len(grams)] - np.arange(len(grams)) >= SHINGLE)
    row = np.searchsorted(words.bounds, at, "right") - 1
    grams = grams[at]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(counts == n)
        if len(short):
            whole = rolling(digests, n)[words.bounds[short]]
            row, grams = np.concatenate([row, short]), np.concatenate([grams, whole])
    key = (row.astype(np.uint64) << np.uint64(48)) | (grams >> np.uint64(16))
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), weight


def _uniform(shingle: np.ndarray, point: int) -> np.ndarray:
    return mix(shingle + np.uint64((point * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))


def sketch(rows: int, row: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """rows x REGISTERS digests of the earliest shingle per register."""
    earliest = np.full(rows * REGISTERS, np.inf)
    winner = np.zeros(rows * REGISTERS, np.uint64)
    time, point = np.zeros(len(shingle)), 0
    while len(shingle):
        bits = _uniform(shingle, point)
        register = ((bits & np.uint64(0xFFFF)) * np.uint64(REGISTERS) >> np.uint64(16)).astype(np.int64)
        time = time - np.log1p(-(bits >> np.uint64(16)).astype(np.float64) / 2.0**48) / weight
        cell = row * REGISTERS + register
        np.minimum.at(earliest, cell, time)
        won = earliest[cell] == time
        winner[cell[won]] = shingle[won]
        # early termination: no later point of a shingle can win once it is behind every register
        active = time < earliest.reshape(rows, REGISTERS).max(1)[row]
        row, shingle, weight, time, point = row[active], shingle[active], weight[active], time[active], point + 1
    return mix(winner).reshape(rows, REGISTERS)


def parity_maps(rows: int, row: np.ndarray, shingle: np.ndarray) -> np.ndarray:
    """rows x PARITY longs; each shingle turns one bit over."""
    bit = mix(shingle ^ np.uint64(0xA24BAED4963EE407)) >> np.uint64(64 - 6 - PARITY.bit_length() + 1)
    out = np.zeros(rows * PARITY, np.uint64)
    np.bitwise_xor.at(out, row * PARITY + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(rows, PARITY)


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).reshape(-1).view(np.int64)))


def _sketches(batches):
    for batch in text_slices(batches, "text", 1 << 19):
        row, shingle, weight = weighted_shingles(batch.column("text"))
        has = np.unique(row)
        if not len(has):
            continue
        own = np.searchsorted(has, row)
        registers = sketch(len(has), own, shingle, weight)
        band = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        keys = np.stack([mix(rolling_band(registers[:, i * ROWS : (i + 1) * ROWS]) ^ band[i]) for i in range(BANDS)], 1)
        packed = np.ascontiguousarray((registers & np.uint64(0xFF)).astype(np.uint8)).view(np.int64)
        size, total = np.bincount(own, minlength=len(has)), np.bincount(own, weight, len(has))
        out = [batch.column(c).take(pa.array(has)) for c in ("doc_id", "digest")]
        out += [_lists(keys), _lists(packed), _lists(parity_maps(len(has), own, shingle)), pa.array(size.astype(np.int32)), pa.array(total.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "digest", "bands", "registers", "parity", "size", "total"])


def rolling_band(registers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(registers), np.uint64)
    for j in range(registers.shape[1]):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + registers[:, j])
    return out


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum over shared d of 1 / sum over all e of max(wa[e] / wa[d], wb[e] / wb[d]); a and b sorted."""
    common, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    both, n = np.unique(np.stack([wa[ia], wb[ib]], 1), axis=0, return_counts=True)
    only_a, only_b = wa.sum() - wa[ia].sum(), wb.sum() - wb[ib].sum()
    total = 0.0
    for (x, y), k in zip(both, n):
        total += k / (np.maximum(both[:, 0] / x, both[:, 1] / y) @ n + only_a / x + only_b / y)
    return float(total)


def _verified(threshold: float):
    def run(batches):
        for batch in text_slices(batches, "text_a", 1 << 20):
            sides = []
            for name in ("text_a", "text_b"):
                row, shingle, weight = weighted_shingles(batch.column(name))
                sides.append((np.searchsorted(row, np.arange(batch.num_rows + 1)), shingle, weight.astype(np.float64)))
            (pa_, sa, wa), (pb_, sb, wb) = sides
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = slice(pa_[i], pa_[i + 1]), slice(pb_[i], pb_[i + 1])
                keep[i] = probability_jaccard(sa[p], wa[p], sb[q], wb[q]) >= threshold
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def may_reach(threshold: float, nx, tx, ny, ty, apart) -> np.ndarray:
    """Whether two texts of nx and ny shingles of weights tx and ty, of which at least `apart` are not shared, may be `threshold` alike.

    At most o = (nx + ny - apart) / 2 shingles are shared, and each other one weighs 1 at least, so
    P = (tx - nx + o) / tx of one text's weight and Q of the other's. The probability Jaccard is at most
    1 / (1 / P + 1 / Q - 1), which is the plain Jaccard where every weight is 1. What rounding leaves open is let through.
    """
    both = np.minimum(np.minimum(nx, ny), (nx + ny - apart) // 2)
    p, q = (tx - nx + both).astype(float), (ty - ny + both).astype(float)
    return (both > 0) & (tx * q + ty * p <= (1 + 1 / threshold + 1e-9) * p * q)


class Facts:
    """Sketch facts of a batch's rows as arrays, from a struct column of registers, parity, size and total."""

    def __init__(self, column: pa.Array):
        parts = dict(zip([f.name for f in column.type], column.flatten()))
        longs = lambda name, width: parts[name].flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, width)
        self.registers, self.parity = longs("registers", PACKED), longs("parity", PARITY)
        self.size, self.total = (parts[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "total"))


def _alike(x: Facts, i, y: Facts, j, threshold: float) -> np.ndarray:
    """Both tests on the pairs (i, j), arrays of places that numpy can spread over each other: first the bound, then the registers of what is left."""
    apart = np.zeros(np.broadcast(i, j).shape, np.int64)
    for lane in range(PARITY):
        apart += np.bitwise_count(x.parity[i, lane] ^ y.parity[j, lane])
    may = may_reach(threshold, x.size[i], x.total[i], y.size[j], y.total[j], apart)
    i, j = (np.broadcast_to(k, may.shape)[may] for k in (i, j))
    least = REGISTERS * (threshold - SLACK * np.sqrt(threshold * (1 - threshold) / REGISTERS))
    same = (x.registers[i].view(np.uint8) == y.registers[j].view(np.uint8)).sum(1)
    may[may] = same >= least
    return may


def _possible(threshold: float):
    def run(batches):
        for batch in batches:
            x, y = Facts(batch.column("x")), Facts(batch.column("y"))
            at = np.arange(batch.num_rows)
            yield batch.select(["a", "b"]).filter(pa.array(_alike(x, at, y, at, threshold)))

    return run


def _meetings(threshold: float):
    """Of rows sorted by group: the pairs of a group that are of different parts and pass both tests.

    A group is one block of a bucket (i = j), or two, which meet each other. Blocks are of bounded size.
    """

    def pairs(group: pa.RecordBatch):
        facts = Facts(group.column("facts"))
        part, block = (group.column(c).to_numpy(zero_copy_only=False) for c in ("part", "block"))
        left = np.flatnonzero(block == block.min())
        right = np.flatnonzero(block == block.max())
        one = block.min() == block.max()
        if one and group.column("i")[0] != group.column("j")[0]:
            return
        step = max(1, (1 << 19) // len(right))
        for k in range(0, len(left), step):
            i, j = left[k : k + step, None], right[None, :]
            may = part[i] != part[j]
            if one:
                may &= i < j
            at = np.nonzero(may)
            ok = _alike(facts, i[at[0], 0], facts, j[0, at[1]], threshold)
            if ok.any():
                ids = group.column("doc_id")
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i[at[0], 0][ok])), ids.take(pa.array(j[0, at[1]][ok]))], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bucket", "i", "j")], 1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            bounds = [0, *edges.tolist()]
            for lo, hi in zip(bounds, bounds[1:]):
                if hi - lo > 1:
                    yield from pairs(batch.slice(lo, hi - lo))
            held = batch.slice(bounds[-1])
        if held is not None and held.num_rows > 1:
            yield from pairs(held)

    return run


def _checked(pairs: DataFrame, docs: DataFrame, threshold: float, kind: str) -> DataFrame:
    """The (a, b) pairs whose texts are alike. Texts in no pair are screened out where they lie."""
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct().select(F.xxhash64("id").alias("key"))
    texts = screened(docs.select("doc_id", "text", F.xxhash64("doc_id").alias("key")), screen(ids, 2 * pairs.count()), "key", f"doc_id {kind}, text string")
    joined = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(_verified(threshold), f"a {kind}, b {kind}")


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id): each document with the least doc_id of its class.

    Classes are the connected components of the links of `threshold` and more.
    Takes `doc_id` and `text`; words are lower-cased runs of other than white
    space. Equal texts are always one class, except texts without a word and
    null texts: these stay alone, as do rows with a null doc_id, whose class is
    null. Rows that repeat a doc_id give one row, of a class that holds all their
    texts. Other columns are left aside.
    """
    docs = docs.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    schema = f"doc_id {kind}, digest binary, bands array<long>, registers array<long>, parity array<long>, size int, total int"
    sketches = stage(known.select("doc_id", F.unhex(F.md5("text")).alias("digest"), "text").mapInArrow(_sketches, schema), "sketches")

    # tables of their own, so that joins on them can split a hot text or bucket
    shared = stage(sketches.groupBy("digest").agg(F.min("doc_id").alias("original"), F.count("*").alias("n")).where("n > 1").select("digest", "original"), "shared")
    copies = stage(sketches.select("doc_id", "digest").join(shared, "digest").where("doc_id <> original").select("doc_id", "original"), "copies")
    several = sketches.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    tied = stage(copies.join(several, "doc_id").select(F.col("original").alias("a"), F.col("doc_id").alias("b")), "tied")

    first = sketches.join(shared, "digest", "left").where("original is null or original = doc_id")
    entries = first.select("doc_id", F.explode("bands").alias("bucket"))
    full = stage(entries.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("bucket", "n"), "full")
    entries = stage(entries.join(full, "bucket"), "entries")
    facts = stage(sketches.join(entries.select("doc_id").distinct(), "doc_id").select("doc_id", F.struct("registers", "parity", "size", "total").alias("facts")), "facts")
    unstage(sketches, shared, full)
    # the centre of a bucket is the text that meets most others in all its buckets: of near copies, the least changed
    met = entries.groupBy("doc_id").agg(F.sum("n").alias("met"))
    centres = stage(entries.join(met, "doc_id").groupBy("bucket").agg(F.max_by("doc_id", F.struct("met", "doc_id")).alias("centre")), "centres")
    stars = entries.join(centres, "bucket").where("doc_id <> centre").select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")).distinct()
    of = lambda name, id_: facts.select(F.col("doc_id").alias(id_), F.col("facts").alias(name))
    met = stars.join(of("x", "a"), "a").join(of("y", "b"), "b").select("a", "b", "x", "y")
    stars = stage(met.mapInArrow(_possible(threshold), f"a {kind}, b {kind}").distinct(), "stars")
    links = stage(_checked(stars, known, threshold, kind).unionAll(tied), "verified")
    parts = stage(connected_components(links, "a", "b"), "parts")

    # buckets that hold several components still
    placed = stage(entries.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("part")), "placed")
    sizes = placed.groupBy("bucket", "part").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("bucket").agg(F.sum("size").alias("n"), F.count("*").alias("parts")).where("parts > 1").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    mixed = stage(mixed, "mixed")
    unstage(entries, centres)
    # a text of block k meets its own block and all others: groups (i, j) with i <= j
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    open_ = placed.join(mixed, "bucket").select("bucket", "doc_id", F.xxhash64("part").alias("part"), block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    open_ = open_.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "part").join(facts, "doc_id")
    groups = open_.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").select("bucket", "i", "j", "block", "doc_id", "part", "facts")
    found = groups.mapInArrow(_meetings(threshold), f"a {kind}, b {kind}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = found.join(stars, ["a", "b"], "left_anti")
    rest = stage(rest, "rest")
    unstage(placed, mixed, stars, facts)
    more = stage(_checked(rest, known, threshold, kind), "more")
    whole = parts if more.isEmpty() else connected_components(links.unionAll(more), "a", "b")
    members = docs.where("doc_id is not null").select("doc_id").distinct().join(copies.groupBy("doc_id").agg(F.min("original").alias("original")), "doc_id", "left").withColumn("original", F.coalesce("original", "doc_id"))
    classed = members.join(whole.withColumnRenamed("node", "original"), "original", "left").select("doc_id", F.coalesce("component", "original").alias("class_id"))
    nulls = docs.where("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return classed.unionAll(nulls)
