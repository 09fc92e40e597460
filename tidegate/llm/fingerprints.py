"""Document fingerprints as invertible Bloom lookup sketches.

A text's units (its lines; long lines in blocks) are digested, and each digest is
put into one cell of each of three tables: a count, a sum of digests under
exclusive or, and one of check digests. Sketches of two versions subtract cell by
cell; what they share vanishes, and peeling cells that hold a single digest
recovers the differing ones. Where peeling gets stuck, the pair is sketched again
larger. DataFrame operations only; a text meets none but its neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TABLES, CELLS = 3, 16
#: Code points of a unit at most.
UNIT = 120
CELL = "struct<n:int,k:bigint,h:bigint>"
#: Peeling rounds; each takes all single digests at once, so chains are short.
ROUNDS = 8
#: Cells per digest and table when a pair is sketched again.
LARGER = 64
#: Buckets in which documents are put in order to find each one's neighbour, at least and at most.
BUCKETS, MOST_BUCKETS = 200, 4096


def unit_digests(text: Column) -> Column:
    """Digests of a text's units, sorted. Of equal ones each gets a digest of its number, so they form a set."""
    units = F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{UNIT}}}"), 0)
    ranked = F.array_sort(F.transform(units, lambda u: F.xxhash64(u)))

    def numbered(r: Column) -> Column:
        return F.transform(r, lambda d, i: F.when((i > 0) & (F.get(r, i - 1) == d), F.xxhash64(d, i - F.array_position(r, d))).otherwise(d))

    # an array of one, so that the sorted digests are made once and not for each of them
    return F.transform(F.array(ranked), numbered)[0]


def check(d: Column) -> Column:
    return F.xxhash64(d, F.lit(77))


def slot(d: Column, table: int) -> Column:
    """The cell of a digest in a table: another part of its bits for each."""
    return F.pmod(F.shiftrightunsigned(d, 7 + 19 * table), F.lit(CELLS)).cast("int")


def cells(digests: Column) -> Column:
    """The sketch of a set of digests: TABLES x CELLS cells."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))

    def put(cell: Column, d: Column) -> Column:
        return F.struct((cell["n"] + 1).alias("n"), cell["k"].bitwiseXOR(d).alias("k"), cell["h"].bitwiseXOR(check(d)).alias("h"))

    def part(t: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda c: F.aggregate(F.filter(digests, lambda d: slot(d, t) == c), empty, put))

    return F.concat(*[part(t) for t in range(TABLES)])


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def _round(state: Column) -> Column:
    """One peeling round: the digests alone in a cell are listed and taken out of their cells."""
    alone = F.array_distinct(
        F.transform(
            F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["h"] == check(c["k"]))),
            lambda c: F.struct(c["k"].alias("k"), c["n"].alias("n")),
        )
    )

    def without(singles: Column) -> Column:
        return F.transform(
            state["cells"],
            lambda c, i: F.aggregate(
                F.filter(singles, lambda s: (slot_of(s["k"], i))),
                c,
                lambda x, s: F.struct((x["n"] - s["n"]).alias("n"), x["k"].bitwiseXOR(s["k"]).alias("k"), x["h"].bitwiseXOR(check(s["k"])).alias("h")),
            ),
        )

    return F.struct(F.transform(F.array(alone), without)[0].alias("cells"), (state["found"] + F.size(alone)).alias("found"))


def slot_of(k: Column, place: Column) -> Column:
    """Whether a digest lies in the cell at `place`."""
    out = F.lit(False)
    for t in range(TABLES):
        out = out | (place == slot(k, t) + t * CELLS)
    return out


def peel(difference: Column) -> Column:
    """How many digests differ, or null where peeling gets stuck."""
    start = F.struct(F.transform(difference, lambda c: c).alias("cells"), F.lit(0).alias("found"))
    end = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        lambda s, _: F.when(F.exists(s["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["h"] == check(c["k"]))), _round(s)).otherwise(s),
        lambda s: F.when(F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0)), s["found"]),
    )
    return end


def peel_larger(a: Column, b: Column) -> Column:
    """How many digests differ, from larger sketches: LARGER cells per digest and table, then its square and so on.

    With so many cells nearly every differing digest is alone in one of its
    cells of two tables, so one round of peeling does; that none was missed
    shows in the sums of digests and checks. Should the fourth size fail too (a chance below 1e-12 for a
    million digests), all digests count as different. Only filled cells are formed, by
    summing digests in order of their cell.
    """
    both = F.size(a) + F.size(b)
    zero = F.lit(0).cast("long")
    xor_all = lambda x, of: F.aggregate(x, zero, lambda s, d: s.bitwiseXOR(of(d)))

    def closed(s: Column) -> Column:
        """The list with the current cell's digest, if it holds a single one."""
        return F.when((F.abs(s["n"]) == 1) & (s["h"] == check(s["k"])), F.concat(s["done"], F.array(s["k"]))).otherwise(s["done"])

    def add(s: Column, e: Column) -> Column:
        fresh = F.struct(closed(s).alias("done"), e["p"].alias("p"), e["n"].alias("n"), e["k"].alias("k"), check(e["k"]).alias("h"))
        more = F.struct(
            s["done"].alias("done"), s["p"].alias("p"), (s["n"] + e["n"]).alias("n"), s["k"].bitwiseXOR(e["k"]).alias("k"), s["h"].bitwiseXOR(check(e["k"])).alias("h")
        )
        return F.when(s["p"] == e["p"], more).otherwise(fresh)

    def singles(t: int, factor: int) -> Column:
        def entry(sign: int):
            return lambda d: F.struct(F.pmod(F.xxhash64(d, F.lit(t)), both * factor).alias("p"), d.alias("k"), F.lit(sign).alias("n"))

        entries = F.array_sort(F.concat(F.transform(a, entry(1)), F.transform(b, entry(-1))))
        start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(-1).cast("long").alias("p"), F.lit(0).alias("n"), zero.alias("k"), zero.alias("h"))
        return F.aggregate(entries, start, add, closed)

    def tried(factor: int) -> Column:
        found = F.array_distinct(F.concat(singles(factor, factor), singles(factor + 1, factor)))

        def whole(f: Column) -> Column:
            none_missed = (xor_all(f, lambda d: d) == xor_all(a, lambda d: d).bitwiseXOR(xor_all(b, lambda d: d))) & (
                xor_all(f, check) == xor_all(a, check).bitwiseXOR(xor_all(b, check))
            )
            return F.when(none_missed, F.size(f))

        return F.transform(F.array(found), whole)[0]

    return F.coalesce(*[tried(LARGER**n) for n in (1, 2, 3, 4)], both)


def likeness(a: Column, b: Column, fa: Column, fb: Column) -> Column:
    """Share of units that two texts have in common, 0 to 1, from their sketches; two empty texts are alike."""
    differ = F.when(fa == fb, F.lit(0)).otherwise(F.coalesce(peel(subtract(fa, fb)), peel_larger(a, b)))
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise((both - differ) / (both + differ)).cast("double")


def fingerprint(sketch: Column) -> Column:
    """A sketch as text: each cell's count, digest sum and check sum in hexadecimal, empty cells as `-`."""
    return F.array_join(F.transform(sketch, lambda c: F.when((c["n"] == 0) & (c["k"] == 0), "-").otherwise(F.concat_ws(".", F.hex(c["n"]), F.hex(c["k"]), F.hex(c["h"])))), " ")


def _longs(values: list[int]) -> Column:
    return F.expr("array(" + ", ".join(f"{v}L" for v in values) + ")") if values else F.array().cast("array<bigint>")


def _bucket(key: Column, borders: list[int]) -> Column:
    """How many borders are not above the key, found by a coarse step and a fine one."""
    step = max(1, int(len(borders) ** 0.5))
    below = lambda values: F.size(F.filter(values, lambda b: b <= key))
    parts = [borders[i + 1 : i + step] for i in range(0, len(borders), step)]
    fine = F.array(*[_longs(p) for p in [[], *parts]])
    return F.transform(F.array(below(_longs(borders[::step]))), lambda i: F.when(i == 0, 0).otherwise((i - 1) * step + 1 + below(F.get(fine, i))))[0]


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with `next_<column>` of the next one by descending doc_id; the last one's next is the first.

    Documents are dealt to buckets of consecutive ids, and the last of each
    bucket also to the bucket that follows it, so neighbours meet without putting
    all rows in one task. There are BUCKETS, or twice the session's shuffle
    partitions up to MOST_BUCKETS; only their borders and last ids reach the
    driver and are broadcast. Rows of equal doc_id follow each other by text;
    null ids count as lowest.
    """
    spark = docs.sparkSession
    n = min(MOST_BUCKETS, max(BUCKETS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62)))
    ids = docs.select(key.alias("key"))
    # a border is a plain number; ids that share one are in one bucket
    borders = sorted(set(map(int, ids.approxQuantile("key", [i / n for i in range(1, n)], 0.25 / n) or [])))
    placed = docs.select(*columns, key.alias("key"), _bucket(key, borders).alias("bucket"))
    tops = sorted(tuple(r) for r in placed.groupBy("bucket").agg(F.max("key").alias("top")).collect())
    wraps = tops[-1][1] if tops else None
    follows = ", ".join(f"named_struct('top', {top}L, 'to', {tops[(i + 1) % len(tops)][0]})" for i, (_, top) in enumerate(tops))
    guests = spark.range(1).select(F.inline(F.expr(f"array({follows})" if follows else "cast(array() as array<struct<top:bigint,to:int>>)")))
    dealt = placed.join(F.broadcast(guests), F.col("key") == F.col("top"), "left").withColumn(
        "place", F.explode(F.array_compact(F.array(F.struct("bucket", F.lit(False).alias("guest")), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("bucket"), F.lit(True).alias("guest"))))))
    )
    # ascending: the row before is the next by descending id; guests come first, the wrapped one before all
    wrapped = F.col("place.guest") & (F.col("key") == F.lit(wraps)) if wraps is not None else F.lit(False)
    order = Window.partitionBy("place.bucket").orderBy(F.desc("place.guest"), F.desc(wrapped), "key", *columns)
    return dealt.select(*columns, "place", *[F.lag(c).over(order).alias(f"next_{c}") for c in columns]).where("not place.guest").drop("place")


def compare_versions(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document.

    The edited text has the last third of the code points replaced by the first
    as many of the next document's (all, if it has fewer). Null counts as empty.
    An empty text has no units. Repeated rows give a row each and are each
    other's neighbours. Other columns are left aside.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, ["doc_id", "text"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("third", F.floor(F.length("text") / 3).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - third)"), F.expr("substring(next_text, 1, third)")))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        unit_digests(F.col("text")).alias("a"), unit_digests(F.col("edited")).alias("b"), unit_digests(F.col("next_text")).alias("c"),
    )
    rows = rows.withColumns({"fa": cells(F.col("a")), "fb": cells(F.col("b")), "fc": cells(F.col("c"))})
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint(F.col("fa")).alias("fingerprint"), fingerprint(F.col("fb")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b"), F.col("fa"), F.col("fb")).alias("near_edited"),
        likeness(F.col("a"), F.col("c"), F.col("fa"), F.col("fc")).alias("near_next"),
    )
