"""Language identification by interpolated Kneser-Ney character models.

One model of characters per language, all kept in one sorted array of n-gram
codes per order with a column of log probabilities per language, and one of
contexts with their back-off weights. A text's language is the one with the
lowest cross-entropy per character. A text is rejected where even that is
higher than held-back labelled texts of the language ever come to.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegate.llm.text_arrays import text_slices

ORDER = 4
#: Bound of the training sample: labelled texts of each language for the model, and more for calibration.
SAMPLE, CALIBRATION = 400, 100
#: A code has 16 bits for a letter. Of a sample with more letters, those that fewest of its texts hold count as one unknown letter.
MOST_LETTERS = 65_000
#: Rejection: so many times the spread of held-back texts above their mean.
SPREADS = 6.0
#: A language with fewer held-back texts than this has no spread of its own to go by.
FEW = 10
UNKNOWN = "und"
_SALTS = 64


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = [t or "" for t in column.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def _letters() -> np.ndarray:
    """Of each code point its lower-case letter's code point, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_cache: dict = {}


def letters() -> np.ndarray:
    if "letters" not in _cache:
        _cache["letters"] = _letters()
    return _cache["letters"]


def symbols(column: pa.Array, alphabet: np.ndarray):
    """Symbols of all texts: 0 for a run of other than letters (and before each text), 1 for a letter not in `alphabet`."""
    codes, offsets = code_points(column)
    low = letters()[codes]
    size = len(alphabet)
    at = np.searchsorted(alphabet, low)
    sym = np.where(alphabet[np.minimum(at, size - 1)] == low, at + 2, 1).astype(np.uint16)
    sym[low == 0] = 0
    count = np.add.reduceat(np.append(low != 0, False), offsets[:-1]) if len(offsets) > 1 else np.zeros(0, int)
    count[np.diff(offsets) == 0] = 0
    # a 0 before each text, then runs of 0 to one
    out = np.insert(sym, offsets[:-1], 0)
    bounds = offsets + np.arange(len(offsets))
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    keep[bounds[:-1]] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], place[bounds], count


def codes_of(sym: np.ndarray, order: int) -> np.ndarray:
    """The code of the `order` symbols that end at each place, 16 bits each; places before the first count as 0."""
    out = sym.astype(np.uint64)
    for j in range(1, order):
        out[j:] |= sym[:-j].astype(np.uint64) << np.uint64(16 * j)
    return out


class Model:
    """Sorted n-gram codes with log probabilities, and contexts with back-off weights, of all languages."""

    def __init__(self, languages: list[str], alphabet: np.ndarray, counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        """counts: of each order the sorted codes and a row of counts per code, a column for each language."""
        self.languages, self.alphabet = languages, alphabet
        n_lang, size = len(languages), len(alphabet) + 2
        self.grams, self.logp, self.contexts, self.logb = {}, {}, {}, {}
        lower = None
        for order in range(1, ORDER + 1):
            codes, raw = counts[order]
            if order < ORDER:  # in how many ways it is continued to the left
                longer, have = counts[order + 1]
                tail = longer & np.uint64((1 << (16 * order)) - 1)
                kinds = np.zeros_like(raw, dtype=np.float64)
                np.add.at(kinds, np.searchsorted(codes, tail), have > 0)
            else:
                kinds = raw.astype(np.float64)
            once, two = (kinds == 1).sum(0), (kinds == 2).sum(0)
            discount = np.clip(np.where(once + 2 * two > 0, once / np.maximum(once + 2 * two, 1), 0.5), 0.1, 0.9)
            context = codes >> np.uint64(16)
            unique, where = np.unique(context, return_inverse=True)
            total = np.zeros((len(unique), n_lang))
            followers = np.zeros((len(unique), n_lang))
            np.add.at(total, where, kinds)
            np.add.at(followers, where, kinds > 0)
            back = np.where(total > 0, discount * followers / np.maximum(total, 1), 1.0)
            base = np.full((len(codes), n_lang), 1 / size) if order == 1 else np.exp(lower(codes & np.uint64((1 << (16 * (order - 1))) - 1), order - 1))
            p = np.maximum(kinds - discount, 0) / np.maximum(total, 1)[where] + back[where] * base
            self.grams[order], self.logp[order] = codes, np.log(p).astype(np.float32)
            self.contexts[order], self.logb[order] = unique, np.log(back).astype(np.float32)
            lower = self.lookup
        self.uniform = np.float32(-np.log(size))

    def lookup(self, codes: np.ndarray, order: int) -> np.ndarray:
        """Log probabilities (codes x languages) of the last symbol after those before it."""
        if order == 0:
            return np.full((len(codes), len(self.languages)), self.uniform if hasattr(self, "uniform") else -np.log(len(self.alphabet) + 2), np.float32)
        grams = self.grams[order]
        at = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
        out = self.logp[order][at]
        lost = np.flatnonzero(grams[at] != codes)
        if len(lost):
            missing = codes[lost]
            contexts = self.contexts[order]
            context = missing >> np.uint64(16)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            back = np.where((contexts[at] == context)[:, None], self.logb[order][at], np.float32(0))
            out[lost] = back + self.lookup(missing & np.uint64((1 << (16 * (order - 1))) - 1), order - 1)
        return out

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per letter of each text and language, number of letters)."""
        sym, bounds, count = symbols(column, self.alphabet)
        if not len(sym):
            return np.zeros((len(count), len(self.languages))), count
        codes = codes_of(sym, ORDER)
        for j in range(1, ORDER):  # nothing is seen beyond a text's start
            at = bounds[:-1] + j - 1
            at = at[at < bounds[1:]]
            codes[at] &= np.uint64((1 << (16 * j)) - 1)
        value = self.lookup(codes, ORDER)
        value[bounds[:-1][bounds[:-1] < bounds[1:]]] = 0
        total = -np.add.reduceat(value.astype(np.float64), bounds[:-1], axis=0)
        return total / np.maximum(np.diff(bounds) - 1, 1)[:, None], count


def labelled_sample(docs: DataFrame, where: Column) -> DataFrame:
    """At most SAMPLE + CALIBRATION labelled texts of each language, those of least hash; `held` marks the latter."""
    order = F.xxhash64("doc_id")
    ids = docs.where(where & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    most = SAMPLE + CALIBRATION
    first = Window.partitionBy("lang", F.pmod(F.hash("doc_id"), F.lit(_SALTS))).orderBy(order, "doc_id")
    ids = ids.withColumn("n", F.row_number().over(first)).where(f"n <= {most}").drop("n")
    second = Window.partitionBy("lang").orderBy(order, "doc_id")
    ids = ids.withColumn("n", F.row_number().over(second)).where(f"n <= {most}").select("doc_id", ((F.col("n") % (most // CALIBRATION)) == 0).alias("held"))
    # a sample of bounded size
    return docs.where(where & F.col("lang").isNotNull()).select("doc_id", "lang", "text").join(F.broadcast(ids.dropDuplicates(["doc_id"])), "doc_id")


def train(docs: DataFrame, where: Column):
    """The model and, per language, (mean, spread between texts, spread per letter) of held-back texts.

    Spark counts the n-grams; what reaches the driver is the count table of the
    bounded sample. A language with under FEW held-back texts is accepted up to halfway
    between its labelled texts' middle entropy and that of letters drawn at random, or up to
    the highest of its labelled texts if that is more.
    Returns None if no labelled text has a letter.
    """
    rows = labelled_sample(docs, where).persist()
    try:
        languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
        used = rows.where("not held").select("lang", "text")
        if not languages or used.isEmpty():
            used = rows.select("lang", "text")
        seen = used.select(F.explode(F.array_distinct(F.split(F.lower("text"), ""))).alias("c")).where("length(c) = 1").groupBy("c").count()
        wide = [r[0] for r in seen.orderBy(F.desc("count"), "c").limit(MOST_LETTERS).collect()]
        alphabet = np.unique(letters()[[ord(c) for c in wide]]) if wide else np.zeros(0, np.uint32)
        alphabet = alphabet[alphabet > 0]
        if not len(alphabet):
            return None
        index = {x: i for i, x in enumerate(languages)}

        def count(batches):
            for batch in text_slices(batches, "text"):
                lang = np.array([index[x] for x in batch.column("lang").to_pylist()])
                sym, bounds, _ = symbols(batch.column("text"), alphabet)
                of = np.repeat(lang, np.diff(bounds))
                begin = np.zeros(len(sym), bool)
                begin[bounds[:-1]] = True
                codes = codes_of(sym, ORDER)
                for j in range(1, ORDER):
                    at = bounds[:-1] + j - 1
                    codes[at[at < bounds[1:]]] &= np.uint64((1 << (16 * j)) - 1)
                for order in range(1, ORDER + 1):
                    part = codes & np.uint64((1 << (16 * order)) - 1)
                    for x in np.unique(lang):
                        value, n = np.unique(part[(of == x) & ~begin], return_counts=True)
                        cols = [np.full(len(value), order, np.int32), np.full(len(value), x, np.int32), value.view(np.int64), n.astype(np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["n", "lang", "code", "seen"])

        table = used.mapInArrow(count, "n int, lang int, code long, seen long").groupBy("n", "lang", "code").agg(F.sum("seen").alias("seen")).toArrow()
        n, lang, code, seen = (table.column(c).to_numpy() for c in ("n", "lang", "code", "seen"))
        counts = {}
        for order in range(1, ORDER + 1):
            own = n == order
            codes, where_ = np.unique(code[own].view(np.uint64), return_inverse=True)
            grid = np.zeros((len(codes), len(languages)), np.int64)
            grid[where_, lang[own]] = seen[own]
            counts[order] = (codes, grid)
        model = Model(languages, alphabet, counts)
        held = rows.where("held").select("lang", "text").toArrow()

        def own_values(table):
            """(language, entropy under its own model, letters) of the texts that have letters."""
            if not table.num_rows:
                return np.zeros(0, int), np.zeros(0), np.zeros(0)
            entropy, size = model.entropies(table.column("text").combine_chunks())
            own = np.array([index[x] for x in table.column("lang").to_pylist()])
            return own[size > 0], entropy[np.arange(len(own)), own][size > 0], size[size > 0]

        limits = np.zeros((len(languages), 3))
        own, value, count_ = own_values(held)
        few = [x for x in range(len(languages)) if (own == x).sum() < FEW]
        for x in set(range(len(languages))) - set(few):
            mine = own == x
            mean = np.median(value[mine])
            off, size = np.abs(value[mine] - mean), count_[mine]
            long = size >= np.median(size)
            limits[x] = mean, max(np.quantile(off[long], 0.9), 0.02), np.quantile(off * np.sqrt(size), 0.9)
        if few:  # less than FEW * (SAMPLE + CALIBRATION) / CALIBRATION texts each
            own, value, _ = own_values(rows.where(F.col("lang").isin([languages[x] for x in few])).select("lang", "text").toArrow())
            for x in few:
                mine = value[own == x] if (own == x).any() else np.zeros(1)
                mean = np.median(mine)
                limits[x] = mean, max((-float(model.uniform) - mean) / 2, mine.max() - mean, 0.02) / SPREADS, 0.0
        return model, limits
    finally:
        rows.unpersist()


def identify(docs: DataFrame, trained, keep_columns: bool = True) -> DataFrame:
    """`docs` with lang_pred, score (0 to 1) and accepted.

    A text that is null or without a letter is `und`, score 0, not accepted; so
    is every text where there was nothing to learn from. Each row is judged by
    itself; columns of `docs` with those names give way to the results.
    """
    names = [c for c in (docs.columns if keep_columns else ["doc_id"]) if c not in ("lang_pred", "score", "accepted")]
    kinds = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(trained)

    def run(batches):
        trained = shared.value
        for batch in text_slices(batches, "text", 1 << 18):
            size = batch.num_rows
            pred, score, ok = [UNKNOWN] * size, np.zeros(size), np.zeros(size, bool)
            if trained:
                model, limits = trained
                entropy, count = model.entropies(batch.column("text"))
                some = np.flatnonzero(count > 0)
                best = entropy.argmin(1)
                for i in some:
                    pred[i] = model.languages[best[i]]
                low = entropy.min(1)
                if len(model.languages) > 1:
                    gap = np.partition(entropy, 1, axis=1)[:, 1] - low
                    score[some] = (1 / (1 + np.exp(-gap * np.minimum(count, 100))))[some]
                else:
                    score[some] = 1.0
                mean, spread, letter = limits[best].T
                ok[some] = (low <= mean + SPREADS * (spread + letter / np.sqrt(np.maximum(count, 1))))[some]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(pred, pa.string()), pa.array(score), pa.array(ok)], [*names, "lang_pred", "score", "accepted"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "lang_pred string, score double, accepted boolean"])
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
