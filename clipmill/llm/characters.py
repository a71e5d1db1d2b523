"""Modified Kneser-Ney model of characters by code points, all n-grams kept, as tables that are joined to blocks of documents.

An n-gram of ``ORDER`` characters is two numbers, ``a`` and ``b``, of two code points each: exact, nothing folded or hashed. Before a text
stand blanks. Shorter n-grams fill the numbers from the right. What is counted per block of documents is every different n-gram of
the block; the model is made of aggregates and joins of these; its values go back to each block that holds the n-gram. A task has the
n-grams of one block in memory, as arrays sorted by n-gram.

An occurrence does not count for itself: with its own taken off, a count of one leaves no n-gram, and then its shorter n-gram has one
continuation less, down to the single characters. So a text cannot make its own oddities likely.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.dataset
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmill.llm.words import buffers, pieces
from clipmill.session import new_path, stored

ORDER, BITS = 4, 21
LOW = (1 << BITS) - 1
BEFORE = np.uint64(0x20)
#: Bits of the first byte of a character of one to four bytes.
LEAD = np.array([0, 0xFF, 0x1F, 0x0F, 0x07], np.uint32)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the n + 1 offsets of the texts in them."""
    first = (data & 0xC0) != 0x80
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(first)
    lead = data[at]
    size = 1 + (lead >= 0xC0).astype(np.int8) + (lead >= 0xE0) + (lead >= 0xF0)
    out = lead & LEAD[size]
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        out[longer] = out[longer] << 6 | data[np.minimum(at[longer] + k, len(data) - 1)] & 0x3F
    return out, np.searchsorted(at, offsets)


def pairs(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of the n-gram that ends at each character."""
    line = points.astype(np.uint64)
    place = np.arange(len(line)) - np.repeat(offsets[:-1], np.diff(offsets))

    def before(k):
        out = np.full(len(line), BEFORE)
        inside = np.flatnonzero(place >= k)
        out[inside] = line[inside - k]
        return out

    shift = np.uint64(BITS)
    return before(3) << shift | before(2), before(1) << shift | line


def distinct(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) of the different n-grams, which of them ends at each character, and how often each occurs."""
    a, b = pairs(points, offsets)
    seen = np.zeros(1 << BITS, bool)
    seen[points] = True
    seen[int(BEFORE)] = True
    alphabet = np.flatnonzero(seen).astype(np.uint64)
    bits = max(1, (len(alphabet) - 1).bit_length())
    if ORDER * bits <= 64:
        number = np.zeros(1 << BITS, np.uint64)
        number[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
        low, step = np.uint64(LOW), np.uint64(bits)
        key = number[a >> np.uint64(BITS)]
        for part in (a & low, b >> np.uint64(BITS), b & low):
            key = key << step | number[part]
        if ORDER * bits <= 32:
            key = key.astype(np.uint32)
        found, place, n = np.unique(key, return_inverse=True, return_counts=True)
        found = found.astype(np.uint64)
        letter = lambda k: alphabet[found >> np.uint64(k * bits) & np.uint64((1 << bits) - 1)]
        return letter(3) << np.uint64(BITS) | letter(2), letter(1) << np.uint64(BITS) | letter(0), place, n
    left, i = np.unique(a, return_inverse=True)
    right, j = np.unique(b, return_inverse=True)
    found, place, n = np.unique(i.astype(np.uint64) << np.uint64(32) | j.astype(np.uint64), return_inverse=True, return_counts=True)
    return left[found >> np.uint64(32)], right[found & np.uint64(0xFFFFFFFF)], place, n


def runs(batch: pa.RecordBatch, block: str, text: str, piece: int):
    """(block, rows of it) in order, about ``piece`` bytes of text at a time."""
    numbers = batch.column(batch.schema.get_field_index(block)).to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            for part in pieces(batch.slice(lo, hi - lo), text, piece):
                yield int(numbers[lo]), part


def block_grams(rows: DataFrame, block: str, text: str, piece: int) -> DataFrame:
    """(block, a, b, n): the n-grams of each block. A block that two tasks read may have two rows of an n-gram."""

    def added(block, held):
        a, b, n = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        n = np.add.reduceat(n, start) if len(a) else n
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(start), block, np.int64)), *(pa.array(x[start].astype(np.int64)) for x in (a, b)), pa.array(n.astype(np.int64))],
            names=["block", "a", "b", "n"])

    def run(batches):
        at, held = None, []
        for batch in batches:
            for number, part in runs(batch, "block", "text", piece):
                if number != at and held:
                    yield added(at, held)
                    held = []
                at = number
                a, b, _, n = distinct(*code_points(*buffers(part.column(part.schema.get_field_index("text")))))
                held.append((a, b, n))
        if held:
            yield added(at, held)

    plain = rows.select(F.col(block).alias("block"), F.col(text).alias("text"))
    return stored(plain.mapInArrow(run, "block long, a long, b long, n long"), "lm-grams", "zstd")


def _end(k: int) -> list[Column]:
    """(a, b) of the last ``k`` characters of an n-gram."""
    low = lambda c, n: F.col(c).bitwiseAND((1 << BITS * n) - 1)
    return [low("a", max(k - 2, 0)).alias("a"), low("b", min(k, 2)).alias("b")]


def _context() -> list[Column]:
    """(ca, cb): all characters of an n-gram but the last."""
    moved = F.shiftleft(F.col("a").bitwiseAND(LOW), BITS).bitwiseOR(F.shiftright("b", BITS))
    return [F.shiftright("a", BITS).alias("ca"), moved.alias("cb")]


def discounts(level: DataFrame) -> tuple[int, tuple[float, float, float]]:
    """Number of n-grams and what is taken off counts of one, two, and three or more."""
    size, *n = level.agg(F.count(F.lit(1)), *[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first()
    if min(n) == 0:
        return size, (0.5, 1.0, 1.5)
    y = n[0] / (n[0] + 2 * n[1])
    return size, tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(a, b, p, logp) of counts (a, b, n): probability of the last character of every n-gram after the others, and the log of it with one occurrence taken off.

    Shorter n-grams count the different characters before them. Below single characters all known ones and one unknown are alike.
    """
    levels = {ORDER: stored(counts, "lm-counts", "zstd")}
    for order in range(ORDER - 1, 0, -1):
        levels[order] = stored(levels[order + 1].groupBy(*_end(order)).agg(F.count(F.lit(1)).alias("n")), "lm-counts", "zstd")
    lower = None
    for order in range(1, ORDER + 1):
        size, (d1, d2, d3) = discounts(levels[order])
        off = lambda n: F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        grown = levels[order].select("a", "b", "n", *_context())
        sums = grown.groupBy("ca", "cb").agg(F.sum("n").alias("total"), F.sum(off(F.col("n"))).alias("held"))
        grown = grown.join(sums, ["ca", "cb"])
        if lower is None:
            base = F.lit(1.0 / (size + 1))
            grown = grown.withColumn("below", base).withColumn("below_less", base)
        else:
            shorter = lower.select(F.col("a").alias("sa"), F.col("b").alias("sb"), F.col("p").alias("below"), F.col("less").alias("below_less"))
            sa, sb = _end(order - 1)
            grown = grown.join(shorter, (sa == F.col("sa")) & (sb == F.col("sb")))
        n, total, held = F.col("n"), F.col("total"), F.col("held")
        p = (n - off(n) + held * F.col("below")) / total
        left = held - off(n) + off(n - 1)
        less = (
            F.when(n > 1, (n - 1 - off(n - 1) + left * F.col("below")) / (total - 1))
            .when(total > 1, (held - d1) / (total - 1) * F.col("below_less"))
            .otherwise(F.col("below_less"))
        )
        lower = stored(grown.select("a", "b", p.alias("p"), less.alias("less")), "lm-level", "zstd")
    return lower.select("a", "b", "p", F.log("less").alias("logp"))


def block_values(grams: DataFrame, model: DataFrame) -> str:
    """Folder with the (a, b, logp) of the n-grams of every block, one folder in it for each."""
    path = new_path(grams.sparkSession, "lm-values")
    rows = grams.select("block", "a", "b").join(model.select("a", "b", "logp"), ["a", "b"])
    rows.select("block", "a", "b", "logp").repartition("block").write.partitionBy("block").parquet(path, compression="zstd")
    return path


class Values:
    """What the model says of the n-grams of one block."""

    def __init__(self, a: np.ndarray, b: np.ndarray, logp: np.ndarray):
        self.left, i = np.unique(a.astype(np.uint64), return_inverse=True)
        self.right, j = np.unique(b.astype(np.uint64), return_inverse=True)
        self.keys, first = np.unique(i.astype(np.uint64) << np.uint64(32) | j.astype(np.uint64), return_index=True)
        self.logp = logp[first]

    @classmethod
    def read(cls, folder: str, block: int) -> Values:
        system, at = fs.FileSystem.from_uri(folder)
        rows = pyarrow.dataset.dataset(f"{at}/block={block}", format="parquet", filesystem=system).to_table(columns=["a", "b", "logp"])
        return cls(*(rows.column(c).to_numpy() for c in ("a", "b", "logp")))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        place = lambda line, x: np.minimum(np.searchsorted(line, x), len(line) - 1)
        i, j = place(self.left, a), place(self.right, b)
        k = place(self.keys, i.astype(np.uint64) << np.uint64(32) | j.astype(np.uint64))
        whole = self.keys[k]
        if not ((self.left[whole >> np.uint64(32)] == a) & (self.right[whole & np.uint64(0xFFFFFFFF)] == b)).all():
            raise ValueError("a block holds n-grams that were not counted")
        return self.logp[k]


def score(rows: DataFrame, block: str, text: str, folder: str, piece: int) -> DataFrame:
    """``rows`` with ``log_ppl``: minus the mean log probability of a text's characters, 0 for an empty text."""

    def run(batches):
        at, values = None, None
        for batch in batches:
            for number, part in runs(batch, block, text, piece):
                points, off = code_points(*buffers(part.column(part.schema.get_field_index(text))))
                out = np.zeros(part.num_rows)
                full = np.flatnonzero(np.diff(off))
                if len(full):
                    if number != at:
                        at, values = number, Values.read(folder, number)
                    a, b, place, _ = distinct(points, off)
                    # summed text by text, whatever stands beside it
                    out[full] = -np.add.reduceat(values.of(a, b)[place], off[full]) / np.diff(off)[full]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out)], names=[*part.schema.names, "log_ppl"])

    schema = ", ".join([*(f"{c} {t}" for c, t in rows.dtypes), "log_ppl double"])
    return rows.mapInArrow(run, schema)
