"""A character model of fixed size: folded to 32 symbols, with hashed counters of wide letters, sent whole to tasks.

An interpolated modified Kneser-Ney model of order four over text folded to 32 symbols (letters, digits, capitals, punctuation, signs,
bytes of other letters, white space), with at most 2^20 + 2^15 + 2^10 + 32 entries. It is stored as arrays sorted by the hash of the
n-gram. Which letter of more than one byte stands at a place is a second factor from counts in a table of 2^22 hashed n-grams.

The quality rules do not use it: they judge by the whole alphabet (``characters.py``). It is for callers who need a model whose size
does not depend on the corpus, and who can do without what the folding hides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmill.llm.chunks import combined, packed, whole
from clipmill.llm.words import buffers, mix, pieces
from clipmill.session import stored

ORDER, BITS = 4, 5
#: Bytes of text that are worked on at once.
PIECE = 1 << 19
#: Counters of the letters of more than one byte: (first, size) for letters, letters after one and after two characters, and these
#: one and two characters alone. ``PRIOR`` occurrences' worth of the shorter context go into the longer one.
REGIONS = {"1": (0, 1 << 18), "c2": (1 << 18, 1 << 18), "c3": (1 << 19, 1 << 19), "2": (1 << 20, 1 << 20), "3": (1 << 21, 1 << 21)}
WIDE, PRIOR = 1 << 22, 4.0


def _fold() -> np.ndarray:
    out = np.full(256, 30, np.uint8)  # other signs
    out[:0x21] = 0
    for k, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        out[ord(c)] = k + 1
    out[ord("A"):ord("Z") + 1] = 27
    out[ord("0"):ord("9") + 1] = 28
    for c in ".,;:!?'\"()-":
        out[ord(c)] = 29
    out[0x80:] = 31
    return out


FOLD = _fold()


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The four-symbol gram that ends at each byte; before a text stand blanks."""
    s = FOLD[data]
    out = s.astype(np.int32)
    for k in range(1, ORDER):
        prev = np.zeros(len(s), np.int32)
        prev[k:] = s[:-k]
        for j in range(k):
            at = offsets[:-1] + j
            prev[at[at < offsets[1:]]] = 0
        prev <<= BITS * k
        out |= prev
    return out


def wide_regions(data: np.ndarray, offsets: np.ndarray):
    """(first byte of every letter of more than one byte, then one region after the other: its name and the letters' counters); before a text stand blanks.

    Yields ``(None, first bytes)`` and then ``(region, counters within the region)``, so that only one region's arrays live at a time.
    """
    if not len(data) or data.max() < 0x80:
        return
    first = np.flatnonzero((data & 0xC0) != 0x80)
    wide = np.flatnonzero(data[first] >= 0xC0)
    at = first[wide]
    yield None, at
    point = FOLD[data[first]].astype(np.uint64)
    begin = np.searchsorted(first, offsets[np.searchsorted(offsets, at, "right") - 1])
    del first
    size = 2 + (data[at] >= 0xE0).astype(np.int8) + (data[at] >= 0xF0)
    letter = data[at].astype(np.uint64)
    for k in range(1, 4):
        letter = np.where(size > k, letter << np.uint64(8) | data[np.minimum(at + k, len(data) - 1)], letter)
    point[wide] = letter
    before = lambda k: np.where(wide - k >= begin, point[np.maximum(wide - k, 0)], np.uint64(0))
    slot = lambda name, key: (name, (key & np.uint64(REGIONS[name][1] - 1)).astype(np.int32))
    yield slot("1", mix(letter))
    context = mix(before(1) + np.uint64(1 << 40))
    yield slot("c2", context)
    yield slot("2", mix(context * np.uint64(5) + letter))
    context = mix(context * np.uint64(3) + before(2))
    del point, begin
    yield slot("c3", context)
    yield slot("3", mix(context * np.uint64(7) + letter))


def wide_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """First byte of every letter of more than one byte, and its counter in each region, all at once."""
    found = dict(wide_regions(data, offsets))
    return found.pop(None, np.zeros(0, np.int64)), found


def _counted(docs: DataFrame, text_col: str) -> DataFrame:
    """(gram, n) one row per gram and task, and (chunk, held) of the task's counters of wide letters."""

    def count(batches):
        total, letters, held = np.zeros(1 << (BITS * ORDER), np.int64), np.zeros(WIDE, np.uint32), 0
        names = ["gram", "n", "chunk", "held"]
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                data, off = buffers(part.column(0))
                np.add.at(total, grams(data, off), 1)
                for name, slots in wide_regions(data, off):
                    if name is not None:
                        first, size = REGIONS[name]
                        np.add.at(letters[first:first + size], slots, np.uint32(1))
                held += len(data)
                if held >= 1 << 31:  # before a counter of 32 bits can be full
                    yield from sent(letters)
                    letters[:], held = 0, 0
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen]), pa.nulls(len(seen), pa.int32()), pa.nulls(len(seen), pa.binary())], names=names)
        yield from sent(letters)

    def sent(letters):
        for k, data in packed(letters, np.uint64):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([k], pa.int32()), pa.array([data], pa.binary())], names=["gram", "n", "chunk", "held"])

    return stored(docs.select(F.col(text_col).alias("text")).mapInArrow(count, "gram long, n long, chunk int, held binary"), "lm-tasks")


def gram_counts(counted: DataFrame) -> DataFrame:
    """(gram, n) over all texts."""
    return counted.filter("gram is not null").groupBy("gram").agg(F.sum("n").alias("n"))


def letter_counts(counted: DataFrame) -> np.ndarray:
    """The counters of wide letters over all texts."""
    found = combined(counted.filter("chunk is not null").select("chunk", "held"), "<u8", "add", lambda c: c.astype("<f4"))
    return whole(found, WIDE, "<f4")


def _discounts(level: DataFrame) -> tuple[float, float, float]:
    n = level.agg(*[F.coalesce(F.sum((F.col("n") == k).cast("double")), F.lit(0.0)) for k in (1, 2, 3, 4)]).first()
    if min(n) == 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(ord, gram, logp, backoff) of the interpolated model; ``backoff`` is the log weight of a gram as a context."""
    levels = {ORDER: stored(counts, "lm-counts")}
    for order in range(ORDER - 1, 0, -1):
        short = (1 << (BITS * order)) - 1
        levels[order] = stored(levels[order + 1].groupBy(F.col("gram").bitwiseAND(short).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "lm-counts")
    lower = None
    out, weights = [], []
    for order in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(levels[order])
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = F.shiftright("gram", BITS)
        sums = levels[order].groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(cut).alias("held"))
        sums = sums.select("context", "total", (F.col("held") / F.col("total")).alias("weight"))
        grown = levels[order].withColumn("context", context).join(sums, "context")
        if lower is None:
            grown = grown.withColumn("below", F.lit(1.0 / (1 << BITS)))
        else:
            short = (1 << (BITS * (order - 1))) - 1
            below = lower.select(F.col("gram").alias("shorter"), F.col("p").alias("below"))
            grown = grown.join(below, F.col("gram").bitwiseAND(short) == F.col("shorter"))
        lower = stored(grown.select("gram", ((F.col("n") - cut) / F.col("total") + F.col("weight") * F.col("below")).alias("p")), "lm-level")
        out.append(lower.select(F.lit(order).alias("ord"), "gram", F.log("p").alias("logp")))
        weights.append(sums.select(F.lit(order - 1).alias("ord"), F.col("context").alias("gram"), F.log("weight").alias("backoff")))
    probs, back = out[0], weights[0]
    for a, b in zip(out[1:], weights[1:]):
        probs, back = probs.union(a), back.union(b)
    return probs.join(back, ["ord", "gram"], "full_outer")


def _hash(order: int, gram: np.ndarray) -> np.ndarray:
    return mix(gram.astype(np.uint64) | np.uint64(order << 32))


class Model:
    """The model as arrays sorted by n-gram hash."""

    def __init__(self, rows: pd.DataFrame, letters: np.ndarray | None = None):
        self.letters = np.zeros(WIDE, np.float32) if letters is None else letters
        self.load = {k: float(self.letters[a:a + n].sum(dtype=np.float64)) for k, (a, n) in REGIONS.items()}
        key = np.zeros(len(rows), np.uint64)
        for order in range(ORDER + 1):
            own = (rows["ord"] == order).to_numpy()
            key[own] = _hash(order, rows["gram"].to_numpy()[own])
        at = np.argsort(key)
        self.keys = key[at]
        self.logp = rows["logp"].to_numpy(np.float32)[at]
        self.backoff = rows["backoff"].to_numpy(np.float32)[at]

    def _find(self, order: int, gram: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Values of the grams; NaN where the model has none."""
        if not len(self.keys):
            return np.full(len(gram), np.nan, np.float32)
        h = _hash(order, gram)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, values[at], np.float32(np.nan))

    def wide(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and log probability of every letter of more than one byte, given that such a letter stands there."""
        at, p, context = np.zeros(0, np.int64), np.zeros(0), None
        for name, slots in wide_regions(data, offsets):
            if name is None:
                at = slots
                continue
            first, size = REGIONS[name]
            seen = np.maximum(self.letters[first:first + size][slots].astype(np.float64) - 1 - self.load[name] / size, 0)
            if name == "1":
                p = (seen + PRIOR / size) / (max(self.load["1"] - 1, 0) + PRIOR)
            elif name in ("c2", "c3"):
                context = seen
            else:
                p = (seen + PRIOR * p) / (np.maximum(context, seen) + PRIOR)
        return at, np.log(p)

    def table(self) -> np.ndarray:
        """Log probability of the last symbol of every possible gram of full order."""
        below = np.full(1, -np.log(1 << BITS), np.float32)
        for order in range(1, ORDER + 1):
            g = np.arange(1 << (BITS * order))
            weight = np.nan_to_num(self._find(order - 1, np.arange(1 << (BITS * (order - 1))), self.backoff), nan=0.0)
            backed = weight[g >> BITS] + (below[0] if order == 1 else below[g & ((1 << (BITS * (order - 1))) - 1)])
            own = self._find(order, g, self.logp)
            below = np.where(np.isnan(own), backed, own).astype(np.float32)
        return below


def train(docs: DataFrame, text_col: str = "text"):
    """A broadcast ``Model`` of all texts of ``docs``; its size is bounded by the folded alphabet and ``WIDE``."""
    counted = _counted(docs, text_col)
    rows = kneser_ney(gram_counts(counted)).toPandas()
    return docs.sparkSession.sparkContext.broadcast(Model(rows, letter_counts(counted)))
