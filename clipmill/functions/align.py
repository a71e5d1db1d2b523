"""Word alignment: edit operations and boundary errors of expected against predicted words.

Built-in array lambdas would copy an array for every cell, so this one rule is an Arrow-batched
pandas UDF: rows of similar length are aligned together, one anti-diagonal at a time in numpy.

Long transcripts are aligned within a band around the main diagonal first (cells with |i - j| <= k). A path that leaves the band costs
more than k, so a distance of at most k is exact, and so is every choice on its path; otherwise the band is doubled, up to the whole
table. The cost is length times distance, not length times length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_STAMP = -(2**62)
_CELLS = 16_000  # cells per diagonal buffer: small enough to stay in the processor cache
_BAND, _LONG = 32, 192  # first band, and the length from which a band pays
_FAR = 1 << 40
COUNTS = ("substitutions", "insertions", "deletions", "matched", "boundary_error_ms", "boundary_count")
RESULT = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def _pad(rows: list[np.ndarray], width: int, fill: int) -> np.ndarray:
    out = np.full((len(rows), width), fill, dtype=np.int64)
    for r, row in enumerate(rows):
        out[r, : len(row)] = row
    return out


def _align(e: np.ndarray, p: np.ndarray, m: np.ndarray, n: np.ndarray, stamps: list[np.ndarray], band: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Counts (S, I, D, matched, error, boundaries) for a padded batch, and each row's cost within the band.

    A cell prefers deletion, then insertion, then the diagonal, so carrying values forward gives the
    same path as tracing back from the end. Only cost, substitutions and boundary sums travel; the
    other counts follow from them and the two lengths.
    """
    rows, width = e.shape
    height = p.shape[1]
    es, ee, ps, pe = stamps
    p, ps, pe = p[:, ::-1], ps[:, ::-1], pe[:, ::-1]
    e_timed, p_timed = (es != NO_STAMP) & (ee != NO_STAMP), (ps != NO_STAMP) & (pe != NO_STAMP)
    timed_at_all = bool(e_timed.any() and p_timed.any())
    depth = 4 if timed_at_all else 2  # cost, substitutions[, error, boundaries]
    state = np.zeros((3, depth, rows, width + 1), dtype=np.int64)
    last = np.zeros((4, rows), dtype=np.int64)
    order = np.arange(rows)
    for d in range(width + height + 1):
        cur, prev, prev2 = state[d % 3], state[(d - 1) % 3], state[(d - 2) % 3]
        lo, hi = max(0, d - height), min(d, width)
        if band is not None:
            lo, hi = max(lo, (d - band + 1) // 2), min(hi, (d + band) // 2)
            for side in (lo - 1, hi + 1):  # just outside: what buffers hold there is of other diagonals
                if 0 <= side <= width:
                    cur[:, :, side] = 0
                    cur[0, :, side] = _FAR
        for edge in ([0] if lo == 0 else []) + ([d] if hi == d else []):
            cur[:, :, edge] = 0
            cur[0, :, edge] = d
        a, b = max(lo, 1), min(hi, d - 1)
        if a <= b:
            i, back = slice(a, b + 1), slice(a - 1, b)
            j = slice(height - d + a, height - d + b + 1)  # reversed positions
            same = e[:, back] == p[:, j]
            up, left, diag = prev[:, :, back], prev[:, :, i], prev2[:, :, back]
            c_side = np.minimum(up[0], left[0]) + 1
            use_diag = diag[0] + ~same < c_side
            new = np.where(up[0] <= left[0], up, left)
            new[0] += 1
            new = np.where(use_diag, diag, new)
            miss = use_diag & ~same
            new[0] += miss
            new[1] += miss
            if timed_at_all:
                timed = use_diag & same & e_timed[:, back] & p_timed[:, j]
                gap = np.abs(es[:, back] - ps[:, j]) + np.abs(ee[:, back] - pe[:, j])
                new[2] += np.where(timed, gap, 0)
                new[3] += 2 * timed
            cur[:, :, i] = new
        done = order[m + n == d]
        if len(done):
            last[:depth, done] = cur[:, done, m[done]]
    cost, sub, error, bounds = last
    ins = (cost - sub - (m - n)) // 2
    dele = ins + m - n
    return np.stack([sub, ins, dele, m - sub - dele, error, bounds]), cost


def _batch(ew, pw, es, ee, ps, pe) -> pd.DataFrame:
    m = np.array([len(x) for x in ew], dtype=np.int64)
    n = np.array([len(x) for x in pw], dtype=np.int64)
    words = [w for side in (ew, pw) for row in side for w in row]
    codes = pd.factorize(np.array(words, dtype=object))[0] if words else np.zeros(0, dtype=np.int64)
    cut = np.split(codes, np.cumsum(np.concatenate([m, n]))[:-1])
    e_codes, p_codes = cut[: len(m)], cut[len(m) :]
    out = np.zeros((6, len(m)), dtype=np.int64)
    by_size = np.lexsort((n, m))
    at = 0
    while at < len(by_size):
        end = at + 1
        while end < len(by_size) and (end - at + 1) * (m[by_size[end]] + 1) <= _CELLS:
            end += 1
        pick = by_size[at:end]
        w, h = int(m[pick].max()), int(n[pick].max())
        side = lambda rows, width, fill: _pad([np.asarray(rows[r]) for r in pick], width, fill)
        stamps = [side(es, w, NO_STAMP), side(ee, w, NO_STAMP), side(ps, h, NO_STAMP), side(pe, h, NO_STAMP)]
        batch = [side(e_codes, w, -1), side(p_codes, h, -2), m[pick], n[pick]]
        left = np.arange(len(pick))
        band = max(_BAND, int(np.abs(m[pick] - n[pick]).max())) if min(w, h) >= _LONG else None
        while len(left):
            whole = band is None or band >= max(w, h)
            counts, cost = _align(*(x[left] for x in batch), [x[left] for x in stamps], None if whole else band)
            done = np.ones(len(left), bool) if whole else cost <= band
            out[:, pick[left[done]]] = counts[:, done]
            left = left[~done]
            band = None if whole else 2 * band
        at = end
    return pd.DataFrame(dict(zip(COUNTS, out)))


@F.pandas_udf(RESULT)
def _alignment(
    ew: pd.Series, pw: pd.Series, es: pd.Series, ee: pd.Series, ps: pd.Series, pe: pd.Series
) -> pd.DataFrame:
    return _batch(*[s.to_list() for s in (ew, pw, es, ee, ps, pe)])


def word_alignment(expected: Column, predicted: Column) -> Column:
    """struct of edit counts for two ``array<struct<word, start_ms, end_ms>>`` columns."""

    def part(c: Column, f: str) -> Column:
        if f == "word":
            return F.coalesce(F.transform(c, lambda w: w["word"]), F.array().cast("array<string>"))
        stamp = F.transform(c, lambda w: F.coalesce(w[f].cast("bigint"), F.lit(NO_STAMP)))
        return F.coalesce(stamp, F.array().cast("array<bigint>"))

    return _alignment(
        part(expected, "word"), part(predicted, "word"), part(expected, "start_ms"), part(expected, "end_ms"),
        part(predicted, "start_ms"), part(predicted, "end_ms"),
    )
