"""Words and hashes of a whole Arrow batch of texts at once, as numpy work on the UTF-8 bytes.

White space here is ``[\\x20\\x09-\\x0D]``. These bytes never occur inside a longer UTF-8 sequence, so words cut at
byte level are exactly the words of the text. Hashes are 64 bit; strings of up to eight bytes never collide with
others of their length, longer ones as seldom as random numbers do.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits, for words without punctuation.
MARKS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
_MUL1, _MUL2, _SEED = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(33))
    x *= _MUL1
    x ^= x >> np.uint64(29)
    x *= _MUL2
    x ^= x >> np.uint64(32)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets of the texts in them; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    off = off.astype(np.int64)
    return raw[off[0]:off[-1]], off - off[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    size = ends - starts
    out = mix(size.astype(np.uint64) + _SEED)
    at, left, rows = starts, size, None
    while len(at):
        chunk = eight[at] & _KEEP[np.minimum(left, 8)]
        if rows is None:
            out = mix(out ^ chunk)
            more = np.flatnonzero(left > 8)
            rows = more
        else:
            out[rows] = mix(out[rows] ^ chunk)
            more = np.flatnonzero(left > 8)
            rows = rows[more]
        at, left = at[more] + 8, left[more] - 8
    return out


@dataclass
class Words:
    """Words of a batch: byte spans, and ``first[d]:first[d + 1]`` are the words of text d."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def words(column, lower: bool = False, blank: np.ndarray = BLANK) -> Words:
    data, offsets = buffers(column)
    if lower:
        data = LOWER[data]
    ink = ~blank[data]
    start, end = ink.copy(), ink.copy()
    start[1:] &= ~ink[:-1]
    end[:-1] &= ~ink[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]  # a text may begin without white space before it
    start[inner] = ink[inner]
    end[inner - 1] = ink[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many positions of each text the mask holds."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of ``size`` words from each word on, and which of them lie within one text."""
    n = len(hashes)
    out = hashes.copy()
    for k in range(1, size):
        nxt = np.zeros(n, np.uint64)
        nxt[: max(0, n - k)] = hashes[k:]
        out = mix(out * _MUL2 + nxt)
    whole = np.arange(n) + size <= np.repeat(first[1:], np.diff(first))
    return out, whole


def pieces(batch: pa.RecordBatch, text: str, most: int = 4 << 20):
    """Row ranges of a batch with about ``most`` bytes of text each, so that working arrays stay small; a longer text is one piece."""
    column = batch.column(batch.schema.get_field_index(text))
    _, offsets = buffers(column)
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, min(upto, len(column)) - at)
        at = upto
