"""Words of a byte-level tokenizer for a whole batch of texts at once, as numpy work on the UTF-8 bytes.

The tokenizer's pattern takes, from left to right: contractions; an optional space with letters, with digits or with other signs; white
space up to the last blank before a word; white space. Every byte of a text belongs to one word, so words follow from where they begin:
where the kind of character changes, moved by one for a blank before a word, and around contractions.
"""

from __future__ import annotations

import re

import numpy as np

from clipmill.llm.bpe import LETTER, OTHER, SPACE

BLANK, LETTERS, DIGITS, SIGNS, UNKNOWN = range(5)


def _kind(code: int) -> int:
    c = chr(code)
    if OTHER.match(c):
        return UNKNOWN
    if re.match(f"[{LETTER}]", c):
        return LETTERS
    if re.match("[0-9]", c):
        return DIGITS
    return BLANK if re.match(f"[{SPACE}]", c) else SIGNS


#: Kinds of the code points below 0x180, all that two bytes from 0xC2 to 0xC5 reach.
KINDS = np.array([_kind(c) for c in range(0x180)], np.uint8)
_OF_BYTE = np.concatenate([KINDS[:0x80], np.full(0x80, UNKNOWN, np.uint8)])
_ONE, _PAIRS = np.zeros(256, bool), np.zeros(256, np.uint8)
for _c in "stmd":
    _ONE[ord(_c)] = True
for _a, _b in ("re", "ve", "ll"):
    _PAIRS[ord(_a)] = ord(_b)


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of character that every byte belongs to."""
    out = _OF_BYTE[data]
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC5))
    if len(lead):
        of = KINDS[((data[lead] & 0x1F).astype(np.int64) << 6) | (data[lead + 1] & 0x3F)]
        out[lead], out[lead + 1] = of, of
    return out


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where words begin, which texts hold characters of unknown kind). Texts tile the data, words tile the texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, bool)
    kind = kinds(data)
    begin = np.zeros(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # a text ends before it or begins at it
    begin |= edge[:-1]
    unknown = np.searchsorted(offsets, np.flatnonzero(kind == UNKNOWN), "right") - 1
    odd = np.zeros(len(offsets) - 1, bool)
    odd[unknown] = True
    # a word after white space: its last blank stands alone or, if it is a plain space, before the word
    word = np.flatnonzero(begin & (kind != BLANK) & ~edge[:-1])
    word = word[kind[word - 1] == BLANK]
    last = word - 1 - ((data[word - 1] & 0xC0) == 0x80)
    begin[last] = True
    begin[word[data[last] == 0x20]] = False
    # contractions
    tick = np.flatnonzero(begin & (data == 0x27))
    tick = tick[(tick + 1 < n)]
    tick = tick[(kind[tick + 1] == LETTERS) & ~edge[tick + 1]]
    if len(tick):
        a, b = data[tick + 1], data[np.minimum(tick + 2, n - 1)]
        two = (_PAIRS[a] > 0) & (_PAIRS[a] == b) & (tick + 2 < n) & ~edge[np.minimum(tick + 2, n)]
        size = np.where(_ONE[a], 2, np.where(two, 3, 0))
        tick, size = tick[size > 0], size[size > 0]
        begin[tick + 1] = False
        after = tick + size
        after = after[after < n]
        begin[after[kind[after] == LETTERS]] = True
    return np.flatnonzero(begin), odd
