"""Secret scans with a recursive decoding worklist.

A document starts as one layer, its whole text. Each layer is scanned for secrets, then decoded in every way that applies:
percent escapes, Unicode escapes (also ``%u`` and octal) and entities, base64 (also wrapped over lines, or glued to words and paths), text of two bytes a
character, and compressed bytes (also several streams, behind a short header, or deflated without one) behind any of them. Decoding replaces the encoded
places within the layer, so a secret whose name stands outside them is found as well, and gives a new layer, which is
worked on in turn until no new one appears. A layer seen before in this document is not taken again, which ends cycles. Every character of a layer
knows which code points of the original text it came from, so spans are always those of the document.

Of a stream that is broken or ends early, the text before that place is scanned as a layer of its own, and ``complete`` is false.

Defined limits (against archive bombs): of a place that unpacks to more than ``limit`` bytes the first ``limit`` are scanned, as a
layer of their own that is not unpacked further; once the layers of one document exceed ``limit`` characters, new layers are scanned but
not unpacked. Nothing else of the document is affected; such rows have ``complete`` false. Null and empty texts have no spans. Repeated rows are scanned each for itself. An empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from html.entities import html5
from itertools import islice
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base scan; a match is dropped when it is shorter than stated beside it.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)  # group 2: 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")  # 20
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this is the same as dropping shorter ones
KINDS = ("assign", "access", "hex")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});|((?:\\x[0-9A-Fa-f]{2})+)|%u([0-9A-Fa-f]{4})|((?:\\[0-3][0-7]{2})+)|&([A-Za-z][A-Za-z0-9]{1,30};)")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f\ud800-\udfff\ufffe\uffff]")
#: Runs of base64 characters on lines that follow each other, also behind quote marks, and the names that quoted compressed bytes begin with.
RUN = re.compile(r"[A-Za-z0-9+/_-]+")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t]*+\r?\n[\x20\t>]*+[A-Za-z0-9+/_-]++)+={0,2}")
TOKEN = re.compile(r"\S+")
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|[\x08-\x78][\x01\x5e\x9c\xda]")
BYTE = re.compile(rb"%[0-9A-Fa-f]{2}|[\x00-\xff]", re.S)
STRONG = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: Stretches of text between other bytes, and the characters that only one of the two base64 alphabets has.
STRETCH = re.compile(rb"[\x20-\x7e\t\r\n]{10,}")
ALPHABETS = (re.compile("[A-Za-z0-9+/]{16,}"), re.compile("[A-Za-z0-9_-]{16,}"))
LIMIT = 64 << 20
#: A decoded place takes its place in the layer, is a layer of its own, or is the beginning of one that is beyond the limit or of a broken stream.
INSIDE, ALONE, CUT, SHORT = range(4)


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches of one layer, end exclusive."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def _tool(data: bytes):
    """A fresh unpacker for what the data begins with, and whether another stream may follow; None without a magic number."""
    if data[:3] == b"\x1f\x8b\x08":
        return lambda: zlib.decompressobj(31)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return lambda: zstandard.ZstdDecompressor().decompressobj()
    if len(data) > 2 and data[0] & 0x0F == 8 and data[0] >> 4 <= 7 and (data[0] << 8 | data[1]) % 31 == 0:
        return zlib.decompressobj
    return None


BROKEN = (zlib.error, OSError, lzma.LZMAError, ValueError, EOFError, zstandard.ZstdError)


def _stream(tool, data: bytes, limit: int) -> tuple[bytes, bytes | None]:
    """(what one stream gives, up to one byte beyond the limit; what follows it, None if the stream is broken, cut short or longer)."""
    made, out = tool(), bytearray()
    bounded = not type(made).__module__.startswith("zstandard")  # that one takes no limit, so it gets smaller pieces
    step = 1 << 12 if bounded else 1 << 8
    try:
        for at in range(0, len(data), step):  # in pieces, so that what came before a broken place is kept
            part = data[at:at + step]
            while True:
                out += made.decompress(part, limit + 1 - len(out)) if bounded else made.decompress(part)
                if len(out) > limit:
                    return bytes(out[:limit + 1]), None
                part = getattr(made, "unconsumed_tail", b"")
                if made.eof:
                    return bytes(out), bytes(made.unused_data) + bytes(data[at + step:])
                if not part and (not bounded or getattr(made, "needs_input", True)):
                    break
    except BROKEN:
        pass
    return bytes(out), None


def _inflate(data: bytes, limit: int) -> tuple[bytes, bool] | None:
    """One layer of compression off, all streams that follow each other, and whether something is missing; None if there is none.

    Missing is what lies beyond the limit or behind a broken or lost end; of a broken stream only plain text counts.
    """
    data = bytes(data)
    tool, out, rest = _tool(data), bytearray(), data
    if tool is None:
        return None
    while tool is not None:
        part, after = _stream(tool, rest, limit - len(out))
        out += part
        if len(out) > limit:
            return bytes(out[:limit]), True
        if after is None:
            shown = bytes(out)
            return (shown, True) if len(shown) >= 8 and _plain(shown) else None
        rest, tool = after, _tool(after) if after[:2] == data[:2] else None
    return bytes(out), False


def _plain(data: bytes) -> bool:
    text = data.decode("utf-8", "replace")
    return 20 * (len(ODD.findall(text)) + text.count("\ufffd")) <= len(text)


def _bare(data: bytes, limit: int) -> bytes | None:
    """Deflated bytes without a header, or with a short header before a magic number, as what they unpack to."""
    for m in STRONG.finditer(data, 1, 64):
        found = _inflate(data[m.start():], limit)
        if found and not found[1]:
            return found[0]
    if len(data) < 12:
        return None
    out, after = _stream(lambda: zlib.decompressobj(-15), data, limit)
    return out if after is not None and len(after) <= 8 and len(out) >= 8 and _plain(out) else None


def _two_bytes(data: bytes) -> str | None:
    """Text of two bytes a character: every other byte is zero nearly always."""
    n = len(data) // 2
    if n < 6:
        return None
    for zeros, name in ((data[1::2], "utf-16-le"), (data[::2], "utf-16-be")):
        if 10 * zeros.count(0) >= 7 * n:
            text = data[:2 * n].decode(name, "replace").removeprefix("\ufeff")
            return text if 20 * len(ODD.findall(text)) <= len(text) else None
    return None


def _as_text(data: bytes, limit: int) -> tuple[str, bool, int] | None:
    """The bytes as text, whether compression was taken off, and how the text stands: one of the four states above; None if nothing can be in it.

    Bytes with many characters that text does not have may be an ordinary word that was no encoding at all, so they do not take
    its place in the layer but are a layer of their own.
    """
    packed, cut, seen = False, False, set()
    while not cut and (more := _inflate(data, limit)) is not None:
        if data in seen:
            return None
        seen.add(data)
        (data, cut), packed = more, True
    state = INSIDE if not cut else CUT if len(data) >= limit else SHORT
    if b"\x00" in data and (text := _two_bytes(data)):
        return text, True, state
    text = data.decode("utf-8", "surrogateescape")  # a byte that is no UTF-8 is a character of its own
    if packed or 8 * len(ODD.findall(text)) <= len(text):
        return (text, packed, state) if text else None
    if (more := _bare(data, limit)) is not None:
        return more.decode("utf-8", "surrogateescape"), True, ALONE
    return (text, packed, ALONE) if scan(text) or any(x.search(text) for x in (PERCENT, ESCAPE, BASE64)) else None


def _evenly(text: str, unit: int, begin: int):
    """Source offsets of the characters of ``text`` when every byte took ``unit`` characters."""
    sizes = np.array([len(c.encode("utf-8", "surrogateescape")) for c in text]) * unit
    ends = begin + np.cumsum(sizes)
    return ends - sizes, ends


def _percent(text: str, limit: int):
    for m in PERCENT.finditer(text):
        found = _as_text(bytes.fromhex(m[0].replace("%", "")), limit)
        if found:
            # whether a stream really ends here is for ``_quoted`` to say, which takes bare bytes with it
            yield m.start(), m.end(), found[0], None if found[1] else _evenly(found[0], 3, m.start()), ALONE if found[2] == SHORT else found[2]


def _escapes(text: str, limit: int):
    high = None
    for m in ESCAPE.finditer(text):
        if m[6]:
            found = _as_text(bytes.fromhex(m[6].replace("\\x", "")), limit)
            if found:
                yield m.start(), m.end(), found[0], None if found[1] else _evenly(found[0], 4, m.start()), found[2]
            continue
        if m[8]:
            found = _as_text(bytes(int(x, 8) for x in m[8][1:].split("\\")), limit)
            if found:
                yield m.start(), m.end(), found[0], None if found[1] else _evenly(found[0], 4, m.start()), found[2]
            continue
        if m[9]:
            if m[9] in html5:
                yield m.start(), m.end(), html5[m[9]], None, INSIDE
            continue
        code = int(m[4]) if m[4] else int(m[1] or m[2] or m[3] or m[5] or m[7], 16)
        if 0xD800 <= code < 0xDC00:
            high = (m.start(), m.end(), code)
        elif 0xDC00 <= code < 0xE000:
            if high and high[1] == m.start():
                yield high[0], m.end(), chr(0x10000 + ((high[2] - 0xD800) << 10) + code - 0xDC00), None, INSIDE
            high = None
        elif 0 < code < 0x110000:
            yield m.start(), m.end(), chr(code), None, INSIDE


def _quoted(text: str, limit: int):
    """Compressed bytes that percent escapes stand for, with some bytes left bare: from a magic number to the end of its token."""
    for m in TOKEN.finditer(text):
        if PERCENT.search(text, m.start(), m.end()) is None:
            continue
        token = m[0].encode("utf-8", "surrogateescape")
        best = None
        for form in (token, token.replace(b"+", b" ")) if b"+" in token else (token,):
            data = unquote_to_bytes(form)
            for at in MAGIC.finditer(data):
                found = _as_text(data[at.start():], limit)
                if found and found[1] and (best is None or found[2] != SHORT):
                    place = next(islice(BYTE.finditer(form), at.start(), None)).start()
                    best = m.start() + len(form[:place].decode("utf-8", "surrogateescape")), m.end(), found[0], None, found[2]
                    if found[2] != SHORT:
                        break
            if best and best[4] != SHORT:
                break
        if best:
            yield best


def _unbase(body: str) -> bytes | None:
    if ("+" in body or "/" in body) and ("-" in body or "_" in body):
        return None
    body = body[:len(body) - (len(body) % 4 == 1)]
    return base64.urlsafe_b64decode(body.replace("+", "-").replace("/", "_") + "=" * (-len(body) % 4))


def _base64(text: str, limit: int):
    """Runs on one line. A stream that ends with its line and goes on in the next one is left to ``_wrapped``."""
    lines = None
    for m in BASE64.finditer(text):
        data = _unbase(m[0].rstrip("="))
        found = data and _as_text(data, limit)
        if found and found[2] == SHORT:
            lines = [w.span() for w in WRAPPED.finditer(text)] if lines is None else lines
            k = bisect_right(lines, (m.start(), len(text))) - 1
            if k >= 0 and m.start() < lines[k][1]:
                found = (*found[:2], ALONE)
        if found and found[2] != ALONE:
            yield m.start(), m.end(), found[0], _places(found, m.start()), found[2]
            continue
        if found:
            yield m.start(), m.end(), found[0], _places(found, m.start()), ALONE
        yield from _glued(text, m.start(), m.end(), limit)


def _places(found, begin: int):
    if found[1]:
        return None
    first, last = _evenly(found[0], 1, 0)
    return begin + first * 4 // 3, begin + -(-last * 4 // 3)


def _glued(text: str, start: int, end: int, limit: int):
    """Base64 with a word or path of its own alphabet before or behind it: stretches of text, and compressed bytes, at every offset."""
    for alphabet in ALPHABETS:
        for m in alphabet.finditer(text, start, end):
            for k in range(4):
                data = _unbase(m[0][k:]) or b""
                for piece in STRETCH.finditer(data):
                    at = m.start() + k + piece.start() * 4 // 3
                    found = (piece[0].decode(), False, ALONE)
                    yield at, min(m.start() + k + -(-piece.end() * 4 // 3), m.end()), found[0], _shifted(found[0], m.start() + k, piece.start()), ALONE
                for magic in STRONG.finditer(data):
                    found = _as_text(data[magic.start():], limit)
                    if found and found[1]:
                        yield m.start() + k + magic.start() * 4 // 3, m.end(), found[0], None, CUT if found[2] == CUT else ALONE


def _shifted(text: str, begin: int, skip: int):
    first, last = _evenly(text, 1, skip)
    return begin + first * 4 // 3, begin + -(-last * 4 // 3)


def _blocks(runs):
    """Ranges of lines that may be one wrapped text: all, all without the first or last, and equal lines with and without those around."""
    n = len(runs)
    size = [b - a for a, b in runs]
    yield [(i, j) for i, j in ((0, n), (1, n), (0, n - 1), (1, n - 1)) if j - i > 1]
    i = 0
    while i < n:
        j = i + 1
        while j < n and size[j] == size[i]:
            j += 1
        if size[i] >= 16:
            yield [(a, b) for a, b in ((i - 1, j + 1), (i, j + 1), (i - 1, j), (i, j)) if a >= 0 and b <= n and b - a > 1]
        i = j


def _wrapped(text: str, limit: int):
    """Base64 over several lines."""
    for m in WRAPPED.finditer(text):
        runs = [(r.start(), r.end()) for r in RUN.finditer(text, m.start(), m.end())]
        if sum(b - a for a, b in runs) < 16:
            continue
        done = 0
        for ranges in _blocks(runs):
            doubtful = None
            for i, j in ranges:
                if i < done:
                    continue
                data = _unbase("".join(text[a:b] for a, b in runs[i:j]))
                found = data and _as_text(data, limit)
                if not found or found[2]:
                    doubtful = doubtful or found and (i, j, found)
                    continue
                yield _lines(runs[i:j], m.end() if j == len(runs) else runs[j - 1][1], found)
                done, doubtful = j, None
                break
            if doubtful:
                yield _lines(runs[doubtful[0]:doubtful[1]], runs[doubtful[1] - 1][1], doubtful[2])
            if done >= len(runs) - 1:
                break


def _lines(runs, end: int, found):
    where = None
    if not found[1]:
        at = np.concatenate([np.arange(a, b) for a, b in runs])
        first, last = _evenly(found[0], 1, 0)
        where = at[first * 4 // 3], at[-(-last * 4 // 3) - 1] + 1
    return runs[0][0], end, found[0], where, found[2]


DECODERS = (
    (lambda t: "%" in t, _percent), (lambda t: "%" in t, _quoted), (lambda t: "\\" in t or "&" in t or "%u" in t, _escapes),
    (lambda t: True, _base64), (lambda t: "\n" in t, _wrapped))


class Layer:
    """A text and, for each of its characters, the code points of the document it came from."""

    def __init__(self, text: str, start=None, end=None):
        self.text = text
        self.start, self.end = start, end

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (int(self.start[a]), int(self.end[a:b].max()))

    def child(self, places) -> "Layer":
        start = np.arange(len(self.text)) if self.start is None else self.start
        end = np.arange(1, len(self.text) + 1) if self.end is None else self.end
        text, starts, ends, at = [], [], [], 0
        for a, b, new, where, _ in places:
            text += [self.text[at:a], new]
            low, high = where or (np.full(len(new), a), np.full(len(new), b))
            starts += [start[at:a], start[low]]
            ends += [end[at:a], end[np.minimum(high, b) - 1]]
            at = b
        text.append(self.text[at:])
        return Layer("".join(text), np.concatenate([*starts, start[at:]]), np.concatenate([*ends, end[at:]]))

    def alone(self, place) -> "Layer":
        """Only what the place decodes to."""
        a, b, new, where, _ = place
        low, high = where or (np.full(len(new), a), np.full(len(new), b))
        high = np.minimum(high, b)
        return Layer(new, low, high) if self.start is None else Layer(new, self.start[low], self.end[high - 1])


def _children(layer: Layer, decode, limit: int):
    """(key, layer, whether it is whole) of what one decoder makes of a layer: places together as long as they fit the limit."""
    places, size = [], 0
    for place in decode(layer.text, limit):
        if place[4] != INSIDE:
            yield hash((place[2], place[:2])), layer.alone(place), place[4] not in (CUT, SHORT)
            continue
        if places and size + len(place[2]) > limit:
            child = layer.child(places)
            yield hash(child.text), child, True
            places, size = [], 0
        places.append(place)
        size += len(place[2])
    if places:
        child = layer.child(places)
        yield hash(child.text), child, True


def layers(text: str, limit: int = LIMIT):
    """The worklist: every layer of a document, the text first. A None says that the limit kept the layer before it from being unpacked further."""
    queue, seen, total = deque([Layer(text)]), {hash(text)}, 0
    while queue:
        layer = queue.popleft()
        yield layer
        for applies, decode in DECODERS:
            if not applies(layer.text):
                continue
            for key, child, whole in _children(layer, decode, limit):
                if key in seen:
                    continue
                seen.add(key)
                if whole and total + len(child.text) <= limit + 64 * len(text):
                    total += len(child.text)
                    queue.append(child)
                else:
                    yield child
                    yield None


def find(text: str, limit: int = LIMIT) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], bool]:
    """Base matches, all matches (start, kind, end) and whether every layer was read."""
    if BASE64.search(text) is None and WRAPPED.search(text) is None and "%" not in text and "\\" not in text and "&" not in text:
        base = sorted(scan(text)) if ":" in text or "=" in text else []
        return base, base, True
    base, every, complete = [], set(), True
    for layer in layers(text, limit):
        if layer is None:
            complete = False
            continue
        found = scan(layer.text)
        if layer.start is None:
            base = sorted(found)
        for a, kind, b in found:
            start, end = layer.span(a, b)
            every.add((start, kind, end))
    return base, sorted(every), complete


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, complete."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added", "complete"]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, every, complete = find(text or "", limit)
                counts = [sum(k == want for _, k, _ in base) for want in range(3)] if base else [0, 0, 0]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base), complete))
            cols = list(zip(*rows)) or [[]] * 7
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long, complete boolean")
