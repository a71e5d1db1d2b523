"""Secrets behind encodings that are glued, cut, repeated, shifted or rare; each text holds one secret that only decoding shows."""

import base64
import bz2
import gzip
import lzma
import zlib

import pytest
import zstandard

from clipmill.llm import secrets

SECRET = "password = hunter2secretvalue"
NOISE = "The quick brown fox jumps over the lazy dog and runs away from it all the time. " * 3


def b64(data, safe=False):
    return (base64.urlsafe_b64encode if safe else base64.b64encode)(data).decode()


def raw_deflate(data):
    tool = zlib.compressobj(wbits=-15)
    return tool.compress(data) + tool.flush()


PLAIN = SECRET.encode()
LONG = (NOISE + SECRET + " " + NOISE).encode()
CASES = {
    "behind a path": f"see /tmp/{b64(PLAIN)}",
    "behind an address": f"https://h.io/v1/{b64(PLAIN)}",
    "behind an address, other alphabet": f"https://h.io/v1/{b64(PLAIN, True)}",
    "behind a name": f"a_{b64(PLAIN)}",
    "between words": f"ab{b64(PLAIN)}",
    "gzip behind a path": f"/var/x/{b64(gzip.compress(LONG))}",
    "two gzip members": b64(gzip.compress(NOISE.encode()) + gzip.compress(LONG)),
    "two bz2 streams": b64(bz2.compress(NOISE.encode()) + bz2.compress(LONG)),
    "two xz streams": b64(lzma.compress(NOISE.encode()) + lzma.compress(LONG)),
    "two zstd frames": b64(zstandard.compress(NOISE.encode()) + zstandard.compress(LONG)),
    "raw deflate": b64(raw_deflate(LONG)),
    "short header": b64(b"HDR1\x00\x07" + gzip.compress(LONG)),
    "utf-16": b64(SECRET.encode("utf-16-le")),
    "utf-16 with mark": b64(SECRET.encode("utf-16")),
    "utf-16 other order": b64(SECRET.encode("utf-16-be")),
    "percent u": "".join(f"%u{ord(c):04x}" for c in SECRET),
    "octal": "".join(f"\\{ord(c):03o}" for c in SECRET),
    "named entities": "pass&#119;ord&equals;&quot;hunter2secretvalue&quot;",
}


@pytest.mark.parametrize("name", list(CASES))
def test_hidden_secrets(name):
    text = f"before {CASES[name]} after"
    base, every, complete = secrets.find(text)
    added = set(every) - set(base)
    assert added and complete
    for start, _, end in added:
        assert 7 <= start < end <= len(text) - 6


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, zlib.compress, zstandard.compress, lzma.compress])
def test_cut_streams_are_scanned_and_said_to_be_incomplete(pack):
    data = (SECRET + " " + NOISE).encode() + bytes(range(33, 127)) * 40
    packed = pack(data)
    base, every, complete = secrets.find("x " + b64(packed[:-6]))
    if set(every) - set(base):
        assert not complete
    else:
        assert pack in (bz2.compress, zstandard.compress, lzma.compress)  # nothing comes out of a block that is not whole
    assert secrets.find("x " + b64(packed))[2]


def test_ordinary_text_stays_clean():
    text = NOISE + " internationalization counterrevolutionaries https://example.org/some/long/path/with/many/parts AT&T a&b; R&D;"
    assert secrets.find(text) == ([], [], True)


def test_spans_of_glued_text():
    text = f"/tmp/{b64(PLAIN)}"
    _, every, _ = secrets.find(text)
    assert any(a >= 5 - 1 and b <= len(text) and b - a <= len(b64(PLAIN)) for a, _, b in every)
