"""The byte-level word cut and the batch encoder against the tokenizer library, by code point and on random mixtures."""

import random
import subprocess
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa

from clipmill.llm import token_files

BYTES = str(public_tokenizers.path("byte_bpe_50k.json"))


def same(encoder, texts):
    got = encoder.batch(pa.array(texts, pa.string()))
    want = [np.array(encoder.tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [t for t, g, w in zip(texts, got, want) if g != w] == []


def test_words_by_code_point():
    texts = [None, ""]
    for c in map(chr, [*range(0x250), 0x3A3, 0x212A, 0x301, 0x1F600, 0x5B57, 0x2028, 0xFB01, 0x1680]):
        texts += [f"ab{c}cd 12{c}{c}'s", c, f"'{c}S  a{c}9", f" {c}'ll{c}'re ", f"x {c} {c}{c}  y", f"it's{c}'t'sx'lly 've"]
    same(token_files.Encoder(BYTES), texts)


def test_random_mixtures_and_forgotten_words(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 200)
    encoder, rnd = token_files.Encoder(BYTES), random.Random(5)
    parts = ["a", "B", "é", "1", "9", " ", " ", "  ", "\t", "\n", "'", "'", "s", "t", "re", "ve", "ll", "m", "d", "!", "-", "\xa0", "ÿ", "ſ", "<|endoftext|>", "字"]
    for _ in range(100):
        same(encoder, ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(100)])
    assert len(encoder.hashes) < 5000


MEMORY = """
import numpy as np, pandas as pd, pyarrow as pa, resource
from clipmill.llm import quality as q
rng = np.random.default_rng(1)
words = ["".join(rng.choice(list("абвгдежзийклмнопрстуфхцчшщыьэюя"), rng.integers(2, 9))) for _ in range(2000)]
batch = pa.RecordBatch.from_arrays([pa.array([" ".join(rng.choice(words, 300)) for _ in range(2500)])], names=["text"])
model = q.Model(pd.DataFrame({"ord": [], "gram": [], "logp": [], "backoff": []}), np.ones(q.WIDE, np.float32))
table, letters = model.table(), np.zeros(q.WIDE, np.uint32)
for part in q.pieces(batch, "text", q.PIECE):
    data, off = q.buffers(part.column(0))
    q.rule_counts(part.column(0))
    for name, slots in q.wide_regions(data, off):
        if name is not None:
            first, size = q.REGIONS[name]
            np.add.at(letters[first:first + size], slots, np.uint32(1))
    each = table[q.grams(data, off)].astype(float)
    at, logp = model.wide(data, off)
    each[at] += logp
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_quality_rules_need_little_memory_on_other_scripts():
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", MEMORY], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 320
