"""The registered queries on the small tables: against SQL where it can say the same, else against plain Python over every document."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from clipmill.llm import queries as llm
from compare import compare, oracle_connection

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def run(spark, name):
    rows = llm.queries()[name](spark, SF_DIR).collect()
    return {r.doc_id: r for r in rows}


@pytest.mark.parametrize("name", list(llm.oracle_sql()))
def test_against_sql(spark, name):
    assert compare(llm.queries()[name](spark, SF_DIR), oracle_connection(SF_DIR), llm.oracle_sql()[name]) is None


def test_all_operators_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in llm.queries()) == list(range(1, 14))


def test_language_of_documents_follows_their_labels(spark, docs):
    rows = llm.queries()["op1_language_id"](spark, SF_DIR).collect()
    own = [r for r in rows if r.doc_id is not None]
    assert len(own) == len(docs) and len(rows) > len(own)
    assert np.mean([r.lang == docs[r.doc_id].lang for r in own]) > 0.97
    pages = [r for r in rows if r.page_id is not None]
    assert np.mean([r.lang == r.declared for r in pages]) > 0.95


def base_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secret_base_spans(spark, docs):
    got = run(spark, "op2_secret_scan")
    for i, d in docs.items():
        want = base_spans(d.text or "")
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want)
        counts = Counter(k for _, k, _ in want)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == (counts[0], counts[1], counts[2])
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(filter(None, r.spans.split(",")))


def test_bpe_is_the_library(spark, docs):
    from clipmill.llm.bpe import tokenizer

    tok = tokenizer(str(public_tokenizers.path("word_bpe_49k.json")))
    got = run(spark, "op3_bpe_encode_decode")
    assert set(got) == set(docs)
    for i, d in docs.items():
        ids = tok.encode(d.text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))


def test_toxicity_ranks_held_out_rows(spark, docs):
    got = run(spark, "op4_toxicity")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = {r.doc_id: r for r in llm.queries()["op4_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    held = [(got[i].score, t) for i, t in labels.items() if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    bad, good = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([[b > g for g in good] for b in bad]) > 0.8
    assert np.mean([g < 0.5 for g in good]) > 0.97


def test_licenses_by_brute_force(spark, docs):
    from clipmill.llm.licenses import CONTAINED, TEMPLATES

    words = lambda x: ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", x)]
    grams = lambda w: [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    got = run(spark, "op5_license_scan")
    for i, d in docs.items():
        have, want = grams(words(d.text or "")), set()
        for name, text in TEMPLATES.items():
            size, template = len(words(text)), set(grams(words(text)))
            for k, g in enumerate(have):
                if g in template and len(set(have[k:k + size - 2]) & template) / len(template) >= CONTAINED:
                    want.add(name)
                    break
        assert set(got[i].licenses) == want, i
        for part in filter(None, got[i].spans.split(",")):
            name, a, b = part.rsplit(":", 2)
            assert len(set(grams(words(d.text[int(a):int(b)]))) & set(grams(words(TEMPLATES[name])))) >= CONTAINED * len(set(grams(words(TEMPLATES[name]))))


def rule_counts(text):
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    tri = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    often = Counter(tri)
    covered = {k + j for k, t in enumerate(tri) if often[t] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_rules_and_verdicts(spark, docs):
    got = run(spark, "op7_quality_rules")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    for i, d in docs.items():
        r, want = got[i], rule_counts(d.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and r.low <= r.log_ppl <= r.high)
    clean = [got[i].kept for i, q in quality.items() if q == 1 and not got[i].base_failed]
    assert np.mean(clean) > 0.97


def test_token_files_hold_the_ids(spark, docs):
    from clipmill.llm.bpe import tokenizer

    tok = tokenizer(str(public_tokenizers.path("byte_bpe_50k.json")))
    got, start = run(spark, "op9_token_files"), 0
    for i in sorted(docs):
        ids = tok.encode(docs[i].text or "", add_special_tokens=False).ids + [0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
