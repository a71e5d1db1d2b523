"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clipmill.llm import bpe, exact_dedup, jaccard_join, language, licenses, mixing, quality, secrets, token_files, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, kept boolean, size string, h string, cls string, label int, token string, bucket long, word string"
BPE, BYTES = (str(public_tokenizers.path(f"{n}.json")) for n in ("word_bpe_49k", "byte_bpe_50k"))


def _texts():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    base = prose(300)
    near = [base.replace(" ", "  ", 3), base + " tail", "head " + base, " ".join(base.split()[:-8]), base.upper()]
    far = [" ".join(w if k % 9 else f"x{j}" for k, w in enumerate(base.split())) for j in range(3)]
    long = prose(60_000)
    odd = [None, "", " \n\t ", "one", "One two", "one two", "é ü ñ <|endoftext|> ΑΣ '''s", "a" * 5000, "line\nline\nline\n\nother"]
    twice = prose(80)
    return [base, base, *near, *far, long, long + " more", *odd, *odd, twice, twice, "token = 0123456789abcdef0123456789abcdef", "Released under the MIT License."]


@pytest.fixture(scope="module")
def rows():
    out = []
    for k, text in enumerate(_texts()):
        i = 1000 - 7 * k
        out.append((i, text, [None, "en", "fr"][k % 3], [None, "s1", "s2", ""][k % 4], len(text or ""), k, True, "x", "y", "z", None, "t", 5, "v"))
    out += [out[0], out[20], (None, "one two three four", "en", "s1", 3, 1, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups(spark, rows, docs, empty):
    got = exact_dedup.exact_groups(docs, bucket_bytes=2000).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        for i in ids:
            want[(i, min(x for x in ids if x is not None) if any(x is not None for x in ids) else None, len(ids), sha)] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert len({r.bucket for r in got}) > 3  # the directory was split
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and Counter(norm(r.text) for r in kept.collect()) == Counter(groups.keys())
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.keep_first(empty).count() == 0


def test_directory_splits_and_chains(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("h"), F.lit(100).cast("long").alias("bytes"))
    table, depth = exact_dedup.directory(keys, 20_000, 20)
    assert table.count() == table.select("slot").distinct().count() == 1 << depth
    load = keys.join(table, exact_dedup.slot("h", depth) == table.slot).groupBy("bucket").agg(F.sum("bytes")).collect()
    assert sum(r[1] for r in load) == 400_000 and max(r[1] for r in load) <= 20_000
    one = spark.createDataFrame([(5, 10**9)], "h long, bytes long")
    assert exact_dedup.directory(one, 100, 8)[0].count() >= 1  # a key of its own is never split


def test_mix(spark, rows, docs, empty):
    got = mixing.mix(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in got)
    per, target, taken = Counter(), {}, Counter()
    for r in got:
        per[r.source] += r.size
        target[r.source] = r.target
        taken[r.source] += r.taken
    total, names = sum(per.values()), sorted(per, key=lambda s: (s is None, s or ""))
    weight, want, open_ = {s: k % 3 + 1 for k, s in enumerate(names)}, {}, set(names)
    while True:
        rest = total - sum(want.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * per[s]]
        if not over:
            break
        for s in over:
            want[s] = 3 * per[s]
            open_.remove(s)
    want |= share
    assert all(abs(target[s] - want[s]) < 1e-6 * total for s in names)
    assert sum(taken.values()) <= total
    again = mixing.mix(docs.repartition(5))
    assert bag(again, "doc_id", "size", "taken") == Counter((r.doc_id, r.size, r.taken) for r in got)
    assert mixing.mix(empty).count() == 0
    out = mixing.take(docs)
    assert out.columns == docs.columns and mixing.take(empty).count() == 0


def test_mix_nears_its_targets(spark):
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 13).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    for r in mixing.mix(many).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 0.01 * r.target + 40


def shingle_set(text, size=3):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(text or "")]
    return frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def test_jaccard_components(spark, rows, docs, empty):
    sets = [(r[0], shingle_set(r[1])) for r in rows]
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                parent[root(x)] = root(y)
    least = {}
    for k, (i, s) in enumerate(sets):
        if s and i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    want = Counter((i, len(s), least.get(root(k)) if s else i) for k, (i, s) in enumerate(sets))
    assert bag(jaccard_join.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == want
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert jaccard_join.jaccard_components(empty).count() == 0 and jaccard_join.keep_one(empty).count() == 0


def test_jaccard_join_of_many_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for k in range(300):
        w = list(base)
        for at in rng.choice(120, rng.integers(0, 6), replace=False):
            w[at] = f"r{k}_{at}"
        texts.append(" ".join(w))
    texts += [" ".join(rng.choice(base, 100)) for _ in range(100)]
    sets = [shingle_set(t) for t in texts]
    comp = list(range(len(sets)))
    for x in range(len(sets)):
        for y in range(x):
            if 100 * len(sets[x] & sets[y]) >= 90 * len(sets[x] | sets[y]) and comp[x] != comp[y]:
                low, high = sorted((comp[x], comp[y]))
                comp = [low if c == high else c for c in comp]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()}
    assert [got[k] for k in range(len(texts))] == comp


def test_bpe(spark, rows, docs, empty):
    tok = bpe.tokenizer(BPE)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)), tuple(ids))] += 1
    got = bpe.encode_decode(docs, BPE, with_ids=True).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in got) == want
    assert bpe.encode_decode(empty, BPE).count() == 0


def test_words_of_the_tokenizer_by_code_point():
    tok = bpe.tokenizer(BPE)
    ids = lambda words: [i for w in words for i in tok.encode(w, add_special_tokens=False).ids]
    for c in [*range(0x250), 0x3A3, 0x212A, 0x301, 0x1F600, 0x5B57, 0x2028, 0xFB01]:
        for text in (f"ab{chr(c)}cd 12{chr(c)}{chr(c)}'s", chr(c), f"'{chr(c)}S  a{chr(c)}9"):
            assert ids(bpe.split_text(text, BPE)) == tok.encode(text, add_special_tokens=False).ids


def test_token_files(spark, rows, docs, empty, tmp_path):
    tok = bpe.tokenizer(BYTES)
    manifest = token_files.write_ids(docs, BYTES, 0, folder=str(tmp_path / "ids"))
    got = token_files.read_back(manifest, with_ids=True).collect()
    want = Counter((r[0], *tok.encode(r[1] or "", add_special_tokens=False).ids, 0) for r in rows)
    assert Counter((r.doc_id, *r.ids) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in ordered] == np.concatenate([[0], np.cumsum([r.n_tokens for r in ordered])[:-1]]).tolist()
    some = {rows[3][0], rows[12][0]}
    assert {r.doc_id for r in token_files.read_documents(manifest, some).collect()} == some
    assert token_files.read_back(token_files.write_ids(empty, BYTES, 0)).count() == 0


def test_damaged_frames_are_seen(tmp_path):
    writer = token_files.FileWriter(str(tmp_path), 0, 0)
    for k in range(5):
        writer.add(k, np.arange(k, 3000, dtype="<u4").tobytes())
    path = writer.close()[0]
    assert [d for d, _ in token_files.FileReader(path).read([1, 3])] == [1, 3]
    raw = bytearray(open(path, "rb").read())
    raw[40] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises(Exception):
        list(token_files.FileReader(path).read([0]))


def test_quality(spark, rows, docs, empty):
    got = quality.quality(docs)
    assert got.count() == len(rows)
    by = {r.doc_id: r for r in got.collect()}
    text = {r[0]: r[1] for r in rows}
    for i, r in by.items():
        if i is not None:
            assert r.n_words == len(WORD.findall(text[i] or "")) and r.n_symbols == len(re.findall(r"[#*$%&|<>]", text[i] or ""))
            assert not (r.base_failed and r.kept)
    assert by[rows[20][0]].n_dup_lines == 2
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == got.filter("kept").count()
    assert quality.quality(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_small_languages_keep_their_own_band(spark):
    rng = np.random.default_rng(11)
    rows = [(100, "big", float(x)) for x in rng.normal(1.6, 0.03, 3000)]
    rows += [(100, lang, float(x)) for lang, n in (("far", 200), ("few", 50), (None, 8)) for x in rng.normal(0.1, 0.03, n)]
    rows += [(100, "far", 1.6), (100, "few", 1.6)]
    got = {r.lang: r for r in quality.bands(spark.createDataFrame(rows, "__n_words long, lang string, __log_ppl double")).collect()}
    for lang in ("big", "far", "few", None):
        own = [x for _, name, x in rows if name == lang and not (x == 1.6)]
        assert np.mean([got[lang].low <= x <= got[lang].high for x in own]) > 0.99, lang
    assert got["far"].high < 1.6 and got["few"].high < 1.6


def test_gibberish_in_other_scripts_is_rejected(spark):
    rng = np.random.default_rng(12)
    letters = {"ru": "абвгдежзийклмнопрстуфхцчшщыьэюя", "el": "αβγδεζηθικλμνξοπρστυφχψω", "zh": "".join(map(chr, range(0x4E00, 0x4E00 + 600)))}
    rows = []
    for lang, own in letters.items():
        own = list(own)
        odds = rng.dirichlet(np.full(len(own), 0.4))
        vocabulary = ["".join(rng.choice(own, rng.integers(2, 9), p=odds)) for _ in range(300)]
        for k in range(200):
            words = list(rng.choice(vocabulary, 150))
            if k < 4:  # the same letters and word lengths
                mixed = rng.permutation(list("".join(words)))
                ends = np.cumsum([len(w) for w in words])
                words = ["".join(mixed[e - len(w):e]) for w, e in zip(words, ends)]
            elif k < 8:
                words = ["".join(rng.choice(own, len(w))) for w in words]
            rows.append((len(rows), " ".join(words), lang, k < 8))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, junk boolean").repartition(4)
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert [r[0] for r in rows if r[3] and r[0] in kept] == []
    assert np.mean([r[0] in kept for r in rows if not r[3]]) > 0.98


def test_wide_letters_stay_within_their_text():
    data = "aяb".encode() + "я".encode() + "bя日".encode()
    at, slots = quality.wide_slots(np.frombuffer(data, np.uint8), np.array([0, 4, 6, 12]))
    assert at.tolist() == [1, 4, 7, 9]
    assert len(set(slots["1"][:3].tolist())) == 1 and slots["1"][3] != slots["1"][0]
    assert slots["c2"][1] not in (slots["c2"][0], slots["c2"][2]) and len({*slots["3"].tolist()}) == 4


def test_character_model_sums_to_one(spark, docs):
    model = quality.train(docs).value
    p = np.exp(model.table().astype(np.float64)).reshape(-1, 1 << quality.BITS).sum(1)
    assert np.abs(p - 1).max() < 1e-3
    assert (np.diff(model.keys.astype(object)) > 0).all()


def test_model_counts_by_hand():
    data = np.frombuffer(b"abab", np.uint8)
    g = quality.grams(data, np.array([0, 2, 4]))
    assert g.tolist() == [1, 1 << 5 | 2, 1, 1 << 5 | 2]


def test_secrets(spark, rows, docs, empty):
    got = secrets.secrets(docs)
    assert got.count() == len(rows) and secrets.secrets(empty).count() == 0
    assert [r.n_hex for r in got.filter("n_assign = 1").collect()] == [1]


@pytest.mark.parametrize("wrap", [
    lambda s: __import__("urllib.parse").parse.quote(s, safe=""),
    lambda s: __import__("base64").b64encode(s.encode()).decode(),
    lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    lambda s: "".join(f"&#{ord(c)};" for c in s),
    lambda s: __import__("base64").b64encode(__import__("gzip").compress(s.encode())).decode(),
    lambda s: __import__("base64").b64encode(__import__("zstandard").compress(s.encode())).decode(),
])
def test_layers_of_secrets(wrap):
    s = 'password = "hunter2secret" é'
    for text in (wrap(s), wrap(wrap(s)), f"é é {wrap(s)} ende", f"x {wrap('y ' + wrap(s))}"):
        base, every, complete = secrets.find(text)
        assert complete and not base and len(every) == 1
        start, kind, end = every[0]
        assert kind == 0 and 0 <= start < end <= len(text)


@pytest.mark.parametrize("odd", [b"\xef\xbb\xbf", b"\xc2\xa0", b"\xe3\x80\x80", b"\xe2\x80\x8d", b"\xc2\xad", b"\x0c", b"\x0b", b"\x1b", b"\xe9", b"\x00\x01\x02\xff" * 30])
def test_layers_with_characters_that_are_not_printable(odd):
    b64, quote = __import__("base64").b64encode, __import__("urllib.parse").parse.quote
    data = odd + b' some words, password = "hunter2secret" and more of them'
    for text in (b64(data).decode(), b64(__import__("gzip").compress(data)).decode(), quote(data, safe="")):
        base, every, complete = secrets.find(f"x {text} y")
        assert complete and not base and len(every) == 1 and every[0][1] == 0, odd
    plain = secrets.find("my_secret_password_token = aHVudGVyMnNlY3JldCBvciBzbw==")
    assert len(plain[0]) == 1  # words that look like base64 keep their place


def test_layers_of_wrapped_and_partly_quoted_text():
    import base64, bz2, gzip, lzma, textwrap, urllib.parse, zlib

    rng = np.random.default_rng(8)
    noise = " ".join("".join(rng.choice(list("ghijklmnop"), 7)) for _ in range(60))
    for body in (f"{noise} password = hunter2secret {noise}", f"{noise} password = hunter2secret"):
        for pack in (lambda b: b, gzip.compress, zlib.compress, bz2.compress, lzma.compress):
            data = pack(body.encode())
            wrapped = [base64.encodebytes(data).decode(), *("\n".join(textwrap.wrap(base64.b64encode(data).decode(), w)) for w in (10, 64))]
            for lines in wrapped:
                begin = "a mail\n\n-----BEGIN DATA-----\n"
                for text in (lines, f"word: {lines}", f"{begin}{lines.strip()}\n-----END DATA-----\n", "> " + lines.strip().replace("\n", "\r\n> ") + "\r\nbye"):
                    base, every, complete = secrets.find(text)
                    assert complete and not base and len({x for x in every if x[1] == 0}) >= 1, text
                    assert all(0 <= a < b <= len(text) for a, _, b in every)
            if pack(b"") != b"":
                for text in (urllib.parse.quote(data), urllib.parse.quote_plus(data), f"q é data={urllib.parse.quote(data)}&x=1 end"):
                    base, every, _ = secrets.find(text)
                    assert not base and every, text
    data = base64.b64encode(f"{noise} password = hunter2secret".encode()).decode()
    text = data[:76] + "\n" + data[76:-5] + "\n" + data[-5:]
    start, _, end = max(secrets.find(text)[1], key=lambda x: x[2] - x[0])
    assert end >= len(text.rstrip("=")) - 1 and 32 <= end - start <= 38  # 24 bytes over at most three lines


def test_layers_end():
    loop = "%2525" * 50
    assert secrets.find(loop)[2]
    bomb = __import__("base64").b64encode(__import__("zlib").compress(b"a" * 10_000_000)).decode()
    assert not secrets.find(bomb, limit=1_000_000)[2]
    found = secrets.find("token = %61%62%63%64%65%66")
    assert found[0] == [] and found[1] == [(0, 0, 26)]


def test_an_archive_beyond_the_limit_leaves_the_rest():
    import base64, gzip, zlib

    b64 = lambda b: base64.b64encode(b).decode()
    small = [f"password = hunter2secret{k}".encode() for k in range(4)]
    bomb = b64(zlib.compress(b"token = 0123456789 " + b"a " * 5_000_000))
    text = f"one {b64(small[0])} two {bomb} three {b64(gzip.compress(small[1], mtime=0))} four {b64(b64(small[2]).encode())} %70assword%20= hunter2secret3"
    base, every, complete = secrets.find(text, limit=1_000_000)
    assert not complete and not base
    for part in (b64(small[0]), bomb, b64(gzip.compress(small[1], mtime=0)), b64(b64(small[2]).encode()), "%70assword%20= hunter2secret3"):
        at = text.index(part)
        assert any(at <= a < b <= at + len(part) for a, _, b in every), part[:30]
    many = " ".join(b64(gzip.compress(f"password = hunter2secret{k} ".encode() + b"a " * 200_000)) for k in range(12))
    every, complete = secrets.find(many, limit=1_000_000)[1:]
    assert len({a for a, _, _ in every}) == 12 and not complete


def test_toxicity(spark, rows, docs, empty):
    labels = spark.createDataFrame([(r[0], int(k % 2), None) for k, r in enumerate(rows)], "doc_id long, toxic int, score double")
    got = toxicity.score_with_labels(docs, labels)
    assert got.count() == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.collect())
    assert toxicity.score_with_labels(empty, labels).count() == 0
    assert {r.score for r in toxicity.score_with_labels(docs, labels.limit(0)).collect()} == {0.0}


def test_ftrl_learns_sparsely():
    model, rng = toxicity.Ftrl(), np.random.default_rng(0)
    for _ in range(2000):
        noise = rng.choice(np.arange(100, 5000), 30, replace=False)
        y = int(rng.random() < 0.3)
        model.learn(np.append(noise, [7] * y + [toxicity.BIAS]), y)
    used = np.flatnonzero(model.z)
    w = dict(zip(used.tolist(), model.weights(used).tolist()))
    assert w[7] > 2 and w[toxicity.BIAS] < -1
    assert sum(v != 0 for v in w.values()) < 0.2 * len(w)


def test_licenses(spark, rows, docs, empty):
    got = licenses.licenses(docs)
    assert got.count() == len(rows) and licenses.licenses(empty).count() == 0
    assert [r.licenses for r in got.filter("n_matches > 0").collect()] == [["mit"]]
    bands, size = licenses.bands_for(0.25)
    assert (1 - 0.25**size) ** bands <= licenses.MISS


def test_license_families_and_versions():
    import pyarrow as pa

    line = "This work is licensed under the GNU {}General Public License, version {}."
    notice = licenses.TEMPLATES["gpl-3.0-notice"]
    cases = [(line.format("", 2), {"gpl-2.0"}), (line.format("", 3), {"gpl-3.0"}), (line.format("Lesser ", 3), {"lgpl-3.0"}), (line.format("Affero ", 3), {"agpl-3.0"}),
             (notice, {"gpl-3.0-notice"}), (notice.replace("version 3", "version 2").replace("software:", "software;"), {"gpl-2.0-notice"}),
             (notice.replace("GNU General", "GNU Affero General"), {"agpl-3.0-notice"}), (notice.replace("GNU General", "GNU Lesser General"), {"lgpl-3.0-notice"}),
             ("Licensed under CC BY-SA 4.0.", {"cc-by-sa-4.0"}), ("Licensed under CC0 1.0.", {"cc0-1.0"}),
             ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", {"cc-by-sa-4.0-notice"}),
             (licenses.FAMILIES["bsd-3-clause"], {"bsd-3-clause"}), (licenses.TEMPLATES["bsd-2-clause"], {"bsd-2-clause"}),
             (licenses.FAMILIES["isc"], {"isc"}), (licenses.FAMILIES["unlicense"], {"unlicense"}), ("GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991", {"gpl-2.0-text"})]
    found = licenses.matches(licenses.Index(licenses.ALL), pa.array([f"some words before it {text} and some after it" for text, _ in cases]))
    assert [{m[2] for m in x} for x in found] == [want for _, want in cases]
    own = licenses.matches(licenses.Index(licenses.ALL), pa.array(list(licenses.ALL.values())))
    assert all(name in {m[2] for m in x} for name, x in zip(licenses.ALL, own))


def test_language(spark, docs, empty):
    pages = spark.createDataFrame([(1, "http://a.example.de/x", '<html lang="de-DE"><p>w1 w2 w3</p>', 1), (2, None, None, 2), (3, "not a url", "", 3), (1, "http://a.example.de/x", '<html lang="de-DE"><p>w1 w2 w3</p>', 1)], "page_id long, url string, html string, host int")
    got = language.identify(pages, docs)
    assert got.count() == 4 + docs.count()
    assert got.filter("page_id is not null and lang is null").count() == 0
    assert language.identify(pages.limit(0), empty).count() == 0
    assert {r.lang for r in language.identify(pages, empty).collect()} == {None}


def test_evidence_beats_a_short_text(spark):
    docs = spark.createDataFrame([(k, "the cat and the dog " * 5, "en", "s") for k in range(20)] + [(100 + k, "der hund und die katze " * 5, "de", "s") for k in range(20)], "doc_id long, text string, lang string, source string")
    page = lambda k, host, lang, text: (k, f"http://{host}/{k}", f'<html lang="{lang}"><p>{text}</p>')
    rows = [page(k, "x.example.de", "de", "der hund und die katze") for k in range(30)] + [page(99, "x.example.de", "de", "")]
    rows += [page(200 + k, "y.example.uk", "en", "the cat and the dog") for k in range(30)]
    got = {r.page_id: r for r in language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect() if r.page_id is not None}
    assert got[99].lang == "de" and got[0].lang == "de" and got[200].lang == "en"


def test_pipeline_on_edges(spark, docs, empty, tmp_path):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, "unused")
        assert out.columns == docs.columns, name
        path = str(tmp_path / name)
        out.write.parquet(path)
        kept = spark.read.parquet(path)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, "unused")
    assert last.count() == kept.count()
    nothing = empty
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, "unused")
    assert nothing.count() == 0


def test_pipeline_on_the_small_tables(spark):
    """Every stage against plain Python on what its predecessor kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, sf).cache()
    verdict = {r.doc_id for r in quality.quality(docs).filter("kept").collect()}
    assert {r.doc_id for r in good.collect()} == verdict
    once = stages["exact_dedup"](spark, good, sf).cache()
    first = {}
    for r in sorted(good.collect(), key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r.doc_id)
    assert {r.doc_id for r in once.collect()} == set(first.values())
    alone = stages["ngram_jaccard_join"](spark, once, sf).cache()
    left = once.collect()

    def one_of_each(size, num):
        sets = sorted((r.doc_id, shingle_set(r.text, size)) for r in left)
        comp = {i: i for i, _ in sets}
        for k, (i, a) in enumerate(sets):
            for j, b in sets[:k]:
                if a and b and 100 * len(a & b) >= num * len(a | b) and comp[i] != comp[j]:
                    low, high = sorted((comp[i], comp[j]))
                    comp = {x: low if c == high else c for x, c in comp.items()}
        return {i for i, c in comp.items() if i == c}

    assert {r.doc_id for r in alone.collect()} == one_of_each(5, 80)
    strict = corpus_pipeline.near_copies(spark, once, sf, jaccard_join.Rule())
    assert {r.doc_id for r in strict.collect()} == one_of_each(3, 90)
    mixed = stages["mix_sources"](spark, alone, sf).cache()
    plan = {r.doc_id: r.copies for r in mixing.mix(alone.withColumn("k", F.concat_ws(":", "doc_id", F.sha2("text", 256))), "k").collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({int(k.split(":")[0]): c for k, c in plan.items() if c})
    ids = stages["bpe_encode_decode"](spark, mixed, sf)
    tok = bpe.tokenizer(BPE)
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert all(r.ids == tok.encode(texts[r.doc_id], add_special_tokens=False).ids for r in ids.collect())
