"""The banded alignment equals the whole table, ties included, and long transcripts with few edits stay cheap."""

import random
import resource
import time

import pytest

from clipmill.functions import align


def words(rnd, base, edits, alphabet):
    out = list(base)
    for _ in range(edits):
        at = rnd.randrange(len(out) + 1)
        kind = rnd.randrange(3)
        if kind == 0 or at == len(out):
            out.insert(at, rnd.choice(alphabet))
        elif kind == 1:
            del out[at]
        else:
            out[at] = rnd.choice(alphabet)
    return out


def run(pairs):
    stamp = lambda row: [align.NO_STAMP if i % 5 == 0 else 100 * i for i in range(len(row))]
    e, p = [a for a, _ in pairs], [b for _, b in pairs]
    return align._batch(e, p, [stamp(x) for x in e], [stamp(x) for x in e], [stamp(x) for x in p], [stamp(x) for x in p])


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh"])
def test_band_equals_the_whole_table(monkeypatch, alphabet):
    rnd = random.Random(4)
    pairs = []
    for k in range(60):
        base = [rnd.choice(alphabet) for _ in range(rnd.randrange(0, 60))]
        other = words(rnd, base, rnd.randrange(0, 12), alphabet) if k % 3 else [rnd.choice(alphabet) for _ in range(rnd.randrange(0, 60))]
        pairs.append((base, other))
    whole = run(pairs)
    monkeypatch.setattr(align, "_LONG", 1)
    for band in (1, 2, 5):
        monkeypatch.setattr(align, "_BAND", band)
        assert run(pairs).equals(whole)
        assert all(run([pair]).equals(whole.iloc[[k]].reset_index(drop=True)) for k, pair in enumerate(pairs))


def test_long_transcripts_with_few_edits():
    rnd = random.Random(9)
    alphabet = [f"w{k}" for k in range(2000)]
    base = [rnd.choice(alphabet) for _ in range(60_000)]
    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    got = run([(base, words(rnd, base, 60, alphabet))]).iloc[0]
    assert 0 < got.substitutions + got.insertions + got.deletions <= 60
    assert time.process_time() - start < 60
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 500
