import hashlib
import re

import pytest
from cases import corpus, frame, texts

from quillon.llm.substring_dedup import difference_cover, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    low, words = {}, [WORD.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[s: s + window])
                low[k] = min(low.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for s in range(len(w) - window + 1):
            if d is not None and low[tuple(w[s: s + window])] < d:
                gone |= set(range(s, s + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,period,bits", [(50, 31, 64), (50, 13, 64), (12, 7, 3), (33, 31, 6)])
def test_removal_matches_brute_force(spark, window, period, bits):
    rows = corpus(window, 70)
    # Passages at every alignment, inside one document and across documents.
    some = texts(99, 6)
    rows += [(300 + i, "pad " * i + some[2] + " end" * i) for i in range(40)]
    rows += [(400, some[0] + " " + some[0]), (401, some[5]), (290, some[5] + " tail"), (402, some[5])]
    got = remove_repeats(frame(spark, rows), window=window, period=period, anchor_bits=bits).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got), key=str) == brute(rows, window)
    for x in got:
        if x.n_removed:
            assert hashlib.sha256(x.kept_text.encode()).hexdigest() == x.kept_sha256


def test_covers():
    for p in (2, 7, 13, 20, 31, 47):
        c = difference_cover(p)
        assert {(int(a) - int(b)) % p for a in c for b in c} == set(range(p))


def test_empty(spark):
    assert remove_repeats(frame(spark, [])).count() == 0
    got = remove_repeats(frame(spark, [(1, None), (2, "")])).collect()
    assert [(x.n_words, x.n_removed) for x in got] == [(0, 0)] * 2
