import random
import re

import numpy as np
import pyarrow as pa
import pytest
from cases import corpus, frame
from test_exact_dedup import FOLD

from quillon.llm import jaccard_join, wordhash
from quillon.llm.components import components
from quillon.llm.jaccard_join import block_links, join, keep_representatives, link

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=4):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i: i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size=4, percent=85):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def families(seed):
    """Texts around the threshold: copies with a growing number of changed words."""
    r, out = random.Random(seed), []
    for _ in range(6):
        base = [f"w{r.randrange(60)}" for _ in range(r.choice([3, 5, 20, 80]))]
        for _ in range(8):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"z{r.randrange(5)}"
            out.append(" ".join(w[r.randrange(2):]))
    return list(enumerate(out, start=1000))


@pytest.mark.parametrize("options", [{}, {"block_shingles": 60}, {"top_words": 3}, {"top_words": 0}, {"hot_list": 1}, {"hot_list": 2, "block_shingles": 200, "broadcast_bytes": 0}])
def test_components_match_brute_force(spark, options):
    rows = corpus() + families(3)
    got = join(frame(spark, rows), **options).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == brute(rows)


@pytest.mark.parametrize("size,percent", [(5, 80), (2, 50)])
def test_other_thresholds(spark, size, percent):
    rows = corpus(7, 40) + families(8)
    got = join(frame(spark, rows), size=size, percent=percent).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == brute(rows, size, percent)


@pytest.mark.parametrize("options", [{}, {"block_shingles": 150}])
def test_links_cover_every_pair_of_different_sets(spark, options):
    rows = families(5)
    docs, classes, links = link(frame(spark, rows), **options)
    cid = {(x.k1, x.k2): x.cid for x in classes.collect()}
    key = {x.doc_id: cid[x.k1, x.k2] for x in docs.collect()}
    got = {frozenset((x.a, x.b)) for x in links.collect()}
    sets = {key[d]: shingles(t) for d, t in rows}
    want = {frozenset((a, b)) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert got == want


def test_sets_of_one_size_and_prefix_are_compared_with_each_other(spark):
    """They differ in frequent words only, and no other document holds a shingle of their prefix."""
    r = random.Random(6)
    often, seldom = [f"c{i}" for i in range(120)], [f"s{i}" for i in range(60)]
    rows = [(1, " ".join(seldom + often)), (2, " ".join(seldom + often[:-1] + ["c5"]))]
    rows += [(100 + i, " ".join(r.sample(often, 60))) for i in range(30)]
    assert (2, 177, 1) in brute(rows)
    for options in ({}, {"broadcast_bytes": 0}):
        got = join(frame(spark, rows), **options).collect()
        assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == brute(rows)
    assert link(frame(spark, rows))[2].count() == 1


@pytest.mark.parametrize("options", [{"late_list": 1}, {"late_list": 1, "late_shingles": 25, "late_rounds": 4, "hot_list": 2, "broadcast_bytes": 0}])
def test_shingles_put_last_lose_no_link(spark, options):
    rows = corpus() + families(3) + families(4)[:20] + [(None, "n1 n2 n3 n4 n5"), (1001, "n1 n2 n3 n4 n5 n6")]
    got = join(frame(spark, rows), **options).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == brute(rows)


def test_passages_of_many_texts_tie_no_cluster(spark, monkeypatch):
    """Rare words in passages that over a hundred texts hold; before, all texts were dealt to one cluster and met in all pairs of blocks."""
    r = random.Random(2)
    passages = [" ".join(f"{p}{i}" for i in range(12)) for p in "pq"]
    body = [" ".join(f"w{r.randrange(40)}" for _ in range(120)) for _ in range(130)]
    rows = [(i, " ".join([b] + passages[:1] * (i < 105) + passages[1:] * (i >= 25))) for i, b in enumerate(body)]
    rows.append((130, rows[50][1] + " w1"))
    seen, verify = [], jaccard_join.verified_links

    def counted(docs, members, **options):
        seen.append(members.count())
        return verify(docs, members, **options)

    monkeypatch.setattr(jaccard_join, "verified_links", counted)
    got = join(frame(spark, rows)).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == brute(rows)
    assert seen[0] < 10


@pytest.mark.parametrize("options", [{"pair_rows": 1}, {"pair_rows": 50, "hot_list": 2}, {"pair_rows": 1, "broadcast_bytes": 0}, {"round_shingles": 300},
                                     {"round_shingles": 300, "broadcast_bytes": 0, "block_shingles": 200, "most_rounds": 3}])
def test_rounds_lose_no_link(spark, options):
    rows = corpus() + families(3) + families(4)[:20] + [(None, "n1 n2 n3 n4 n5"), (1001, "n1 n2 n3 n4 n5 n6")]
    got = join(frame(spark, rows), **options).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == brute(rows)


@pytest.mark.parametrize("percent,few,many", [(10, 1000, 10_000), (100, 30, 30)])
def test_bands_of_sizes_at_round_thresholds(spark, percent, few, many):
    rows = [(d, " ".join(f"w{i}" for i in range(n))) for d, n in ((1, few), (2, many), (3, many + 1))]
    got = join(frame(spark, rows), size=1, percent=percent, hot_list=1).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == brute(rows, 1, percent)


def test_forest_joins_what_all_links_join():
    r = np.random.default_rng(4)
    for _ in range(40):
        base = np.sort(r.choice(1000, 60, replace=False)).astype(np.uint64)
        sets = []
        for _ in range(int(r.integers(1, 30))):
            s = base.copy() if r.random() < 0.7 else r.choice(1000, 60, replace=False).astype(np.uint64)
            at = r.choice(60, int(r.integers(0, 9)), replace=False)
            s[at] = r.integers(2000, 2200, len(at))
            sets.append(np.unique(s))
        for split in {len(sets), (len(sets) + 1) // 2}:
            n = len(sets)

            def parts(pairs, n=n):
                root = list(range(n))
                for _ in range(n):
                    for a, b in pairs:
                        root[a] = root[b] = min(root[a], root[b])
                return root

            left, right = sets[:split], sets[split:]
            every, some = block_links(left, right, 85, False), block_links(left, right, 85, True)
            inside = [p for half, at in ((left, 0), (right, split)) if half for p in [(a + at, b + at) for a, b in block_links(half, [], 85, False)]]
            assert parts(every + inside) == parts(some + inside)
            assert len(set(every)) == len(every)


def test_keep_representatives_and_empty(spark):
    rows = [(3, "a b c d e"), (2, "A b c d e"), (9, "x"), (4, None), (5, ""), (6, "x")]
    got = keep_representatives(frame(spark, rows))
    assert sorted(x.doc_id for x in got.collect()) == [2, 4, 5, 6] and "lang" in got.columns
    assert join(frame(spark, [])).count() == 0


@pytest.mark.parametrize("most", [2_000_000, 40, 3])
def test_components_of_chains_and_stars(spark, most):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, x) for x in range(101, 140)] + [(200, 200)]
    r.shuffle(edges)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), most).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100)}


def test_word_hashes():
    texts = ["a b  c", None, "", "b\x0bc", "xé\ty", "c", " lead", "A b", "x\x85y x y"]
    seen = {}
    for most in (1, 5, 1 << 20):
        got = []
        for lo, hi, data, offsets in wordhash.text_slices(pa.array(texts), most):
            s, e, first = wordhash.word_spans(data, offsets)
            h = wordhash.word_hashes(data, s, e)
            got += [h[first[i]: first[i + 1]].tolist() for i in range(hi - lo)]
        words = [WORD.findall(t or "") for t in texts]
        assert [len(g) for g in got] == [len(w) for w in words]
        for g, w in zip(got, words, strict=True):
            for a, b in zip(g, w, strict=True):
                assert seen.setdefault(b, a) == a
    assert len(set(seen.values())) == len(seen)
    h = np.arange(9, dtype=np.uint64)
    assert (wordhash.rolling(np.concatenate([h, h]), 3)[:7] == wordhash.rolling(np.concatenate([h, h]), 3)[9:16]).all()
