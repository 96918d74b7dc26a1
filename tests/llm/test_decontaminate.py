import hashlib
import random
import re

import pytest
from cases import corpus, frame
from test_exact_dedup import FOLD

from quillon.llm.decontaminate import hits, keep_clean

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(FOLD))


def brute(docs, items, size=10):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        if i is not None and n:
            for s in range(len(w) - n + 1):
                wins.setdefault(tuple(w[s: s + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                who = wins.get(tuple(w[s: s + n]))
                if who:
                    hit |= set(range(s, s + n))
                    found |= who
        ids = sorted(found)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case(seed=4):
    r = random.Random(seed)
    docs = corpus()
    items = [(i, " ".join(words(r.choice(docs)[1])[2: r.choice([4, 12, 13, 30])]).upper()) for i in range(12)]
    items += [(20, "never seen these words here at all in any of them"), (21, ""), (22, None), (23, "!!"), (None, docs[0][1]), (3, items[3][1]), (3, "other " + (items[4][1]))]
    docs += [(200, "a-b " + items[0][1] + "," + items[0][1]), (201, (items[1][1] or "q") + "x")]
    return docs, items


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_hits(spark, most):
    docs, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = hits(frame(spark, docs), bench, broadcast_bytes=most).collect()
    mine = sorted([(x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in got], key=str)
    assert mine == brute(docs, items)
    for x in got:
        assert x.spans == sorted(set(x.spans))
        assert len({p for s in x.spans for p in range(s["first"], s["end"])}) == x.n_hit


def test_many_hits_in_one_document(spark):
    items = [(1, "red"), (2, "red blue"), (3, " ".join(["red"] * 15))]
    docs = [(1, "red " * 3000), (2, "blue red blue " * 500), (3, "blue")]
    got = hits(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted([(x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in got], key=str) == brute(docs, items)


def test_keep_clean_and_empty(spark):
    docs, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, docs)
    got = keep_clean(df, bench)
    assert sorted(str(x.doc_id) for x in got.collect()) == sorted(str(x[0]) for x in brute(docs, items) if not x[5])
    assert got.columns == df.columns
    assert hits(frame(spark, []), bench).count() == 0
    assert keep_clean(df, bench.limit(0)).count() == len(docs)
