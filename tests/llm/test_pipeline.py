import random

import pytest
from pyspark.sql import types as T
from test_decontaminate import brute as leaks
from test_exact_dedup import FOLD
from test_jaccard import brute as near

import corpus_pipeline
from quillon.llm import jaccard_join, quality
from quillon.llm.common import settings

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    rows, labels, items = [], [], [(i, say(25)) for i in range(5)]
    for i in range(200):
        if i % 4 == 0:
            text = " ".join(r.choice(["WIN!!", "$$$", "%%%", "NOW!!", "FREE###"]) for _ in range(r.randint(10, 60)))
        elif i % 4 == 1 and i > 40:
            text = rows[r.randrange(1, i)][1]
            text = text.upper() if i % 8 == 1 else text + " " + r.choice(vocab)
        elif i % 20 == 2:
            text = say(20) + " " + items[i % 5][1].upper() + "! " + say(10)
        else:
            text = say(r.randint(20, 120))
        rows.append((i, text))
        labels.append((i, int(i % 4 > 0), 0))
    rows += [(200, None), (201, "")]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, items


def test_stages_match_brute_force_on_their_own_inputs(spark, sf_dir, tmp_path):
    d, items = sf_dir
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(x.doc_id, x.text) for x in docs.collect()]
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 4:
            break
        assert after.columns == docs.columns
        got = sorted(x.doc_id for x in after.collect())
        if k == 0:
            s = quality.Scorer(model).score([t for _, t in before])
            want = [i for (i, _), v in zip(before, s, strict=True) if v >= 0.5]
            # Texts of junk marks alone go, but for few, and all others stay; texts without a byte follow the share of good labels.
            marks = {"WIN!!", "$$$", "%%%", "NOW!!", "FREE###"}
            junk = {i for i, t in before if t and not set(t.split()) - marks}
            assert {i for i, t in before if not set((t or "").split()) & marks} <= set(want)
            assert len(junk & set(want)) < 0.15 * len(junk)
        elif k == 1:
            want = list({(t or "").translate(FOLD): i for i, t in sorted(before)}.values())
        elif k == 2:
            want = [i for i, _, c in near(before, 5, 80) if i == c]
        else:
            want = [x[0] for x in leaks(before, items) if not x[5]]
        assert got == sorted(want)
        assert 0 < len(got) < len(before)
        docs = after
    assert {x.doc_id for x in after.collect()} == {x[0] for x in before}
    whole = corpus_pipeline.run(spark, d)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sum(x.length for x in whole.collect()) == sum(x.length for x in after.collect())
    assert set(whole.columns) == set(after.columns) >= set(columns)


def test_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns


def test_near_stage_of_texts_with_common_passages(spark, monkeypatch):
    """Two passages of rare words, each in over a hundred texts, bring no texts but the two near copies into a cluster."""
    r = random.Random(5)
    passages = [" ".join(f"{p}{i}" for i in range(14)) for p in "pq"]
    body = [" ".join(f"w{r.randrange(40)}" for _ in range(120)) for _ in range(130)]
    rows = [(i, " ".join([b] + passages[:1] * (i < 105) + passages[1:] * (i >= 25))) for i, b in enumerate(body)]
    rows.append((130, rows[50][1] + " w1"))
    seen, verify = [], jaccard_join.verified_links

    def counted(docs, members, **options):
        seen.append(members.count())
        return verify(docs, members, **options)

    monkeypatch.setattr(jaccard_join, "verified_links", counted)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = corpus_pipeline.near_stage(spark, docs, "").collect()
    assert sorted(x.doc_id for x in got) == sorted(d for d, _, c in near(rows, 5, 80) if c == d) == list(range(130))
    assert seen[0] < 10


def test_near_stage_of_many_members_deals_out_no_other_texts(spark, monkeypatch):
    """Members beyond the broadcast's limit are verified in rounds; before, all texts were dealt out by their ids."""
    r = random.Random(6)
    body = [" ".join(f"w{r.randrange(4000)}" for _ in range(60)) for _ in range(90)]
    rows = [(i, b) for i, b in enumerate(body)] + [(100 + i, b + " x") for i, b in enumerate(body[:40])]
    plans, write = [], jaccard_join.written

    def seen(df, name, *used):
        if name == "links":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, *used)

    monkeypatch.setattr(jaccard_join, "written", seen)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        got = jaccard_join.keep_representatives(docs, size=5, percent=80, broadcast_bytes=2000).collect()
    assert sorted(x.doc_id for x in got) == list(range(90))
    assert len([x for x in plans if "FlatMapGroupsInArrow" in x]) == 4
    assert not [x for x in plans if "SortMergeJoin" in x or "ShuffledHashJoin" in x]
