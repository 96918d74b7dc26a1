import hashlib

import pytest
from cases import corpus, frame
from pyspark.sql import functions as F

from quillon.llm.common import settings
from quillon.llm.exact_dedup import ROCKS, decide, keep_one, locator, read_state, stage, update_state

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    out = []
    for i, t in rows:
        norm = (t or "").translate(FOLD)
        ids = groups[norm]
        out.append((i, max(ids, key=lambda x: -1 if x is None else x), len(ids), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = corpus() + [(100, "É"), (101, "é"), (102, "ABC"), (103, "abc")]


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("most", [1 << 25, 0])
def test_groups(spark, weak, most):
    digest = (lambda sha: F.substring(sha, 1, 0)) if weak else (lambda sha: sha)
    got = decide(frame(spark, ROWS), digest=digest, broadcast_bytes=most).collect()
    assert sorted([(x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got], key=str) == brute(ROWS)
    kept = [x for x in got if x.kept]
    assert len(kept) == len({x.text_sha256 for x in got}) and all(x.doc_id == x.keep_id for x in kept)


def test_small_batches_keep_state(spark):
    got = decide(frame(spark, ROWS, 5), files_per_batch=1).collect()
    assert sorted([(x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got], key=str) == brute(ROWS)


def test_state_grows_with_later_files(spark, tmp_path):
    staged, state = str(tmp_path / "k"), str(tmp_path / "s")
    texts = lambda rows: spark.createDataFrame([(i, t.encode(), t) for i, t in rows], "doc_id long, sha binary, norm string").coalesce(1)
    table = stage(texts([(1, "a"), (2, "b")]), staged)
    update_state(spark, staged, table.schema, state, lambda x: x)
    texts([(9, "a"), (3, "b")]).write.mode("append").parquet(staged)
    update_state(spark, staged, table.schema, state, lambda x: x)
    got = read_state(spark, state)
    assert sorted((bytes(x.digest), x.keep_id, x.n) for x in got.collect()) == [(b"a", 9, 2), (b"b", 3, 2)]
    # The locators lead to the winners' contents.
    found = got.join(spark.read.parquet(staged).select(locator(), "doc_id", "norm"), F.col("keep_row") == F.col("row"))
    assert sorted((x.keep_id, x.doc_id, x.norm) for x in found.collect()) == [(3, 3, "b"), (9, 9, "a")]


def test_unknown_state_is_an_error(spark, tmp_path):
    staged, state = str(tmp_path / "k"), str(tmp_path / "s")
    spark.range(3).write.parquet(staged)
    rows = spark.readStream.schema("id long").parquet(staged).groupBy("id").agg(F.sum("id").alias("s"), F.max("id").alias("m"))
    with settings(spark, ROCKS):
        rows.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    with pytest.raises(RuntimeError, match="unknown layout"):
        read_state(spark, state)


def test_keep_one_keeps_columns(spark):
    df = frame(spark, ROWS)
    got = keep_one(df).collect()
    best = {t: k for _, k, _, t in brute(ROWS)}
    assert sorted(str(x.doc_id) for x in got) == sorted(str(k) for k in best.values())
    assert got[0].asDict().keys() == set(df.columns)


def test_empty(spark):
    assert decide(frame(spark, [])).count() == 0
    assert keep_one(frame(spark, [])).count() == 0
