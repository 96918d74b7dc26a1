"""Operator 5: exact deduplication with keyed streaming state, DataFrame operations only.

Texts are equal when they are identical after lower-casing A-Z. Of equal texts the row with the largest
doc_id stays. Normalised texts are staged as a table with their digests. A streaming aggregation over the staged
table, keyed by digest, keeps without expiry the winning id, a locator of its content and the number of rows in
RocksDB state, which lies on the executors' disks and in the shared folder. A locator names a staged file
and a row in it. The state is then read as a table. Digests that were hit more than once are checked by their full
bytes: the winner's text is fetched by its locator and compared with every other text that has the digest; digests
that hold different texts are split into one group for each text.

A hot digest costs no task more than one row from each task before: state and check are fed by partial
aggregates, and the join of rows to the state is one that adaptive execution splits.

Defined results: a null text is the empty text; rows that repeat id and text are copies, of which one
stays; null ids count as smallest; an empty table gives no rows; other columns are ignored by
``decide`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stores import remove, scratch
from .common import fold_ascii, settings, written

ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # A run is over after its batches, so executors need not keep the stores open.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def stage(texts: DataFrame, path: str) -> DataFrame:
    """``doc_id, sha, norm`` as a table, in which a file and a row's place in it name a row for good."""
    texts.write.parquet(path)
    return texts.sparkSession.read.schema(texts.schema).parquet(path)


def locator() -> Column:
    """Of a row of the staged table: a hash of its file's name, which holds a random part, and its place in the file."""
    return F.struct(F.xxhash64("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place")).alias("row")


def update_state(spark: SparkSession, staged_path: str, schema: T.StructType, state_path: str, digest: Callable[[Column], Column],
                 files_per_batch: int | None = None) -> None:
    """Runs all staged files that the state at ``state_path`` has not seen through the stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(staged_path).select("doc_id", locator(), digest(F.col("sha")).alias("digest"))
    state = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("winner"), F.count(F.lit(1)).alias("n"))
    with settings(spark, ROCKS):
        query = (state.writeStream.format("noop").outputMode("update").option("checkpointLocation", state_path)
                 .trigger(availableNow=True).start())
        query.awaitTermination()


def read_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The keyed state as ``digest, keep_id, keep_row, n``; an error if it is not laid out as ``update_state`` declares it."""
    with settings(spark, ROCKS):
        raw = spark.read.format("statestore").load(state_path)
    key, value = raw.schema["key"].dataType, raw.schema["value"].dataType
    laid = [f.dataType for f in value]
    if not (len(key) == 1 and len(laid) == 2 and isinstance(laid[0], T.StructType) and laid[0].names == ["doc_id", "row"] and isinstance(laid[1], T.LongType)):
        raise RuntimeError(f"the state has an unknown layout: {raw.schema.simpleString()}")
    winner, n = (F.col("value")[x] for x in value.names)
    return raw.select(F.col("key")[key.names[0]].alias("digest"), winner["doc_id"].alias("keep_id"), winner["row"].alias("keep_row"), n.alias("n"))


def decide(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = lambda sha: sha,
           broadcast_bytes: int = 32 << 20, files_per_batch: int | None = None) -> DataFrame:
    """One row for each document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``digest`` derives the state's key from the SHA-256; tests pass a weak one to force collisions.
    Repeated digests go to all tasks where their rows have at most ``broadcast_bytes``, so that only their texts are
    dealt out for the check; with more, the texts of all rows are.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), fold_ascii(F.col(text_col).cast("string")).alias("norm"))
    texts = texts.withColumn("sha", F.unhex(F.sha2(F.encode("norm", "utf-8"), 256)))
    staged_path, state_path = scratch(spark, "dedup-texts"), scratch(spark, "dedup-state")
    staged = stage(texts, staged_path)
    if staged.isEmpty():
        return staged.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"),
                             F.lit(False).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    update_state(spark, staged_path, staged.schema, state_path, digest, files_per_batch)
    state = written(read_state(spark, state_path), "dedup-groups")
    remove(spark, state_path)
    rows = written(staged.select("doc_id", locator(), "sha"), "dedup-keys").withColumn("digest", digest(F.col("sha")))
    hits = state.where("n > 1")
    few = hits.agg(F.coalesce(F.sum(F.octet_length("digest") + 16), F.lit(0)).alias("b")).first().b <= broadcast_bytes
    split = _colliding(staged, hits, digest, few)
    single = state.where("n = 1").select("digest")
    out = rows.join(F.broadcast(hits) if few else hits, "digest", "left" if few else "inner")
    if few:  # a row that meets no repeated digest is alone
        alone = F.col("n").isNull()
        out = out.select("doc_id", "row", "sha", "digest", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                         F.when(alone, F.col("row")).otherwise(F.col("keep_row")).alias("keep_row"), F.coalesce("n", F.lit(1).cast("long")).alias("n"))
    else:
        out = out.unionByName(rows.join(single, "digest", "left_semi").withColumns({"keep_id": F.col("doc_id"), "keep_row": F.col("row"), "n": F.lit(1).cast("long")}))
    if not split.isEmpty():
        out = out.join(split, "digest", "left_anti").unionByName(written(_by_text(staged, split, digest), "dedup-by-text"))
    remove(spark, staged_path)  # what follows needs the digests only
    out = out.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
                     F.lower(F.hex("sha")).alias("text_sha256"))
    return out


def _colliding(staged: DataFrame, hits: DataFrame, digest: Callable[[Column], Column], few: bool) -> DataFrame:
    """Digests that stand for more than one text: the winner's text, found by its locator, against all texts of the digest."""
    rows = staged.select(digest(F.col("sha")).alias("digest"), locator(), "norm")
    known = F.broadcast(hits.select("digest", "keep_row")) if few else hits.select("digest", "keep_row")
    some = rows.join(known, "digest")
    first = some.where(F.col("row") == F.col("keep_row")).select("digest", F.col("norm").alias("first"))
    # Of equal texts one from each task is compared, so a hot digest deals out few.
    other = some.where(F.col("row") != F.col("keep_row")).groupBy("digest", F.col("norm").alias("other")).agg(F.count(F.lit(1)).alias("copies"))
    differ = other.join(first, "digest").where(F.col("first") != F.col("other")).select("digest").distinct()
    return written(differ, "dedup-split")


def _by_text(staged: DataFrame, split: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Groups of colliding digests by the text itself."""
    rows = staged.select("doc_id", locator(), "sha", digest(F.col("sha")).alias("digest"), "norm").join(split, "digest", "left_semi")
    groups = rows.groupBy("digest", "norm").agg(F.max(F.struct("doc_id", "row")).alias("winner"), F.count(F.lit(1)).alias("n"))
    return rows.join(groups, ["digest", "norm"]).select(
        "doc_id", "row", "sha", "digest", F.col("winner.doc_id").alias("keep_id"), F.col("winner.row").alias("keep_row"), "n")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """The documents that stay, with all their columns.

    Rows to drop, of an id and 32 bytes each, go to all tasks where they have at most ``broadcast_bytes``; with more,
    texts are dealt out for the join.
    """
    plan = written(decide(docs, id_col=id_col, text_col=text_col).where("group_size > 1")
                   .select(F.col("doc_id").alias("_q_lost_id"), F.unhex("text_sha256").alias("_q_lost_sha"), "keep_id", "kept"), "dedup-plan")
    lost = plan.where(~F.col("kept") & ~F.col("_q_lost_id").eqNullSafe(F.col("keep_id"))).select("_q_lost_id", "_q_lost_sha")
    same = plan.where(~F.col("kept") & F.col("_q_lost_id").eqNullSafe(F.col("keep_id"))).select("_q_lost_id", "_q_lost_sha").distinct()
    size = lost.agg(F.coalesce(F.sum(F.octet_length(F.col("_q_lost_id").cast("string")) + 40), F.lit(0)).alias("b")).first().b
    lost = F.broadcast(lost) if size <= broadcast_bytes else lost
    sha = F.unhex(F.sha2(F.encode(fold_ascii(F.col(text_col).cast("string")), "utf-8"), 256))
    match = docs[id_col].eqNullSafe(F.col("_q_lost_id")) & (sha == F.col("_q_lost_sha"))
    kept = docs.join(lost, match, "left_anti")
    if same.isEmpty():
        return kept
    # Rows that repeat both id and text: one of them stays.
    once = kept.join(same, match, "left_semi").withColumn("_sha", sha).dropDuplicates([id_col, "_sha"]).drop("_sha")
    return kept.join(same, match, "left_anti").unionByName(once)
