"""Operator 2: token ids in ORC.

A dataset is a folder of ORC files. Rows are ordered by document id, over the files too; each holds
``doc_id, part, local_start, n_tokens, ids``. ORC stores the ids with run-length encoded integers,
keeps row indexes for each stride of rows and Bloom filters for ``doc_id``, so a reader takes stripes
in parallel and skips those whose minimum, maximum or filter rule a document out.

Defined results: a null or empty text is a document of the end id alone; rows that repeat a doc_id are
kept, in the order of their texts' hashes and then texts; null ids come first; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stores import scratch
from .common import shuffle_parts
from .wordbpe import default_tokenizer, encoder, gathered_rows, with_end
from .workers import lean


def write_tokens(docs: DataFrame, path: str | None = None, tokenizer_path: str | None = None, *, end_id: int = 2,
                 id_col: str = "doc_id", text_col: str = "text", files: int | None = None,
                 stripe_bytes: int = 64 << 20, stride: int = 1000) -> str:
    """Encodes the documents and writes the dataset; returns its path.

    Texts, not ids, are dealt out by id range: the range sampling then reads the source again but does
    not encode again. Each task numbers the ids of its own range; ``token_rows`` adds what stands before.
    """
    spark = docs.sparkSession
    tok = tokenizer_path or default_tokenizer()
    path = path or scratch(spark, "tokens")
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema[0].dataType
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    sliced = src.repartitionByRange(files or shuffle_parts(spark), *order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, start = encoder(tok), TaskContext.get().partitionId(), 0
        for table, texts in gathered_rows(batches, 1, 20 << 20, enc.plain):
            doc = table.column(0).combine_chunks()
            for lo, hi, ids, n in enc.encode_rows(texts):
                ids, n = with_end(ids, n, end_id)
                ends = np.concatenate(([0], np.cumsum(n)))
                lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [doc.slice(lo, hi - lo), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(start + ends[:-1]), pa.array(n), lists],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"])
                start += int(ends[-1])

    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("part", T.IntegerType()), T.StructField("local_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    (sliced.mapInArrow(lean(run, "encoder"), schema).write
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.create.index", "true").option("orc.row.index.stride", str(stride))
     .option("orc.stripe.size", str(stripe_bytes)).option("compression", "zstd").orc(path))
    return path


def token_rows(spark: SparkSession, path: str) -> DataFrame:
    """The dataset's rows ``doc_id, start, n_tokens, ids``; filters on doc_id reach the ORC reader.

    The ids before each file are a running sum over one row of two numbers for each file, which is the only single-task
    step; those rows are few enough to go to all tasks, so the ids themselves never move.
    """
    rows = spark.read.orc(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    return (rows.join(F.broadcast(parts), "part")
            .select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids"))


def with_crc32(rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: the unsigned crc32 of the ids as little-endian 32-bit integers."""
    schema = T.StructType([rows.schema["doc_id"], T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            flat, at = ids.flatten().to_numpy(zero_copy_only=False).astype("<i4"), np.diff(ids.offsets.to_numpy())
            ends = np.cumsum(at)
            crc = [zlib.crc32(flat[e - n: e].tobytes()) for e, n in zip(ends.tolist(), at.tolist(), strict=True)]
            count = pa.array(at.astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), count, pa.array(crc, type=pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(lean(run), schema)


def read_document(spark: SparkSession, path: str, doc_ids: list) -> DataFrame:
    """Rows of some documents, found by the files' row indexes and Bloom filters."""
    return spark.read.orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")
