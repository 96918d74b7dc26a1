"""Vector and sound files. Binary files are read whole, one for each task, and decoded with little-endian numpy types (FMT-1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename


def decode_pcm(files: DataFrame) -> DataFrame:
    """``stream_id, pcm`` of (stream_id, content): 16-bit little-endian samples, an odd last byte is left out. For tables and streams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), 256):  # samples take several times the room of the files
                pdf = whole.iloc[lo: lo + 256]
                yield pdf[["stream_id"]].assign(pcm=[np.frombuffer(c, dtype="<i2", count=len(c) // 2).astype(np.int32) for c in pdf["content"]])

    return files.select(F.col("stream_id").cast("string"), "content").mapInPandas(run, "stream_id string, pcm array<int>")


def read_pcm(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SRC-1: raw 16-bit little-endian mono sound of a file, a folder or a list of them as ``stream_id, pcm``."""
    return decode_pcm(spark.read.format("binaryFile").load(path).select(basename(F.col("path")).alias("stream_id"), "content"))


def stream_pcm(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """SRC-16: the same from a folder into which files of sound keep coming, as a stream."""
    files = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
             .option("maxFilesPerTrigger", files_per_batch).load(path))
    return decode_pcm(files.select(basename(F.col("path")).alias("stream_id"), "content"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2: files of an int32 dimension and float32 rows as ``stream_id, t, vec``; a cut last row is left out."""
    files = spark.read.format("binaryFile").load(path).select(basename(F.col("path")).alias("stream_id"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, c in zip(pdf["stream_id"], pdf["content"], strict=True):
                dim = int(np.frombuffer(c, dtype="<i4", count=1)[0])
                n = (len(c) - 4) // (4 * dim)
                rows = np.frombuffer(c, dtype="<f4", count=n * dim, offset=4).astype(np.float64).reshape(n, dim)
                for lo in range(0, n, 10_000):
                    yield pd.DataFrame({"stream_id": name, "t": np.arange(lo, min(n, lo + 10_000)), "vec": list(rows[lo: lo + 10_000])})

    return files.mapInPandas(run, "stream_id string, t long, vec array<double>")


def encode_vectors(frames: DataFrame) -> DataFrame:
    """SNK-2: one binary file body for each stream of (stream_id, t, vec): ``stream_id, content``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack(pdf.sort_values("t")["vec"].to_numpy()).astype("<f4")
        head = np.array([rows.shape[1]], dtype="<i4").tobytes()
        return pd.DataFrame({"stream_id": [pdf["stream_id"].iloc[0]], "content": [head + rows.tobytes()]})

    return frames.select(F.col("stream_id").cast("string"), "t", "vec").groupBy("stream_id").applyInPandas(run, "stream_id string, content binary")


def read_text_vectors(spark: SparkSession, path: str, mean: list[float] | None = None, std: list[float] | None = None) -> DataFrame:
    """SRC-3: lines of numbers up to the first empty one as ``stream_id, t, vec``; with a distribution, standardised."""
    files = spark.read.text(path, wholetext=True).select(basename(F.col("_metadata.file_path")).alias("stream_id"), F.split("value", "\n").alias("lines"))
    size = F.array_position(F.transform("lines", lambda x: F.trim(x) == ""), True)
    kept = files.withColumn("lines", F.when(size > 0, F.slice("lines", F.lit(1), size.cast("int") - 1)).otherwise(F.col("lines")))
    rows = kept.select("stream_id", F.posexplode("lines").alias("t", "line"))
    vec = F.transform(F.split(F.trim("line"), "\\s+"), lambda x: x.cast("double"))
    if mean is not None:
        m, s = (F.array(*[F.lit(float(x)) for x in v]) for v in (mean, std))
        vec = F.zip_with(F.zip_with(vec, m, lambda x, y: x - y), s, lambda x, y: x / y)
    return rows.select("stream_id", F.col("t").cast("long").alias("t"), vec.alias("vec"))


def write_posteriors(matrix: DataFrame, path: str, models: list[int]) -> None:
    """SNK-9: lines of a frame's posteriors, one column for each model."""
    wide = matrix.groupBy("t").pivot("model_id", models).agg(F.first("posterior"))
    wide.orderBy("t").select(F.concat_ws(" ", *[F.format_string("%f", F.coalesce(str(m), F.lit(0.0))) for m in models]).alias("value")).write.mode("overwrite").text(path)
