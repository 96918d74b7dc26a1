"""Model, language-model, lexicon and accumulator stores: Parquet tables with checked columns (SRC-10, SRC-11, SNK-7, SNK-10)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Columns that a store of each kind must have.
KINDS = {
    "gmm": ("model_id", "comp_id", "weight", "mean", "var"),
    "hmm": ("model", "state", "gmm_id", "log_self", "log_next"),
    "ngram": ("n", "w1", "w2", "w3", "p", "bo"),
    "trie": ("node_id", "parent_id", "phone", "depth", "word_id"),
    "accumulators": ("d", "n", "w", "sx", "sxx"),
    "clusters": ("cluster", "frames", "weight", "mean", "var"),
}


def write(df: DataFrame, path: str, kind: str, partition_by: list[str] | None = None) -> None:
    """Writes a store; ``partition_by`` makes one folder for each value, such as a phone's training records."""
    lacking = set(KINDS[kind]) - set(df.columns)
    if lacking:
        raise ValueError(f"a {kind} store needs {sorted(lacking)}")
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    df = spark.read.parquet(path)
    lacking = set(KINDS[kind]) - set(df.columns)
    if lacking:
        raise ValueError(f"{path} is no {kind} store: it lacks {sorted(lacking)}")
    return df


#: Temporary folders of single-machine sessions, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for this application's tables that the driver and all executors can reach, below ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder serves, but on a single machine only; a cluster without a shared
    folder is an error, as other executors would not see what one has written.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    name = spark.sparkContext.applicationId
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on {master or 'a cluster'}")
        if name not in _LOCAL:
            _LOCAL[name] = "file://" + tempfile.mkdtemp(prefix="quillon-")
        base = _LOCAL[name]
    return f"{base.rstrip('/')}/quillon-{name}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has written below the shared folder; results that read from it must have been taken."""
    remove(spark, shared_dir(spark))


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that ``scratch`` named, whatever store they are in."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def round_trip(df: DataFrame, kind: str = "gmm") -> DataFrame:
    """The table as it comes back from a store."""
    path = scratch(df.sparkSession, kind)
    write(df, path, kind)
    return read(df.sparkSession, path, kind)


def materialised(df: DataFrame, name: str = "step", *used: DataFrame) -> DataFrame:
    """df written as Parquet and read again, which ends its lineage: for loops.

    ``used`` are such tables that nothing reads after this one; they are deleted.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    remove(spark, *[p for p in (t.__dict__.pop("_quillon_path", None) for t in used) if p])
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out
