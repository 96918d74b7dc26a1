"""Helpers shared by the corpus operators: the shared work folder, written tables, salting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stores import remove, scratch

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: ASCII letters, the only ones the text contracts fold.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class settings:
    """Sets session settings for a block and puts the old ones back."""

    def __init__(self, spark: SparkSession, values: dict[str, str]):
        self.spark, self.values = spark, values

    def __enter__(self) -> None:
        self.old = {k: self.spark.conf.get(k, None) for k in self.values}
        for k, v in self.values.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_) -> None:
        for k, v in self.old.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)


def written(df: DataFrame, name: str, *used: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends here.

    Shuffle files of the write go when it is over. ``used`` are written tables that nothing reads after this one; they are deleted.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    with settings(spark, {CLEANUP: "true"}):
        df.write.parquet(path)
    discard(*used)
    out = spark.read.schema(schema).parquet(path)
    out._quillon_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` returned; others are left alone."""
    for t in tables:
        path = t.__dict__.pop("_quillon_path", None)
        if path:
            remove(t.sparkSession, path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """True for documents that no model may learn labels from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fold_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; null becomes the empty text."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder. Batches to Python are kept small, as texts are long; a limit that the session has set itself stays."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
