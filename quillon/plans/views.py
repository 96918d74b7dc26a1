"""Domain views over the shared tables, each as a Spark plan and as the DuckDB SQL that makes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Minutes between the epoch and the first event day.
ORIGIN = 28401120


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``t, vec, label``: one feature vector for each frame."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("long").alias("label"))


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``t, label, d, x``: the frames' vectors element by element, d from 0."""
    return frames(spark, sf_dir).select("t", "label", F.posexplode("vec").alias("d", "x"))


def segments_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stream_id, first, last, label``: each user's events as segments of at most 31 minutes that end before the next."""
    e = table(spark, sf_dir, "events").where("user_id is not null and ts is not null")
    minute = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60000000) - ORIGIN).cast("long")
    one = e.groupBy(F.col("user_id").alias("stream_id"), minute.alias("first")).agg(F.max_by("event_type", "event_id").alias("event_type"))
    kinds = e.select("event_type").distinct().withColumn("label", F.row_number().over(Window.orderBy("event_type")).cast("long"))
    w = Window.partitionBy("stream_id").orderBy("first")
    last = F.least(F.col("first") + 30, F.lead("first").over(w) - 1)
    return one.select("*", last.alias("last")).join(F.broadcast(kinds), "event_type").select("stream_id", "first", "last", "label")


def energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stream_id, t, energy``: event values by user and minute."""
    e = table(spark, sf_dir, "events").where("user_id is not null and ts is not null")
    minute = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60000000) - ORIGIN).cast("long")
    return e.groupBy(F.col("user_id").alias("stream_id"), minute.alias("t")).agg(F.max_by("value", "event_id").alias("energy"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second day of each stream."""
    s = segments_user(spark, sf_dir).select("stream_id").distinct()
    return s.select("stream_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(30 * 1440).cast("long"), F.lit(2880).cast("long"))).alias("first")).select(
        "stream_id", "first", (F.col("first") + 1439).alias("last"), F.lit(0).cast("long").alias("label"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal labels over the frames as segments of one stream."""
    from ..operators.intervals import collapse

    return collapse(frames(spark, sf_dir).select(F.lit(0).cast("long").alias("stream_id"), "t", "label"))


def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, words``: the same words as one list for each document."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_remove(F.split(F.lower("text"), "[^a-z]+"), "").alias("words"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, pos, word``: lower-case ASCII words of the documents."""
    d = table(spark, sf_dir, "documents")
    split = F.split(F.lower("text"), "[^a-z]+")
    return d.select("doc_id", F.posexplode(F.array_remove(split, "")).alias("pos", "word"))


def gmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``label, d, weight, mean, var``: one diagonal Gaussian for each label."""
    x = dims(spark, sf_dir)
    g = x.groupBy("label", "d").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.greatest(F.var_pop("x"), F.lit(0.01)).alias("var"))
    total = frames(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"))
    return g.crossJoin(F.broadcast(total)).select("label", "d", (F.col("n") / F.col("total")).alias("weight"), "mean", "var")


#: The same views for DuckDB.
SQL = {
    "frames": "SELECT vec_id AS t, list_transform(embedding, lambda v: v::DOUBLE) AS vec, label::BIGINT AS label FROM embeddings",
    "dims": "SELECT vec_id AS t, label::BIGINT AS label, unnest(range(0, len(embedding)))::BIGINT AS d, unnest(embedding)::DOUBLE AS x FROM embeddings",
    "minutes": f"SELECT user_id AS stream_id, epoch_us(ts)//60000000-{ORIGIN} AS first, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS energy FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2",
    "segments_user": "SELECT stream_id, first, least(first + 30, lead(first) OVER (PARTITION BY stream_id ORDER BY first) - 1) AS last, label FROM minutes JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) AS label FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)) USING (event_type)",
    "energy": "SELECT stream_id, first AS t, energy FROM minutes",
    "regions": "SELECT stream_id, first, first + 1439 AS last, 0::BIGINT AS label FROM (SELECT stream_id, unnest(range(0, 43201, 2880)) AS first FROM (SELECT DISTINCT stream_id FROM segments_user))",
    "runs": "SELECT 0::BIGINT AS stream_id, min(t) AS first, max(t) AS last, label FROM (SELECT t, label, t - row_number() OVER (PARTITION BY label ORDER BY t) AS g FROM frames) GROUP BY label, g",
    "words": "SELECT doc_id, unnest(range(0, len(w)))::BIGINT AS pos, unnest(w) AS word FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)",
    "gmm": "SELECT label, d, count(*) / (SELECT count(*) FROM frames) AS weight, avg(x) AS mean, greatest(var_pop(x), 0.01) AS var FROM dims GROUP BY label, d",
}

_NEEDS = {"segments_user": ["minutes"], "energy": ["minutes"], "regions": ["minutes", "segments_user"], "runs": ["frames"], "gmm": ["frames", "dims"]}


def with_views(query: str, *names: str, **more: str) -> str:
    """A query after the views that it names, and further common tables."""
    order: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    # Materialised, so that a table that is used more than once is made once.
    parts = [f"{n} AS MATERIALIZED ({SQL[n]})" for n in order] + [f"{n} AS MATERIALIZED ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)} {query}"
