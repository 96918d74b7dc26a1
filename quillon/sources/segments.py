"""Segment and region files: lines of text to segments and back.

A segment line is ``SPEAKER label warp begin length <NA> <NA> name <NA> [text]``, with times in seconds of 100 frames. Readers
and writers keep the classic frame rules: a length that is read gives a last frame one lower than a length that is written,
so each round trip shortens a segment by a frame; regions truncate where segments round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SOUND = 0


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, pos, line`` of text files that are read whole, so that positions are those in the file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\r?\n").alias("lines"))
    return files.select("file", F.posexplode("lines").alias("pos", "line"))


def in_order(lines: DataFrame, key: str, *order: str) -> DataFrame:
    """``value`` lines of a key together and in order, for the files of a text writer.

    They are dealt out by a hash that no table is dealt out by yet. Spark takes a union of tables that are dealt out by the key for
    dealt out itself, though their partitions may have been put together in different ways, and lines would stand in different files.
    """
    return lines.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order).select("value")


def lines_below(spark: SparkSession, path: str, heading: Column) -> DataFrame:
    """``file, line, own, under`` of text files: what ``heading`` makes of a line, and of the last line up to it that is not null.

    Files are read in blocks. A block is gone through in order, and one row for each block brings the heading before it.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = spark.read.text(path).select(F.col("value").alias("line"), at.alias("at"), F.monotonically_increasing_id().alias("pos")).select("at.*", "pos", "line")
    rows = rows.withColumn("own", heading)
    inside = F.last("own", ignorenulls=True).over(Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.where("own is not null").groupBy("file", "block").agg(F.max_by("own", "pos").alias("end"))
    blocks = rows.select("file", "block").distinct().join(ends, ["file", "block"], "left")
    before = F.last("end", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("inside", inside).join(F.broadcast(blocks.select("file", "block", before.alias("before"))), ["file", "block"]).select(
        "file", "line", "own", F.coalesce("inside", "before").alias("under"))


def read_segments(spark: SparkSession, path: str, label_map: dict[str, int] | None = None, prefix_len: int = 0, filler: int | None = None,
                  least_gap: int = 5, check: bool = True) -> DataFrame:
    """SRC-4: ``stream_id, first, last, label, warp, info``; other lines are skipped.

    The label comes from ``label_map``, where an unknown name ends the job, or from the digits after ``prefix_len``
    characters. ``filler`` fills gaps of more than ``least_gap`` frames. Segments must be sorted and disjoint when ``check`` is on.
    """
    p = F.split(F.trim("value"), "\\s+", 10)
    rows = spark.read.text(path).where(F.col("value").startswith("SPEAKER")).select(p.alias("p"))
    first = F.floor(F.col("p")[3].cast("double") * 100 + 0.5)
    last = F.floor(F.col("p")[4].cast("double") * 100 + 0.5) + first - 2
    name = F.col("p")[7]
    if label_map is None:
        label = F.coalesce(F.regexp_extract(F.substring(name, prefix_len + 1, 1 << 20), r"^\d+", 0).try_cast("long"), F.lit(0).cast("long"))
    else:
        table = F.create_map(*[F.lit(x) for kv in label_map.items() for x in kv])
        label = F.coalesce(table[name].cast("long"), F.raise_error(F.concat(F.lit("unknown label "), name)).cast("long"))
    segs = rows.select(F.col("p")[1].alias("stream_id"), first.alias("first"), last.alias("last"), label.alias("label"), F.col("p")[2].cast("int").alias("warp"), F.get("p", F.lit(9)).alias("info"))
    w = Window.partitionBy("stream_id").orderBy("first", "last")
    if check:
        bad = F.col("first") <= F.lag("last").over(w)
        segs = segs.withColumn("first", F.when(bad, F.raise_error(F.lit("segments overlap")).cast("long")).otherwise(F.col("first")))
    if filler is not None:
        gap = segs.select("stream_id", (F.col("last") + 1).alias("first"), (F.lead("first").over(w) - 1).alias("last")).where(F.col("last") - F.col("first") + 1 > least_gap)
        segs = segs.unionByName(gap.select("*", F.lit(filler).cast("long").alias("label"), F.lit(None).cast("int").alias("warp"), F.lit(None).cast("string").alias("info")))
    return segs


def segment_lines(segs: DataFrame, prefix: str = "SPK", warp: int | None = None, names: dict[int, str] | None = None) -> DataFrame:
    """SNK-1: ``stream_id, ord, sub, value``: a SPKR-INFO line before the first segment of each label, a SPEAKER line for each."""
    name = F.when(F.col("label") == SOUND, "SOUND").otherwise(F.format_string(f"{prefix}%02d", F.col("label")))
    if names:
        name = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("label")]
    own_warp = F.lit(warp) if warp is not None else (F.coalesce("warp", F.lit(0)) if "warp" in segs.columns else F.lit(0))
    info = F.coalesce(F.concat(F.lit(" "), F.col("info")), F.lit("")) if "info" in segs.columns else F.lit("")
    w = Window.partitionBy("stream_id")
    rows = segs.select(F.col("stream_id").cast("string"), "first", "last", "label", name.alias("name"), own_warp.alias("warp"), info.alias("info"))
    rows = rows.withColumn("ord", F.row_number().over(w.orderBy("first", "last"))).withColumn("new", F.row_number().over(Window.partitionBy("stream_id", "label").orderBy("first", "last")) == 1)
    intro = rows.where("new").select("stream_id", "ord", F.lit(0).alias("sub"), F.format_string("SPKR-INFO %s 1 <NA> <NA> <NA> unknown %s <NA>", "stream_id", "name").alias("value"))
    main = rows.select("stream_id", "ord", F.lit(1).alias("sub"), F.concat(F.format_string(
        "SPEAKER %s %d %.3f %.3f <NA> <NA> %s <NA>", "stream_id", "warp", F.col("first") / 100.0, (F.col("last") - F.col("first") + 1) / 100.0, "name"), "info").alias("value"))
    return intro.unionByName(main)


def write_segments(segs: DataFrame, path: str, prefix: str = "SPK", **options) -> None:
    """The lines as text files, each stream in order and whole in one file."""
    lines = segment_lines(segs, prefix, **options)
    in_order(lines, "stream_id", "ord", "sub").write.mode("overwrite").text(path)


def read_regions(spark: SparkSession, path: str, label: str | None = None, channel: int | None = None, compat: bool = False, check: bool = True) -> DataFrame:
    """SRC-5: lines ``label channel begin end`` as ``stream_id, channel, first, last``; times are truncated and the end frame is left out.

    Frames are cut from decimal times; ``compat`` cuts the binary product, in which 0.29 s is frame 28. The regions of a label and
    channel must be sorted and disjoint in their file when ``check`` is on. Files are read whole, as they name few regions.
    """
    cut = (lambda c: F.floor(c * 100)) if compat else (lambda c: F.floor(F.round(c * 100, 6)))
    p = F.split(F.trim("line"), "\\s+")
    rows = file_lines(spark, path).where(F.size(p) >= 4).select("file", "pos", p[0].alias("stream_id"), p[1].cast("int").alias("channel"),
                                                               cut(p[2].cast("double")).alias("first"), (cut(p[3].cast("double")) - 1).alias("last"))
    if label is not None:
        rows = rows.where(F.col("stream_id") == label)
    if channel is not None:
        rows = rows.where(F.col("channel") == channel)
    if check:
        bad = F.col("first") <= F.lag("last").over(Window.partitionBy("file", "stream_id", "channel").orderBy("pos"))
        rows = rows.withColumn("first", F.when(bad, F.raise_error(F.lit("regions are not sorted")).cast("long")).otherwise(F.col("first")))
    return rows.select("stream_id", "channel", "first", "last")


def write_frame_labels(frames: DataFrame, path: str) -> None:
    """SNK-12: ``t <tab> label`` lines."""
    frames.select("t", "label").write.mode("overwrite").option("sep", "\t").csv(path)


def read_frame_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("t long, label long").csv(path)
