"""Interval algebra over labelled timelines.

A segment table has ``stream_id, first, last, label``: closed frame intervals, in no stored order. Operators that
depend on order sort by ``first, last`` inside a stream. Interval joins never compare by inequality alone:
both sides are cut into buckets of ``bucket`` frames and meet on (stream, bucket), and a pair counts in the one
bucket where its overlap begins. With ``compat=True`` some operators reproduce known defects of the
classic tool; the default is the documented intent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["stream_id", "first", "last", "label"]
BUCKET = 512


def _by_time() -> Window:
    return Window.partitionBy("stream_id").orderBy("first", "last")


def length() -> Column:
    """Number of frames of a segment."""
    return F.col("last") - F.col("first") + 1


# -- scans and predicates ------------------------------------------------------------------------------


def with_label(segs: DataFrame, label: int) -> DataFrame:
    """FLT-1: segments of one label; a negative label stands for any."""
    return segs if label < 0 else segs.where(F.col("label") == label)


def has_label(segs: DataFrame, label: int) -> bool:
    """FLT-2: whether a label occurs."""
    return not with_label(segs, label).limit(1).isEmpty()


def restrict(frames: DataFrame, begin: int | None = None, end: int | None = None) -> DataFrame:
    """FLT-4: frames between two positions; negative or missing bounds are open."""
    if begin is not None and begin >= 0:
        frames = frames.where(F.col("t") >= begin)
    if end is not None and end >= 0:
        frames = frames.where(F.col("t") <= end)
    return frames


def trim_start(segs: DataFrame, skip: int, use: int = 0) -> DataFrame:
    """FLT-5: leaves out each segment's first ``skip`` frames and keeps at most ``use`` (0: all) of the rest.

    A segment too short to skip stays whole.
    """
    begin = F.when(length() > skip, F.col("first") + skip).otherwise(F.col("first"))
    out = segs.withColumn("first", begin)
    return out.withColumn("last", F.least("last", F.col("first") + use - 1)) if use else out


def relabel_long(segs: DataFrame, label: int, new: int, most: int) -> DataFrame:
    """FLT-6: gives segments of a label that are longer than ``most`` another label; adds ``changed`` frames."""
    long = (F.col("label") == label) & (length() > most)
    return segs.withColumn("changed", F.when(long, length()).otherwise(F.lit(0).cast("long"))).withColumn("label", F.when(long, new).otherwise(F.col("label")))


def training_lengths(obs: DataFrame, most_per_state: int = 100, least_total: int = 3) -> DataFrame:
    """FLT-7: observations neither too long for one state nor too short in all; ``s1, s2, s3`` are state lengths."""
    return obs.where((F.greatest("s1", "s2", "s3") <= most_per_state) & (F.col("s1") + F.col("s2") + F.col("s3") >= least_total))


def label_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """FLT-8: rows whose label starts with a prefix."""
    return rows.where(F.col(column).startswith(prefix))


def thin(rows: DataFrame, key: str, share: float) -> DataFrame:
    """FLT-9: a fixed share of rows by the MD5 of a key: the same rows each time."""
    draw = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return rows.where(draw % 1000 < int(share * 1000))


def frames_at(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """FLT-10: random access by (stream, frame)."""
    return frames.join(wanted, ["stream_id", "t"])


# -- joins ---------------------------------------------------------------------------------------------


def expand(segs: DataFrame, label: int = -1) -> DataFrame:
    """JOIN-1: one row for each frame of each segment: ``stream_id, t, label``."""
    return with_label(segs, label).select("stream_id", F.explode(F.sequence("first", "last")).alias("t"), "label")


def collapse(frames: DataFrame) -> DataFrame:
    """Runs of consecutive frames with one label become segments."""
    run = F.col("t") - F.row_number().over(Window.partitionBy("stream_id", "label").orderBy("t"))
    return frames.select("stream_id", "t", "label", run.alias("run")).groupBy("stream_id", "label", "run").agg(
        F.min("t").alias("first"), F.max("t").alias("last")).select(*KEYS)


def _bucketed(segs: DataFrame, bucket: int) -> DataFrame:
    return segs.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first") / bucket), F.floor(F.col("last") / bucket))))


def overlaps(a: DataFrame, b: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs of overlapping segments of a stream: a's columns, and b's as ``b_first, b_last, b_label``."""
    left = _bucketed(a, bucket)
    right = _bucketed(b.select("stream_id", "first", "last", "label"), bucket).toDF("stream_id", "b_first", "b_last", "b_label", "bucket")
    begin = F.greatest("first", "b_first")
    # What explode makes of a side is unknown when the join is planned, so neither side is sent to all tasks.
    return (left.hint("merge").join(right, ["stream_id", "bucket"]).where((F.col("first") <= F.col("b_last")) & (F.col("b_first") <= F.col("last")))
            .where(F.col("bucket") == F.floor(begin / bucket)).drop("bucket"))


def intersect(src: DataFrame, flt: DataFrame, label: int = -1, compat: bool = False, bucket: int = BUCKET) -> DataFrame:
    """JOIN-2: the parts of ``src`` inside ``flt``, with the source's labels. ``compat`` drops parts of one frame."""
    both = overlaps(src.select(*KEYS), with_label(flt, label), bucket)
    cut = both.select("stream_id", F.greatest("first", "b_first").alias("first"), F.least("last", "b_last").alias("last"), "label")
    return cut.where("first < last") if compat else cut


def merged(segs: DataFrame) -> DataFrame:
    """The union of all segments of a stream as disjoint segments with label 0; neighbours that touch are one."""
    before = F.max("last").over(_by_time().rowsBetween(Window.unboundedPreceding, -1))
    rows = segs.select("stream_id", "first", "last", before.alias("reach"))
    rows = rows.withColumn("island", F.sum(F.when(F.col("reach").isNull() | (F.col("first") > F.col("reach") + 1), 1).otherwise(0)).over(_by_time()))
    return rows.groupBy("stream_id", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("stream_id", "first", "last", F.lit(0).alias("label"))


def complement(segs: DataFrame, low: int = -(1 << 40), high: int = 1 << 40) -> DataFrame:
    """What a stream's segments leave free between two bounds."""
    m = merged(segs)
    gaps = m.select("stream_id", (F.lag("last", 1, low - 1).over(_by_time()) + 1).alias("first"), (F.col("first") - 1).alias("last"))
    tail = m.groupBy("stream_id").agg((F.max("last") + 1).alias("first")).select("stream_id", "first", F.lit(high).alias("last"))
    return gaps.unionByName(tail).where("first <= last").withColumn("label", F.lit(0))


def subtract(src: DataFrame, flt: DataFrame, label: int = -1, compat: bool = False, pool: int | None = None) -> DataFrame:
    """JOIN-3: the parts of ``src`` outside ``flt``.

    ``compat`` joins neighbouring parts whatever their labels, names them after their last source, ends each one
    frame too late and leaves out what is still open at the last frame of a pool of ``pool`` frames.
    """
    flt = with_label(flt, label)
    if compat:
        # Parts that touch are one, so frames need not be made.
        reach = F.max("last").over(_by_time().rowsBetween(Window.unboundedPreceding, -1))
        parts = subtract(src, flt).withColumn("new", F.when(F.col("first") <= reach + 1, 0).otherwise(1))
        runs = parts.withColumn("run", F.sum("new").over(_by_time())).groupBy("stream_id", "run").agg(
            F.min("first").alias("first"), F.max("last").alias("end"), F.max_by("label", "last").alias("label"))
        runs = runs.where(F.col("end") < pool - 1) if pool is not None else runs
        return runs.select("stream_id", "first", (F.col("end") + 1).alias("last"), "label")
    # Segments without a filter in their stream, and the parts inside the free ranges of the others. A free
    # range is unbounded, so sources are joined to it by the filter segments that they meet.
    met = overlaps(src.select(*KEYS), merged(flt)).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("b_first", "b_last"))).alias("cuts"))
    starts = F.concat(F.array("first"), F.transform("cuts", lambda c: c["b_last"] + 1))
    ends = F.concat(F.transform("cuts", lambda c: c["b_first"] - 1), F.array("last"))
    parts = met.select("stream_id", "label", F.explode(F.arrays_zip(starts.alias("first"), ends.alias("last"))).alias("p"))
    parts = parts.select("stream_id", F.col("p.first").alias("first"), F.col("p.last").alias("last"), "label").where("first <= last")
    rest = src.select(*KEYS).join(met.select(*KEYS), KEYS, "left_anti")
    return rest.unionByName(parts)


def insert(source: DataFrame, into: DataFrame, label: int) -> DataFrame:
    """JOIN-4: adds the source's segments of a label, but only to streams that have segments already."""
    there = into.select("stream_id").distinct()
    return into.select(*KEYS).unionByName(with_label(source, label).select(*KEYS).join(there, "stream_id", "left_semi"))


# -- windows and sequences -----------------------------------------------------------------------------


def fill_gaps(segs: DataFrame, label: int) -> DataFrame:
    """WIN-1: adds a segment for each gap between two segments."""
    gaps = segs.select("stream_id", (F.col("last") + 1).alias("first"), (F.lead("first").over(_by_time()) - 1).alias("last"), F.lit(label).alias("label"))
    return segs.select(*KEYS).unionByName(gaps.where("first <= last"))


def widen(segs: DataFrame, sound: int, most: int, only: int = -1) -> DataFrame:
    """WIN-2: widens segments into the gaps beside them.

    Each takes half a gap, or all of it if the other side is ``sound`` (or not of label ``only``), and at most
    ``most`` frames. The first segment also grows to the left; the last does not grow to the right.
    """
    gap = lambda a, b, x, y: _share(b - a - 1, x, y, sound, only, most)
    w = _by_time()
    rows = segs.select(*KEYS, F.lag("last").over(w).alias("p_last"), F.lag("label").over(w).alias("p_label"),
                       F.lead("first").over(w).alias("n_first"), F.lead("label").over(w).alias("n_label"))
    own = F.col("label") != sound
    if only >= 0:
        own &= F.col("label") == only
    left = F.when(F.col("p_last").isNull(), F.greatest(F.lit(0), F.col("first") - most)).when(
        own, F.col("first") - gap(F.col("p_last"), F.col("first"), F.col("p_label"), F.col("label"))).otherwise(F.col("first"))
    right = F.when(F.col("n_first").isNotNull() & own, F.col("last") + gap(F.col("last"), F.col("n_first"), F.col("label"), F.col("n_label"))).otherwise(F.col("last"))
    return rows.select("stream_id", left.cast("long").alias("first"), right.cast("long").alias("last"), "label")


def _share(gap: Column, here: Column, there: Column, sound: int, only: int, most: int) -> Column:
    """Frames of a gap that each side may take."""
    half = F.floor(gap / 2)
    if only < 0:
        add = F.when((here == sound) & (there == sound), 0).when((here == sound) | (there == sound), gap).otherwise(half)
    else:
        add = F.when(here != only, 0).when(there != only, gap).otherwise(half)
    return F.least(add, F.lit(most))


def halve(segs: DataFrame) -> DataFrame:
    """WIN-5: ``part`` A and B of each segment; of an odd number of frames B has one more; one frame is A alone."""
    half = F.floor(length() / 2)
    a = segs.select("stream_id", "first", F.when(length() > 1, F.col("first") + half - 1).otherwise(F.col("last")).alias("last"), "label", F.lit("A").alias("part"))
    b = segs.where(length() > 1).select("stream_id", (F.col("first") + half).alias("first"), "last", "label", F.lit("B").alias("part"))
    return a.unionByName(b)


def max_length(segs: DataFrame, label: int, size: int, rest: int) -> DataFrame:
    """WIN-4: cuts ``size`` frames off a segment of the label while it is longer than ``size + rest``."""
    cut = (F.col("label") == label) if label >= 0 else F.lit(True)
    n = F.when(cut & (length() > size + rest), F.ceil((length() - size - rest) / size)).otherwise(0)
    rows = segs.select(*KEYS, F.posexplode(F.sequence(F.lit(0).cast("long"), n.cast("long"))).alias("k", "x"), n.alias("n"))
    first = F.col("first") + F.col("k") * size
    return rows.select("stream_id", first.alias("first"), F.when(F.col("k") < F.col("n"), first + size - 1).otherwise(F.col("last")).alias("last"), "label")


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """WIN-13: b after a; segments of one label that touch the seam are one. Fails if b ends before a does."""
    rows = a.select(*KEYS, F.lit(0).alias("side")).unionByName(b.select(*KEYS, F.lit(1).alias("side")))
    w = Window.partitionBy("stream_id").orderBy("side", "first", "last")
    p_side, p_label, p_last = (F.lag(c).over(w) for c in ("side", "label", "last"))
    rows = rows.select("*", ((F.col("side") == 1) & (p_side == 0)).alias("seam"), p_label.alias("p_label"), p_last.alias("p_last"))
    bad = F.col("seam") & (F.col("last") < F.col("p_last"))
    rows = rows.withColumn("joined", F.when(bad, F.raise_error(F.lit("the second segmentation ends before the first")).cast("boolean")).otherwise(
        F.coalesce(F.col("seam") & (F.col("label") == F.col("p_label")), F.lit(False))))
    rows = rows.withColumn("part", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(w))
    return rows.groupBy("stream_id", "part").agg(F.min_by("first", "side").alias("first"), F.max("last").alias("last"), F.first("label").alias("label")).select(*KEYS)


def chunks(segs: DataFrame, size: int) -> DataFrame:
    """WIN-12: numbers equal chunks of a stream's frames, about ``size`` each, cutting segments at their borders.

    The number of chunks is the rounded quotient (halves down), at least 1; segments need not touch.
    """
    before = F.coalesce(F.sum(length()).over(_by_time().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(length()).over(Window.partitionBy("stream_id"))
    rows = segs.select(*KEYS, before.alias("before"), total.alias("total"))
    count = F.greatest(F.lit(1), F.ceil(F.col("total") / size - 0.5))
    rows = rows.withColumn("chunk_len", F.floor(F.col("total") / count) + 1)
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("before") / F.col("chunk_len")), F.floor((F.col("before") + length() - 1) / F.col("chunk_len")))))
    first = F.col("first") + F.greatest(F.lit(0), F.col("chunk") * F.col("chunk_len") - F.col("before"))
    last = F.least(F.col("last"), F.col("first") + (F.col("chunk") + 1) * F.col("chunk_len") - 1 - F.col("before"))
    return rows.select("stream_id", first.alias("first"), last.alias("last"), F.col("chunk").alias("label"))


def round_robin(segs: DataFrame, size: int, clusters: int) -> DataFrame:
    """WIN-11: deals pieces of ``size`` frames of a stream to labels 1..clusters in turn."""
    before = F.coalesce(F.sum(length()).over(_by_time().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = segs.select(*KEYS, before.alias("before"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.floor(F.col("before") / size), F.floor((F.col("before") + length() - 1) / size))))
    first = F.col("first") + F.greatest(F.lit(0), F.col("piece") * size - F.col("before"))
    last = F.least(F.col("last"), F.col("first") + (F.col("piece") + 1) * size - 1 - F.col("before"))
    return rows.select("stream_id", first.alias("first"), last.alias("last"), (F.pmod("piece", F.lit(clusters)) + 1).alias("label"))


def consensus(sets: list[DataFrame], keep: int = 1000, drop: int = 100) -> DataFrame:
    """WIN-14: one label for each combination of labels, in order of first appearance, over a stream's frames.

    Combinations on more than ``keep`` frames are numbered from 1, those on fewer than ``drop`` become 0 and the
    others are left out, as are frames without any label.
    """
    # Segments are cut where any segment of the stream begins or has ended, so the pieces of all sets are the same or disjoint.
    own = [s.select("stream_id", "first", "last", "label", F.lit(i).alias("part")) for i, s in enumerate(sets)]
    rows = own[0]
    for s in own[1:]:
        rows = rows.unionByName(s)
    at = rows.select("stream_id", F.explode(F.array(F.col("first"), F.col("last") + 1)).alias("at")).distinct().withColumn("bucket", F.floor(F.col("at") / BUCKET))
    held = _bucketed(rows, BUCKET)
    cuts = held.hint("merge").join(at, ["stream_id", "bucket"]).where((F.col("first") <= F.col("at")) & (F.col("at") <= F.col("last")))
    starts = F.array_sort(F.collect_list("at"))
    whole = cuts.groupBy(*KEYS, "part").agg(starts.alias("starts"))
    ends = F.concat(F.transform(F.slice("starts", F.lit(2), F.greatest(F.size("starts") - 1, F.lit(0))), lambda x: x - 1), F.array("last"))
    pieces = whole.select("stream_id", "part", "label", F.explode(F.arrays_zip(F.col("starts").alias("first"), ends.alias("last"))).alias("p")).select("stream_id", "part", "label", "p.first", "p.last")
    pieces = pieces.groupBy("stream_id", "first", "last", "part").agg(F.min("label").alias("label"))
    keys = pieces.groupBy("stream_id", "first", "last").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "part", "label"))), "|").alias("combo"))
    # A run is of one combination, though several have label 0.
    w = Window.partitionBy("stream_id", "combo").orderBy("first")
    new = F.when(F.col("first") == F.lag("last").over(w) + 1, 0).otherwise(1)
    runs = keys.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy("stream_id", "combo", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    totals = runs.groupBy("stream_id", "combo").agg(F.sum(length()).alias("n"), F.min("first").alias("seen"))
    big = totals.where(F.col("n") > keep).withColumn("label", F.row_number().over(Window.partitionBy("stream_id").orderBy("seen")))
    label = big.select("stream_id", "combo", "label").unionByName(totals.where(F.col("n") < drop).select("stream_id", "combo", F.lit(0).alias("label")))
    return runs.join(label, ["stream_id", "combo"]).select(*KEYS)


# -- order-dependent machines: one pandas group for each stream ----------------------------------------

SEGMENT_DDL = "stream_id string, first long, last long, label long"


def _per_stream(segs: DataFrame, fn) -> DataFrame:
    rows = segs.select(F.col("stream_id").cast("string"), F.col("first").cast("long"), F.col("last").cast("long"), F.col("label").cast("long"))
    return rows.groupBy("stream_id").applyInPandas(fn, SEGMENT_DDL)


def absorb_short(segs: DataFrame, label: int, own: int, least: int) -> DataFrame:
    """WIN-3: a segment of label ``own`` between two of ``label``, both longer than ``least``, joins them into one.

    Merges cascade. As in the classic tool the running length leaves out the absorbed right neighbour.
    """

    def run(pdf):
        import pandas as pd

        rows = pdf.sort_values(["first", "last"])[["first", "last", "label"]].to_numpy().tolist()
        out, left, i = [], least + 1, 0
        while i < len(rows):
            a, b, x = rows[i]
            n = b - a + 1
            if x == own and out and i + 1 < len(rows) and out[-1][2] == label == rows[i + 1][2] and left > least and rows[i + 1][1] - rows[i + 1][0] + 1 > least:
                out[-1][1] = rows[i + 1][1]
                left += n
                i += 2
                continue
            out.append([a, b, x])
            left, i = n, i + 1
        return pd.DataFrame([(pdf["stream_id"].iloc[0], *r) for r in out], columns=["stream_id", "first", "last", "label"])

    return _per_stream(segs, run)


def resolve_overlap(segs: DataFrame, label: int) -> DataFrame:
    """WIN-6: replaces an overlap label by its neighbours': the one before, and a copy with the one after if that differs."""

    def run(pdf):
        import pandas as pd

        rows = pdf.sort_values(["first", "last"])[["first", "last", "label"]].to_numpy().tolist()
        out, before = [], -1
        for i, (a, b, x) in enumerate(rows):
            after = rows[i + 1][2] if i + 1 < len(rows) else None
            last = x
            if x == label:
                if before >= 0 and before != label:
                    x = last = before
                if before < 0 and after is not None:
                    x = last = after
                elif after is not None and after not in (before, label):
                    out.append((a, b, x))
                    x = last = after
            out.append((a, b, x))
            before = last
        return pd.DataFrame([(pdf["stream_id"].iloc[0], *r) for r in out], columns=["stream_id", "first", "last", "label"])

    return _per_stream(segs, run)


def mask_to_segments(mask: DataFrame, hold: int = 10) -> DataFrame:
    """WIN-7: runs of a boolean ``on`` by frame: label 2 where on, 1 where off; off runs under ``hold`` frames after an on run don't count."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("t")
        t, on = pdf["t"].tolist(), pdf["on"].tolist()
        out, state, since, i = [], on[0], 0, 0
        while i < len(on):
            if on[i] != state:
                stop = i
                while stop < len(on) and stop - i < hold and on[stop] != state:
                    stop += 1
                if state and stop - i < hold and stop < len(on):
                    i = stop
                else:
                    out.append((t[since], t[i - 1], 2 if state else 1))
                    state, since = on[i], i
            i += 1
        out.append((t[since], t[-1], 2 if state else 1))
        return pd.DataFrame([(pdf["stream_id"].iloc[0], *r) for r in out], columns=["stream_id", "first", "last", "label"])

    rows = mask.select(F.col("stream_id").cast("string"), F.col("t").cast("long"), F.col("on").cast("boolean"))
    return rows.groupBy("stream_id").applyInPandas(run, SEGMENT_DDL)


def drop_low_energy(segs: DataFrame, energy: DataFrame, threshold: float, min_silence: int = 30, min_speech: int = 30, pad: int = 5) -> DataFrame:
    """WIN-8: cuts runs of more than ``min_silence`` frames at or below a threshold out of each segment.

    ``energy`` has ``stream_id, t, energy``. ``pad`` frames stay on either side; parts of up to ``min_speech`` frames are dropped.
    """
    # Loud runs, cut at the borders of buckets, meet the segments that hold them; frames are never joined.
    loud = energy.where((F.col("energy") > threshold) & ~F.isnan("energy")).select("stream_id", "t", F.floor(F.col("t") / BUCKET).alias("bucket"))
    at = Window.partitionBy("stream_id", "bucket").orderBy("t")
    loud = loud.withColumn("run", F.col("t") - F.dense_rank().over(at)).groupBy("stream_id", "bucket", "run").agg(F.min("t").alias("a"), F.max("t").alias("b")).drop("run")
    met = _bucketed(segs.select(*KEYS).withColumn("id", F.monotonically_increasing_id()), BUCKET).hint("merge").join(loud, ["stream_id", "bucket"], "left")
    inside = (F.col("a") <= F.col("last")) & (F.col("b") >= F.col("first"))
    run = F.when(inside, F.struct(F.greatest("a", "first").alias("a"), F.least("b", "last").alias("b")))
    whole = met.groupBy(*KEYS, "id").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    # A part ends before each gap that is too long and the next begins after it; the gaps before the first and after the last run count too.
    f, z, runs, n = F.col("first"), F.col("last"), F.col("runs"), F.size("runs")
    here = lambda i: F.get(runs, i)
    gap = lambda i: F.when(i == n, z - here(i - 1)["b"]).when(i == 0, here(i)["a"] - f).otherwise(here(i)["a"] - here(i - 1)["b"] - 1)
    holes = F.when(n == 0, F.when(length() > min_silence, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))).otherwise(F.filter(F.sequence(F.lit(0), n), lambda i: gap(i) > min_silence))
    ends = F.transform(holes, lambda i: F.when(n == 0, f - 1).when(i == 0, f).when(i == n, here(i - 1)["b"]).otherwise(here(i - 1)["b"] + 1) + pad)
    starts = F.transform(F.filter(holes, lambda i: i < n), lambda i: here(i)["a"] - pad)
    open_ = F.size(holes) == F.size(F.filter(holes, lambda i: i < n))
    parts = F.arrays_zip(F.concat(F.array(f), starts).alias("first"), F.when(open_, F.concat(ends, F.array(z))).otherwise(ends).alias("last"))
    rows = whole.select("stream_id", "label", length().alias("frames"), F.posexplode(parts).alias("i", "p"), F.size(parts).alias("n"))
    rows = rows.select(F.col("stream_id").cast("string"), F.col("p.first").cast("long").alias("first"), F.col("p.last").cast("long").alias("last"), F.col("label").cast("long"), ((F.col("frames") > 1) | (F.col("i") + 1 < F.col("n"))).alias("long"))
    return rows.where(F.col("long") & (F.col("last") - F.col("first") > min_speech)).select(*KEYS)


# -- counts and set operations -------------------------------------------------------------------------


def merge_labels(segs: DataFrame, keep: int, away: int) -> DataFrame:
    """SET-3: label ``away`` becomes ``keep``."""
    return segs.withColumn("label", F.when(F.col("label") == away, keep).otherwise(F.col("label")))


def append(segs: DataFrame, rows: DataFrame) -> DataFrame:
    """SET-2: more segments."""
    return segs.select(*KEYS).unionByName(rows.select(*KEYS))


def frames_per_label(segs: DataFrame) -> DataFrame:
    """AGG-7: frames and segments of each label."""
    return segs.groupBy("label").agg(F.sum(length()).alias("frames"), F.count(F.lit(1)).alias("segments"))


def labels_in_order(segs: DataFrame) -> DataFrame:
    """AGG-8: a stream's labels by first appearance, with their number of segments."""
    seen = segs.groupBy("stream_id", "label").agg(F.min(F.struct("first", "last")).alias("at"), F.count(F.lit(1)).alias("segments"))
    return seen.select("stream_id", "label", "segments", F.row_number().over(Window.partitionBy("stream_id").orderBy("at", "label")).alias("position"))
