"""Queries of the interval algebra over users' event segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from . import views as v
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query
ALL = "stream_id, first, last, label"
NEXT = "lead({}) OVER (PARTITION BY stream_id ORDER BY first)"
#: The expanded segments of users.
EXPANDED = {"x": "SELECT stream_id, unnest(range(first, last + 1)) AS t, label FROM segments_user"}


def _pairs(op: str) -> str:
    return f"SELECT s.stream_id, greatest(s.first, r.first) AS first, least(s.last, r.last) AS last, s.label FROM segments_user s JOIN regions r ON s.stream_id = r.stream_id AND s.first <= r.last AND r.first <= s.last WHERE greatest(s.first, r.first) {op} least(s.last, r.last)"


@query("join1_expand_frames", v.with_views("SELECT label, count(*) AS frames, sum(t)::BIGINT AS frame_sum FROM x GROUP BY label", "segments_user", **EXPANDED))
def _(spark, d):
    return iv.expand(v.segments_user(spark, d)).groupBy("label").agg(F.count(F.lit(1)).alias("frames"), F.sum("t").alias("frame_sum"))


@query("join2_interval_intersect", v.with_views(_pairs("<="), "segments_user", "regions"))
def _(spark, d):
    return iv.intersect(v.segments_user(spark, d), v.regions(spark, d))


@query("join2_interval_intersect_compat", v.with_views(_pairs("<"), "segments_user", "regions"))
def _(spark, d):
    return iv.intersect(v.segments_user(spark, d), v.regions(spark, d), compat=True)


@query("join2_frames_in_regions", v.with_views(f"SELECT label, sum(last - first + 1)::BIGINT AS frames, count(*) AS segments FROM ({_pairs('<=')}) GROUP BY label", "segments_user", "regions"))
def _(spark, d):
    return iv.frames_per_label(iv.intersect(v.segments_user(spark, d), v.regions(spark, d)))


OUTSIDE = {"o": "SELECT stream_id, t, label FROM x ANTI JOIN (SELECT stream_id, unnest(range(first, last + 1)) AS t FROM regions) USING (stream_id, t)"}


@query("join3_interval_subtract", v.with_views(
    "SELECT stream_id, min(t) AS first, max(t) AS last, label FROM (SELECT o.*, s.first AS f, t - row_number() OVER (PARTITION BY o.stream_id, s.first ORDER BY t) AS g FROM o JOIN segments_user s ON o.stream_id = s.stream_id AND t BETWEEN s.first AND s.last) GROUP BY stream_id, f, label, g",
    "segments_user", "regions", **EXPANDED, **OUTSIDE))
def _(spark, d):
    return iv.subtract(v.segments_user(spark, d), v.regions(spark, d))


@query("join3_interval_subtract_compat", v.with_views(
    "SELECT stream_id, min(t) AS first, max(t) + 1 AS last, max_by(label, t) AS label FROM (SELECT *, t - row_number() OVER (PARTITION BY stream_id ORDER BY t) AS g FROM o) GROUP BY stream_id, g HAVING max(t) < 43200 - 1",
    "segments_user", "regions", **EXPANDED, **OUTSIDE))
def _(spark, d):
    return iv.subtract(v.segments_user(spark, d), v.regions(spark, d), compat=True, pool=43200)


@query("join4_insert_label", v.with_views(f"SELECT {ALL} FROM segments_user WHERE label <> 2 UNION ALL SELECT {ALL} FROM segments_user WHERE label = 2 AND stream_id IN (SELECT stream_id FROM segments_user WHERE label <> 2)", "segments_user"))
def _(spark, d):
    s = v.segments_user(spark, d)
    return iv.insert(s, s.where("label <> 2"), 2)


@query("win1_fill_gaps", v.with_views(f"SELECT {ALL} FROM segments_user UNION ALL SELECT stream_id, last + 1, n - 1, 99 FROM (SELECT *, {NEXT.format('first')} AS n FROM segments_user) WHERE n > last + 1", "segments_user"))
def _(spark, d):
    return iv.fill_gaps(v.segments_user(spark, d), 99)


def _widen_sql(only: int) -> str:
    share = ("CASE WHEN {a} = 1 AND {b} = 1 THEN 0 WHEN {a} = 1 OR {b} = 1 THEN {g} ELSE {g} // 2 END" if only < 0 else
             f"CASE WHEN {{a}} <> {only} THEN 0 WHEN {{b}} <> {only} THEN {{g}} ELSE {{g}} // 2 END")
    own = "label <> 1" if only < 0 else f"label <> 1 AND label = {only}"
    left, right = share.format(a="pl", b="label", g="(first - pe - 1)"), share.format(a="label", b="nl", g="(nf - last - 1)")
    return v.with_views(f"""SELECT stream_id, (CASE WHEN pe IS NULL THEN greatest(0, first - 12) WHEN {own} THEN first - least(12, {left}) ELSE first END)::BIGINT AS first,
(CASE WHEN nf IS NOT NULL AND {own} THEN last + least(12, {right}) ELSE last END)::BIGINT AS last, label
FROM (SELECT *, lag(last) OVER w AS pe, lag(label) OVER w AS pl, lead(first) OVER w AS nf, lead(label) OVER w AS nl FROM segments_user WINDOW w AS (PARTITION BY stream_id ORDER BY first))""", "segments_user")


@query("win2_widen", _widen_sql(-1))
def _(spark, d):
    return iv.widen(v.segments_user(spark, d), 1, 12)


@query("win2_widen_one_label", _widen_sql(3))
def _(spark, d):
    return iv.widen(v.segments_user(spark, d), 1, 12, only=3)


FILLED = {"two": "SELECT stream_id, first, last, CASE WHEN label = 3 THEN 2 ELSE label END AS label FROM segments_user",
          "filled": "SELECT * FROM two UNION ALL SELECT stream_id, last + 1, n - 1, 9 FROM (SELECT *, lead(first) OVER (PARTITION BY stream_id ORDER BY first) AS n FROM two) WHERE n > last + 1",
          "seam": "SELECT *, label = 9 AND lag(label) OVER w = 2 AND lag(last - first + 1) OVER w > 4 AND lead(label) OVER w = 2 AND lead(last - first + 1) OVER w > 4 AS gone FROM filled WINDOW w AS (PARTITION BY stream_id ORDER BY first, last)"}


@query("win3_absorb_short", v.with_views("SELECT stream_id::VARCHAR AS stream_id, min(first) AS first, max(last) AS last, arg_min(label, first) AS label FROM (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT *, CASE WHEN coalesce(gone, false) OR coalesce(lag(gone) OVER (PARTITION BY stream_id ORDER BY first, last), false) THEN 0 ELSE 1 END AS new FROM seam)) GROUP BY stream_id, part", "segments_user", **FILLED))
def _(spark, d):
    return iv.absorb_short(iv.fill_gaps(iv.merge_labels(v.segments_user(spark, d), 2, 3), 9), 2, 9, 4)


@query("win4_max_length", v.with_views(
    "SELECT stream_id, first + k * 7 AS first, CASE WHEN k < n THEN first + k * 7 + 6 ELSE last END AS last, label FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM (SELECT *, (CASE WHEN last - first + 1 > 10 THEN ceil((last - first + 1 - 10) / 7.0) ELSE 0 END)::BIGINT AS n FROM segments_user))",
    "segments_user"))
def _(spark, d):
    return iv.max_length(v.segments_user(spark, d), -1, 7, 3)


@query("win5_halve", v.with_views(
    "SELECT stream_id, first, CASE WHEN last > first THEN first + (last - first + 1) // 2 - 1 ELSE last END AS last, label, 'A' AS part FROM segments_user UNION ALL SELECT stream_id, first + (last - first + 1) // 2, last, label, 'B' FROM segments_user WHERE last > first", "segments_user"))
def _(spark, d):
    return iv.halve(v.segments_user(spark, d))


@query("win6_resolve_overlap", v.with_views("""SELECT stream_id, first, last, unnest(CASE WHEN label <> 4 THEN [label] WHEN p IS NOT NULL THEN CASE WHEN q IS NOT NULL AND q <> 4 AND q <> p THEN [p, q] ELSE [p] END
WHEN k = 1 THEN [coalesce(q, 4)] WHEN q IS NOT NULL AND q <> 4 THEN [4, q] ELSE [4] END) AS label FROM (SELECT *, last_value(CASE WHEN label <> 4 THEN label END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, lead(label) OVER w AS q, row_number() OVER w AS k FROM segments_user WINDOW w AS (PARTITION BY stream_id ORDER BY first, last))""", "segments_user").replace("SELECT stream_id, first, last, unnest", "SELECT stream_id::VARCHAR AS stream_id, first, last, unnest"))
def _(spark, d):
    return iv.resolve_overlap(v.segments_user(spark, d), 4)


MASK = {"mask": "SELECT t, x > 0 AS on_ FROM dims WHERE d = 0",
        "island": "SELECT on_, min(t) AS a, max(t) AS b, count(*) AS n FROM (SELECT *, row_number() OVER (ORDER BY t) - row_number() OVER (PARTITION BY on_ ORDER BY t) AS g FROM mask) GROUP BY on_, g",
        "held": "SELECT a, b, on_ OR (n < 3 AND a > (SELECT min(t) FROM mask) AND b < (SELECT max(t) FROM mask)) AS on_ FROM island"}


@query("win7_mask_to_segments", v.with_views("SELECT '0' AS stream_id, min(a) AS first, max(b) AS last, any_value(CASE WHEN on_ THEN 2 ELSE 1 END)::BIGINT AS label FROM (SELECT *, row_number() OVER (ORDER BY a) - row_number() OVER (PARTITION BY on_ ORDER BY a) AS g FROM held) GROUP BY on_, g", "dims", **MASK))
def _(spark, d):
    mask = v.dims(spark, d).where("d = 0").select(F.lit(0).alias("stream_id"), "t", (F.col("x") > 0).alias("on"))
    return iv.mask_to_segments(mask, hold=3)


LOUD = {"fr": "SELECT stream_id, first, last, label, unnest(range(first, last + 1)) AS t FROM segments_user",
        "loud": "SELECT stream_id, first, last, label, min(t) AS a, max(t) AS b FROM (SELECT *, t - row_number() OVER (PARTITION BY stream_id, first ORDER BY t) AS g FROM fr WHERE (t * 37 + stream_id * 11) % 101 > 30) GROUP BY stream_id, first, last, label, g",
        "part": "SELECT stream_id, label, last > first AS long_, CASE WHEN a = first THEN a ELSE a - 1 END AS s, CASE WHEN lead(a) OVER (PARTITION BY stream_id, first ORDER BY a) IS NOT NULL THEN b + 2 WHEN b < last THEN b + 1 ELSE b END AS e FROM loud"}


@query("win8_drop_low_energy", v.with_views("SELECT stream_id::VARCHAR AS stream_id, s AS first, e AS last, label FROM part WHERE e - s > 3 AND long_", "segments_user", **LOUD))
def _(spark, d):
    e = iv.expand(v.segments_user(spark, d)).select("stream_id", "t", F.pmod(F.col("t") * 37 + F.col("stream_id") * 11, F.lit(101)).cast("double").alias("energy"))
    return iv.drop_low_energy(v.segments_user(spark, d), e, 30.0, min_silence=0, min_speech=3, pad=1)


def _dealt(size: str, label: str, source: str = "b") -> str:
    return f"SELECT stream_id, first + greatest(0, k * {size} - before) AS first, least(last, first + (k + 1) * {size} - 1 - before) AS last, {label} AS label FROM (SELECT *, unnest(range(before // {size}, (before + last - first) // {size} + 1)) AS k FROM {source})"


BEFORE = {"b": "SELECT *, coalesce(sum(last - first + 1) OVER (PARTITION BY stream_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, (sum(last - first + 1) OVER (PARTITION BY stream_id))::BIGINT AS total FROM segments_user"}


@query("win11_round_robin", v.with_views(_dealt("20", "k % 4 + 1"), "segments_user", **BEFORE))
def _(spark, d):
    return iv.round_robin(v.segments_user(spark, d), 20, 4)


@query("win12_chunks", v.with_views(_dealt("size", "k", "c"), "segments_user", **BEFORE, c="SELECT *, total // greatest(1, ceil(total / 200.0 - 0.5))::BIGINT + 1 AS size FROM b"))
def _(spark, d):
    return iv.chunks(v.segments_user(spark, d), 200)


@query("win13_concat", v.with_views(
    "SELECT stream_id, first(first ORDER BY side, first) AS first, max(last) AS last, label FROM (SELECT *, sum(CASE WHEN side = 1 AND ps = 0 AND pl = label THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY side, first ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT *, lag(side) OVER w AS ps, lag(label) OVER w AS pl FROM h WINDOW w AS (PARTITION BY stream_id ORDER BY side, first))) GROUP BY stream_id, part, label",
    "segments_user", h="SELECT *, CASE WHEN first < 20000 THEN 0 ELSE 1 END AS side FROM segments_user"))
def _(spark, d):
    s = v.segments_user(spark, d)
    return iv.concat(s.where("first < 20000"), s.where("first >= 20000"))


@query("win14_consensus", v.with_views(
    "SELECT stream_id, min(t) AS first, max(t) AS last, label FROM (SELECT k.*, l.label, t - row_number() OVER (PARTITION BY k.stream_id, k.a, k.b ORDER BY t) AS g FROM k JOIN l ON k.stream_id = l.stream_id AND k.a IS NOT DISTINCT FROM l.a AND k.b IS NOT DISTINCT FROM l.b) GROUP BY stream_id, a, b, g, label",
    "segments_user", "regions", **EXPANDED,
    k="SELECT coalesce(x.stream_id, y.stream_id) AS stream_id, coalesce(x.t, y.t) AS t, x.label AS a, y.label AS b FROM x FULL JOIN (SELECT stream_id, unnest(range(first, last + 1)) AS t, label FROM regions) y ON x.stream_id = y.stream_id AND x.t = y.t",
    n="SELECT stream_id, a, b, count(*) AS n, min(t) AS seen FROM k GROUP BY 1, 2, 3",
    l="SELECT stream_id, a, b, row_number() OVER (PARTITION BY stream_id ORDER BY seen) AS label FROM n WHERE n > 60 UNION ALL SELECT stream_id, a, b, 0 FROM n WHERE n < 20"))
def _(spark, d):
    return iv.consensus([v.segments_user(spark, d), v.regions(spark, d)], keep=60, drop=20).withColumn("label", F.col("label").cast("long"))


@query("flt1_label_filter", v.with_views(f"SELECT {ALL} FROM segments_user WHERE label = 2", "segments_user"))
def _(spark, d):
    return iv.with_label(v.segments_user(spark, d), 2)


@query("flt2_label_exists", v.with_views("SELECT label, EXISTS (SELECT 1 FROM segments_user s WHERE s.label = p.label) AS present FROM (SELECT unnest([1, 3, 77])::BIGINT AS label) p", "segments_user"))
def _(spark, d):
    wanted = spark.createDataFrame([(1,), (3,), (77,)], "label long")
    seen = v.segments_user(spark, d).select("label").distinct().withColumn("seen", F.lit(True))
    return wanted.join(seen, "label", "left").select("label", F.coalesce("seen", F.lit(False)).alias("present"))


@query("flt3_frame_mask", v.with_views("SELECT t, x > m AS keep FROM dims, (SELECT avg(x) - var_pop(x) * 0.5 AS m FROM dims WHERE d = 0) WHERE d = 0 AND abs(x - m) > 1e-9", "dims"))
def _(spark, d):
    x = v.dims(spark, d).where("d = 0")
    m = x.agg((F.avg("x") - F.var_pop("x") * 0.5).alias("m"))
    return x.crossJoin(F.broadcast(m)).where("abs(x - m) > 1e-9").select("t", (F.col("x") > F.col("m")).alias("keep"))


@query("flt4_restrict_pool", v.with_views("SELECT t, label FROM frames WHERE t BETWEEN 100 AND 399", "frames"))
def _(spark, d):
    return iv.restrict(v.frames(spark, d), 100, 399).select("t", "label")


@query("flt5_ignore_and_train", v.with_views("SELECT stream_id, f AS first, least(last, f + 9) AS last, label FROM (SELECT *, CASE WHEN last - first + 1 > 5 THEN first + 5 ELSE first END AS f FROM segments_user)", "segments_user"))
def _(spark, d):
    return iv.trim_start(v.segments_user(spark, d), 5, 10)


@query("flt6_relabel_long", v.with_views("SELECT stream_id, first, last, CASE WHEN label = 2 AND last - first + 1 > 20 THEN 7 ELSE label END AS label, CASE WHEN label = 2 AND last - first + 1 > 20 THEN last - first + 1 ELSE 0 END AS changed FROM segments_user", "segments_user"))
def _(spark, d):
    return iv.relabel_long(v.segments_user(spark, d), 2, 7, 20).withColumn("label", F.col("label").cast("long"))


@query("flt7_training_lengths", "SELECT l_orderkey, l_linenumber, s1, s2, s3 FROM (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS s1, l_linenumber * 20 AS s2, (l_extendedprice % 130)::BIGINT AS s3 FROM (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, floor(l_quantity) AS l_quantity, floor(l_extendedprice) AS l_extendedprice FROM lineitem)) WHERE greatest(s1, s2, s3) <= 100 AND s1 + s2 + s3 >= 3")
def _(spark, d):
    li = v.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long"), F.floor("l_quantity").alias("s1"),
                                             (F.col("l_linenumber").cast("long") * 20).alias("s2"), (F.floor("l_extendedprice") % 130).alias("s3"))
    return iv.training_lengths(li)


@query("flt8_label_prefix", "SELECT doc_id, source FROM documents WHERE starts_with(source, 'src1')")
def _(spark, d):
    return iv.label_prefix(v.table(spark, d, "documents").select("doc_id", "source"), "source", "src1")


@query("flt9_thin_occurrences", v.with_views(f"SELECT {ALL} FROM segments_user WHERE ('0x' || left(md5(stream_id || ':' || first), 8))::BIGINT % 1000 < 250", "segments_user"))
def _(spark, d):
    return iv.thin(v.segments_user(spark, d).withColumn("key", F.concat_ws(":", "stream_id", "first")), "key", 0.25).drop("key")


@query("flt10_random_access", v.with_views("SELECT first AS t, label FROM frames JOIN (SELECT t AS first FROM frames WHERE t % 7 = 3) q ON t = first", "frames"))
def _(spark, d):
    f = v.frames(spark, d).select(F.lit(0).alias("stream_id"), "t", "label")
    return iv.frames_at(f, f.where("t % 7 = 3").select("stream_id", "t")).select("t", "label")


@query("flt11_energy_stream", v.with_views("SELECT x.stream_id, t, label, energy FROM x JOIN energy USING (stream_id, t)", "segments_user", "energy", **EXPANDED))
def _(spark, d):
    return iv.expand(v.segments_user(spark, d)).join(v.energy(spark, d), ["stream_id", "t"])


@query("set1_copy", v.with_views(f"SELECT {ALL} FROM runs", "runs"))
def _(spark, d):
    return v.runs(spark, d)


@query("set2_append", v.with_views(f"SELECT {ALL} FROM segments_user UNION ALL SELECT stream_id, first - 40, first - 31, 9 FROM segments_user WHERE first >= 40 AND label = 1", "segments_user"))
def _(spark, d):
    s = v.segments_user(spark, d)
    return iv.append(s, s.where("first >= 40 and label = 1").select("stream_id", (F.col("first") - 40).alias("first"), (F.col("first") - 31).alias("last"), F.lit(9).cast("long").alias("label")))


@query("set3_merge_labels", v.with_views("SELECT stream_id, first, last, CASE WHEN label = 4 THEN 1 ELSE label END AS label FROM segments_user", "segments_user"))
def _(spark, d):
    return iv.merge_labels(v.segments_user(spark, d), 1, 4).withColumn("label", F.col("label").cast("long"))


@query("agg7_frames_per_label", v.with_views("SELECT label, sum(last - first + 1)::BIGINT AS frames, count(*) AS segments FROM segments_user GROUP BY label", "segments_user"))
def _(spark, d):
    return iv.frames_per_label(v.segments_user(spark, d))


@query("agg8_labels_in_order", v.with_views("SELECT stream_id, label, segments, row_number() OVER (PARTITION BY stream_id ORDER BY f) AS position FROM (SELECT stream_id, label, count(*) AS segments, min(first) AS f FROM segments_user GROUP BY 1, 2)", "segments_user"))
def _(spark, d):
    return iv.labels_in_order(v.segments_user(spark, d))


@query("collapse_runs_of_gap_free_frames", v.with_views("SELECT label, count(*) AS runs, max(last - first + 1) AS longest FROM runs GROUP BY label", "runs"))
def _(spark, d):
    return v.runs(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("runs"), F.max(iv.length()).alias("longest"))
