"""Queries of Gaussian statistics, mixtures, normalisation and verification over the frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..operators import gaussians as g
from ..operators import intervals as iv
from . import views as v
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query
R = "(round({}, {}) + 0.0)"


def r(x: str, n: int = 6) -> str:
    return R.format(x, n)


def models(spark, d):
    """The labels' Gaussians as one mixture with a component for each label."""
    one = g.as_vectors(v.gmm(spark, d), ["label"], ("mean", "var", "weight"))
    return one.select(F.lit(0).cast("long").alias("model_id"), F.col("label").alias("comp_id"), F.col("weight")[0].alias("weight"), "mean", "var")


def label_models(spark, d):
    """One model of one component for each label."""
    return models(spark, d).select(F.col("comp_id").alias("model_id"), F.lit(0).cast("long").alias("comp_id"), F.lit(1.0).alias("weight"), "mean", "var")


LP = {"lp": "SELECT t, f.label, gmm.label AS comp, weight, greatest(-1000.0, ln(any_value(weight)) + sum(-0.5 * ln(2 * pi() * var) - (x - mean) * (x - mean) / (2 * var))) AS lp FROM dims f JOIN gmm USING (d) GROUP BY t, f.label, gmm.label, weight"}
OWN = {"own": "SELECT t, f.label, gmm.label AS model_id, greatest(-1000.0, sum(-0.5 * ln(2 * pi() * var) - (x - mean) * (x - mean) / (2 * var))) AS logp FROM dims f JOIN gmm USING (d) GROUP BY t, f.label, gmm.label"}


@query("agg1_accumulate", v.with_views(f"SELECT label, d, count(*) AS n, {r('sum(w)')} AS w, {r('sum(w * x)')} AS sx, {r('sum(w * x * x)')} AS sxx FROM (SELECT *, (t % 3)::DOUBLE AS w FROM dims) WHERE w > 0 GROUP BY label, d", "dims"))
def _(spark, d):
    a = g.accumulate(v.frames(spark, d), ["label"], (F.col("t") % 3).cast("double"))
    return a.select("label", F.col("d").cast("long"), "n", *[F.round(c, 6).alias(c) for c in ("w", "sx", "sxx")])


@query("agg2_merge_accumulators", v.with_views(f"SELECT label, d, count(*) AS n, {r('sum(x)')} AS sx, {r('sum(x * x)')} AS sxx FROM dims GROUP BY label, d", "dims"))
def _(spark, d):
    f = v.frames(spark, d)
    parts = [g.accumulate(f.where(F.col("t") % 4 == k), ["label"]) for k in range(4)]
    return g.merge_accumulators(["label"], *parts).select("label", F.col("d").cast("long"), "n", F.round("sx", 6).alias("sx"), F.round("sxx", 6).alias("sxx"))


@query("agg3_gaussian_fit", v.with_views(f"SELECT label, d, {r('mean')} AS mean, {r('var')} AS var FROM gmm", "gmm"))
def _(spark, d):
    return g.fit(v.frames(spark, d), ["label"]).select("label", F.col("d").cast("long"), F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


@query("agg4_map_adapt", v.with_views(f"SELECT o.label, o.d, {r('(1 - n / (n + 10.0)) * m + n / (n + 10.0) * o.mean')} AS mean FROM (SELECT label, d, count(*)::DOUBLE AS n, avg(x) AS mean FROM dims GROUP BY 1, 2) o JOIN (SELECT d, avg(x) AS m FROM dims GROUP BY d) p USING (d)", "dims"))
def _(spark, d):
    f = v.frames(spark, d)
    prior = g.fit(f, []).select("d", "mean")
    acc = g.accumulate(f, ["label"])
    both = prior.crossJoin(F.broadcast(f.select("label").distinct())).select("label", "d", "mean")
    return g.map_adapt(both, acc, ["label"]).select("label", F.col("d").cast("long"), F.round("mean", 6).alias("mean"))


@query("agg5_speaker_adaptive", v.with_views(f"SELECT d, count(*) AS n, {r('sum(y)')} AS sx, {r('sum(y * y)', 5)} AS sxx FROM (SELECT d, x - (o.m - p.m) AS y FROM dims JOIN (SELECT label, d, avg(x) AS m FROM dims GROUP BY 1, 2) o USING (label, d) JOIN (SELECT d, avg(x) AS m FROM dims GROUP BY d) p USING (d)) GROUP BY d", "dims"))
def _(spark, d):
    f = v.frames(spark, d)
    out = g.speaker_adaptive(f, g.fit(f, []), g.fit(f, ["label"]), "label", [])
    return out.select(F.col("d").cast("long"), "n", F.round("sx", 6).alias("sx"), F.round("sxx", 5).alias("sxx"))


@query("agg6_mmi_update", v.with_views(f"""SELECT label AS model_id, d, {r('CASE WHEN second IS NULL THEN mean ELSE new END')} AS mean, {r('CASE WHEN second IS NULL THEN var ELSE spread END')} AS var FROM tried JOIN chosen USING (label) WHERE k = coalesce(second, 0)""", "gmm",
    num="SELECT label, d, count(*)::DOUBLE AS wn, sum(x) AS xn, sum(x * x) AS xxn FROM dims GROUP BY 1, 2", den="SELECT label, d, count(*)::DOUBLE AS wd, sum(x) AS xd, sum(x * x) AS xxd FROM dims WHERE t % 3 = 0 GROUP BY 1, 2",
    tried="SELECT *, (s * (mean * mean + var) + xxn - xxd) / (wn - wd + s) - new * new AS spread FROM (SELECT *, (s * mean + xn - xd) / (wn - wd + s) AS new FROM (SELECT gmm.label, gmm.d, mean, var, wn, xn, xxn, wd, xd, xxd, k, 2 * wd * pow(2, k) AS s FROM gmm JOIN num USING (label, d) JOIN den USING (label, d), (SELECT unnest(range(0, 60)) AS k)))",
    good="SELECT label, k FROM tried GROUP BY 1, 2 HAVING min(spread) >= 0.01",
    chosen="SELECT label, min(k) FILTER (k > one) AS second FROM (SELECT *, min(k) OVER (PARTITION BY label) AS one FROM good) GROUP BY label"))
def _(spark, d):
    f = v.frames(spark, d)
    stats = lambda rows: g.as_vectors(g.accumulate(rows, ["label"]), ["label"], ("w", "sx", "sxx")).select("label", F.col("w")[0].alias("w"), "sx", "sxx")
    base = label_models(spark, d).select("model_id", "mean", "var")
    out = g.mmi(base, stats(f), stats(f.where("t % 3 = 0")))
    return out.select("model_id", F.posexplode(F.arrays_zip("mean", "var")).alias("d", "p")).select("model_id", F.col("d").cast("long"), F.round("p.mean", 6).alias("mean"), F.round("p.var", 6).alias("var"))


@query("agg9_average_energy", v.with_views(f"SELECT stream_id, {r('avg(energy) + 1e-9')} AS mean, {r('avg(energy) + 1e-9 - 2 * stddev_pop(energy)', 5)} AS threshold FROM energy JOIN (SELECT stream_id, avg(energy) AS m FROM energy GROUP BY 1) USING (stream_id) WHERE energy > m GROUP BY stream_id", "energy"))
def _(spark, d):
    return g.energy_threshold(v.energy(spark, d), ["stream_id"], 2.0).select("stream_id", F.round(F.col("mean") + 1e-9, 6).alias("mean"), F.round(F.col("threshold") + 1e-9, 5).alias("threshold"))


SEGX = {"sx": "SELECT r.first, r.last, r.label, x FROM runs r JOIN dims ON t BETWEEN first AND last AND d = 0", "sm": "SELECT first, last, any_value(label) AS label, avg(x) AS mean, count(*) AS n FROM sx GROUP BY first, last"}


def segment_values(spark, d):
    """Mean of the first dimension over each run of labels."""
    runs = v.runs(spark, d).withColumn("label", F.struct("first", "last", "label"))
    x = v.dims(spark, d).where("d = 0").select("t", "x")
    rows = iv.expand(runs).select("t", "label.first", "label.last", "label.label").join(x, "t")
    return g.segment_means(rows, ["first", "last", "label"], "x")


@query("agg10_segment_means", v.with_views(f"SELECT first, last, label, {r('mean')} AS mean, n FROM sm", "runs", "dims", **SEGX))
def _(spark, d):
    return segment_values(spark, d).withColumn("mean", F.round("mean", 6))


HIST = {"e": "SELECT min(mean) AS low, (max(mean) - min(mean)) / 100 AS width FROM sm", "h": "SELECT least(greatest(floor((mean - low) / width), 0), 99)::BIGINT AS bin, sum(n)::BIGINT AS total FROM sm, e GROUP BY 1"}


@query("agg11_histogram", v.with_views("SELECT bin, total FROM h", "runs", "dims", **SEGX, **HIST))
def _(spark, d):
    return g.histogram(segment_values(spark, d), "mean", "n", 100).select("bin", "total")


@query("agg11_threshold_from_top", v.with_views(f"SELECT max(bin) AS bin, {r('max(low + bin * width)')} AS threshold FROM (SELECT bin, low, width, sum(total) OVER (ORDER BY bin DESC) AS run FROM h, e) WHERE run >= 200", "runs", "dims", **SEGX, **HIST))
def _(spark, d):
    return g.threshold_from_top(g.histogram(segment_values(spark, d), "mean", "n", 100), 200).withColumn("threshold", F.round("threshold", 6))


CDF = {"grid": "SELECT d, bin, low + bin * step AS x FROM (SELECT d, unnest(range(0, 200)) AS bin, low, step FROM (SELECT d, min(mean - 4 * sqrt(var)) AS low, (max(mean + 4 * sqrt(var)) - min(mean - 4 * sqrt(var))) / 199 AS step FROM gmm GROUP BY d))",
       "p": "SELECT d, bin, x, sum(weight * exp(-(x - mean) * (x - mean) / (2 * var)) / sqrt(2 * pi() * var)) AS p FROM grid JOIN gmm USING (d) GROUP BY 1, 2, 3",
       "cdf": "SELECT d, bin, x, sum(p) OVER (PARTITION BY d ORDER BY bin) / sum(p) OVER (PARTITION BY d) AS cdf FROM p"}


@query("agg12_mixture_cdf", v.with_views(f"SELECT d, bin, {r('x', 5)} AS x, {r('cdf', 5)} AS cdf FROM cdf", "gmm", **CDF))
def _(spark, d):
    return g.mixture_cdf(v.gmm(spark, d), 200).select(F.col("d").cast("long"), F.col("bin").cast("long"), F.round("x", 5).alias("x"), F.round("cdf", 5).alias("cdf"))


@query("agg12_inverse_cdf", v.with_views(f"SELECT d, share, {r('min(x)', 5)} AS x FROM cdf, (SELECT unnest([0.1, 0.37, 0.5, 0.83])::DOUBLE AS share) WHERE cdf >= share GROUP BY d, share", "gmm", **CDF))
def _(spark, d):
    cdf = g.mixture_cdf(v.gmm(spark, d), 200)
    shares = cdf.select("d").distinct().select("d", F.explode(F.array(*map(F.lit, (0.1, 0.37, 0.5, 0.83)))).alias("share"))
    return g.inverse_cdf(cdf, shares).select(F.col("d").cast("long"), "share", F.round("x", 5).alias("x"))


STEPS = {"st": "SELECT coalesce(lag(label) OVER (PARTITION BY stream_id ORDER BY first), 0) AS prev, label AS cur FROM segments_user UNION ALL SELECT max_by(label, first), 0 FROM segments_user GROUP BY stream_id",
         "uni": "SELECT cur AS label, count(*) + 1 AS n FROM st GROUP BY cur"}


@query("agg13_label_log_probs", v.with_views(f"SELECT label, {r('ln(n / (SELECT count(*) + 1 FROM st))')} AS p FROM uni", "segments_user", **STEPS))
def _(spark, d):
    return g.transitions(v.segments_user(spark, d), "first")[0].withColumn("p", F.round("p", 6))


@query("lm9_segment_bigrams", v.with_views(f"SELECT prev, cur, {r('ln(c / n)')} AS p FROM (SELECT prev, cur, count(*) AS c FROM st WHERE prev <> cur GROUP BY 1, 2) JOIN uni ON prev = label", "segments_user", **STEPS))
def _(spark, d):
    return g.transitions(v.segments_user(spark, d), "first")[1].withColumn("p", F.round("p", 6))


@query("agg14_weighted_path_totals", "SELECT l_returnflag AS kind, count(*) AS n, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT AS blamed, (round(sum(l_quantity * l_tax), 2) + 0.0) AS total FROM lineitem GROUP BY 1")
def _(spark, d):
    return v.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).alias("blamed"), F.round(F.sum(F.col("l_quantity") * F.col("l_tax")), 2).alias("total"))


@query("agg15_running_statistics", v.with_views(f"SELECT stream_id, t, {r('avg(energy) OVER w + 1e-9', 5)} AS mean, {r('max(energy) OVER w', 5)} AS top FROM energy WINDOW w AS (PARTITION BY stream_id ORDER BY t)", "energy"))
def _(spark, d):
    w = Window.partitionBy("stream_id").orderBy("t")
    return v.energy(spark, d).select("stream_id", "t", F.round(F.avg("energy").over(w) + 1e-9, 5).alias("mean"), F.round(F.max("energy").over(w), 5).alias("top"))


POST = {"b": "SELECT *, max(lp) OVER (PARTITION BY t) AS best FROM lp", "q": "SELECT *, CASE WHEN lp > best - 7.0 THEN exp(lp - best) ELSE 0 END AS p FROM b", "post": "SELECT *, p / sum(p) OVER (PARTITION BY t) AS gamma FROM q"}


@query("agg16_soft_occupation", v.with_views(f"SELECT comp AS comp_id, {r('sum(gamma)', 5)} AS count FROM post GROUP BY comp", "gmm", **LP, **POST))
def _(spark, d):
    post = g.posteriors(v.frames(spark, d), models(spark, d), ["t"])
    return g.occupation(post).select("comp_id", F.round("count", 5).alias("count"))


@query("agg17_articulatory_scores", v.with_views(f"SELECT t, phone, {r('sum(CASE WHEN wanted = 1 THEN x ELSE -x END)')} AS score FROM dims JOIN (SELECT phone, rule, (phone + rule) % 3 AS wanted FROM (SELECT unnest(range(0, 5)) AS phone), (SELECT unnest(range(0, 64)) AS rule)) ON d = rule WHERE wanted < 2 GROUP BY t, phone", "dims"))
def _(spark, d):
    rules = spark.range(5).select(F.col("id").alias("phone"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("rule"))
    w = (F.col("phone") + F.col("rule")) % 3
    rules = rules.withColumn("wanted", F.when(w < 2, w))
    scores = v.dims(spark, d).select("t", F.col("d").alias("rule"), (F.col("x") / 2).alias("yes"), (-F.col("x") / 2).alias("no"))
    return g.stream_decisions(scores, rules).withColumn("score", F.round("score", 6))


@query("agg18_union_training_sets", v.with_views("SELECT label, count(*) AS n, count(DISTINCT t) AS frames FROM (SELECT t, label FROM frames WHERE t % 2 = 0 UNION ALL SELECT t, label FROM frames WHERE t % 3 = 0) GROUP BY label", "frames"))
def _(spark, d):
    f = v.frames(spark, d).select("t", "label")
    return f.where("t % 2 = 0").unionByName(f.where("t % 3 = 0")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("t").alias("frames"))


@query("win9_cmvn_by_cluster", v.with_views(f"SELECT t, d, {r('(x - avg(x) OVER w) / stddev_pop(x) OVER w')} AS x FROM dims WINDOW w AS (PARTITION BY label, d)", "dims"))
def _(spark, d):
    return g.cmvn(v.dims(spark, d), ["label"]).select("t", F.col("d").cast("long"), F.round("x", 6).alias("x"))


@query("win9_cmvn_global", v.with_views(f"SELECT t, d, CASE WHEN d = 63 THEN {r('x')} ELSE {r('(x - avg(x) OVER w) / stddev_pop(x) OVER w')} END AS x FROM dims WINDOW w AS (PARTITION BY d)", "dims"))
def _(spark, d):
    return g.cmvn(v.dims(spark, d), [], keep=[63]).select("t", F.col("d").cast("long"), F.round("x", 6).alias("x"))


@query("win10_best_warp", v.with_views(f"SELECT label, model_id AS warp, {r('s', 4)} AS logp FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, model_id) AS k FROM (SELECT label, model_id, sum(logp) AS s FROM own GROUP BY 1, 2)) WHERE k = 1", "gmm", **OWN))
def _(spark, d):
    s = g.mixture_scores(v.frames(spark, d), label_models(spark, d), ["t", "label"]).withColumnRenamed("model_id", "warp")
    return g.best_warp(s, ["label"]).withColumn("logp", F.round("logp", 4))


@query("pdf1_log_constant", v.with_views(f"SELECT label AS model_id, {r('-0.5 * sum(ln(2 * pi() * var))')} AS cp FROM gmm GROUP BY label", "gmm"))
def _(spark, d):
    return label_models(spark, d).select("model_id", F.round(vec.log_constant(F.col("var")), 6).alias("cp"))


@query("pdf2_gaussian_log_density", v.with_views(f"SELECT t, label, model_id, {r('logp', 5)} AS logp FROM own", "gmm", **OWN))
def _(spark, d):
    return g.mixture_scores(v.frames(spark, d), label_models(spark, d), ["t", "label"]).withColumn("logp", F.round("logp", 5))


MIX = {"mix": "SELECT t, any_value(label) AS label, greatest(-1000.0, max(best) + ln(sum(p))) AS logp FROM q GROUP BY t"}


@query("pdf3_mixture_log_density", v.with_views(f"SELECT t, {r('logp', 5)} AS logp FROM mix", "gmm", **LP, **POST, **MIX))
def _(spark, d):
    return g.mixture_scores(v.frames(spark, d), models(spark, d), ["t"]).select("t", F.round("logp", 5).alias("logp"))


@query("pdf5_multi_stream", v.with_views(f"SELECT t, {r('sum(s)', 5)} AS logp FROM (SELECT t, k, CASE k WHEN 0 THEN 0.75 ELSE 0.25 END * greatest(-1000.0, max(best) + ln(sum(CASE WHEN lp > best - 7.0 THEN exp(lp - best) ELSE 0 END))) AS s FROM (SELECT *, max(lp) OVER (PARTITION BY t, k) AS best FROM l2) GROUP BY t, k) GROUP BY t", "gmm",
    l2="SELECT t, d // 32 AS k, gmm.label AS comp, greatest(-1000.0, ln(any_value(weight)) + sum(-0.5 * ln(2 * pi() * var) - (x - mean) * (x - mean) / (2 * var))) AS lp FROM dims f JOIN gmm USING (d) GROUP BY t, k, gmm.label"))
def _(spark, d):
    out = g.stream_scores(v.frames(spark, d), models(spark, d), ["t"], [(0, 32, 0.75), (32, 32, 0.25), (0, 64, 0.0)])
    return out.select("t", F.round("logp", 5).alias("logp"))


@query("pdf6_distances", v.with_views(f"SELECT a.label AS a, b.label AS b, {r('sum((a.mean - b.mean) * (a.mean - b.mean) / a.var)', 5)} AS scaled, {r('sum(1 / a.var)', 5)} AS norm, {r('sum((m - a.mean) * (m - b.mean)) / (sqrt(sum((m - a.mean) * (m - a.mean))) * sqrt(sum((m - b.mean) * (m - b.mean))))', 5)} AS cosine FROM gmm a JOIN gmm b ON a.d = b.d AND a.label < b.label JOIN (SELECT d, avg(x) AS m FROM dims GROUP BY d) u ON u.d = a.d GROUP BY a.label, b.label", "gmm"))
def _(spark, d):
    m = label_models(spark, d)
    base = g.as_vectors(g.fit(v.frames(spark, d), []), [], ("mean",)).select(F.col("mean").alias("m"))
    a, b = (m.select(F.col("model_id").alias(x), F.col("mean").alias(f"mean_{x}"), F.col("var").alias(f"var_{x}")) for x in "ab")
    rows = a.join(F.broadcast(b), F.col("a") < F.col("b")).crossJoin(F.broadcast(base))
    return rows.select("a", "b", F.round(g.scaled_distance(F.col("mean_a"), F.col("mean_b"), F.col("var_a")), 5).alias("scaled"),
                       F.round(g.norm_distance(F.col("var_a")), 5).alias("norm"), F.round(g.cosine(F.col("m"), F.col("mean_a"), F.col("mean_b")), 5).alias("cosine"))


@query("pdf7_posteriors", v.with_views(f"SELECT t, comp AS comp_id, {r('gamma')} AS gamma FROM post", "gmm", **LP, **POST))
def _(spark, d):
    return g.posteriors(v.frames(spark, d), models(spark, d), ["t"]).select("t", "comp_id", F.round("gamma", 6).alias("gamma"))


@query("pdf7_hard_assignment", v.with_views("SELECT t, comp AS comp_id FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY lp DESC, comp) AS k FROM lp) WHERE k = 1", "gmm", **LP))
def _(spark, d):
    return g.posteriors(v.frames(spark, d), models(spark, d), ["t"], hard=True).where("gamma = 1").select("t", "comp_id")


@query("pdf8_em_step", v.with_views(f"SELECT comp AS comp_id, d, {r('any_value(w) / sum(any_value(w)) OVER (PARTITION BY d)', 5)} AS weight, {r('sum(gamma * x) / any_value(w)', 5)} AS mean, {r('greatest(sum(gamma * x * x) / any_value(w) - pow(sum(gamma * x) / any_value(w), 2), 0.01)', 5)} AS var FROM (SELECT comp, t, gamma, sum(gamma) OVER (PARTITION BY comp) AS w FROM post WHERE gamma > 0) JOIN dims USING (t) WHERE w > 20 GROUP BY comp, d", "gmm", **LP, **POST))
def _(spark, d):
    out = g.em_step(v.frames(spark, d), models(spark, d), ["t"])
    return out.select("comp_id", "weight", F.posexplode(F.arrays_zip("mean", "var")).alias("d", "p")).select(
        "comp_id", F.col("d").cast("long"), F.round("weight", 5).alias("weight"), F.round("p.mean", 5).alias("mean"), F.round("p.var", 5).alias("var"))


def _flat(m):
    return m.select(F.col("comp_id").cast("long"), F.round("weight", 6).alias("weight"), F.posexplode(F.arrays_zip("mean", "var")).alias("d", "p")).select(
        "comp_id", "weight", F.col("d").cast("long"), F.round("p.mean", 5).alias("mean"), F.round("p.var", 5).alias("var"))


WIDE = {"top": "SELECT label FROM gmm GROUP BY label ORDER BY any_value(weight) DESC, label LIMIT 1", "wide": "SELECT d FROM gmm WHERE label = (SELECT label FROM top) ORDER BY var DESC, d LIMIT 1"}


@query("pdf9_split_heaviest", v.with_views(f"""SELECT CASE WHEN label = (SELECT label FROM top) THEN (SELECT max(label) + 1 FROM gmm) ELSE label END AS comp_id, {r("CASE WHEN label = (SELECT label FROM top) THEN weight / 2 ELSE weight END")} AS weight, d, {r('mean', 5)} AS mean, {r('var', 5)} AS var FROM gmm
UNION ALL SELECT label, {r('weight / 2')}, d, {r('CASE WHEN d = (SELECT d FROM wide) THEN mean - 0.3 * sqrt(var) ELSE mean END', 5)}, {r('var', 5)} FROM gmm WHERE label = (SELECT label FROM top)""", "gmm", **WIDE))
def _(spark, d):
    return _flat(g.split_heaviest(models(spark, d)))


@query("pdf10_interpolate_mixtures", v.with_views(f"SELECT label AS comp_id, {r('weight * 0.6')} AS weight, d, {r('mean', 5)} AS mean, {r('var', 5)} AS var FROM gmm UNION ALL SELECT label + (SELECT max(label) + 1 FROM gmm), {r('weight * 0.4')}, d, {r('mean', 5)}, {r('var', 5)} FROM gmm", "gmm"))
def _(spark, d):
    return _flat(g.merge_mixtures(models(spark, d), models(spark, d), 0.6))


@query("pdf10_add_vector", v.with_views(f"SELECT label AS comp_id, {r('1.0 / (1 + (SELECT count(DISTINCT label) FROM gmm))')} AS weight, d, {r('mean', 5)} AS mean, {r('var', 5)} AS var FROM gmm UNION ALL SELECT (SELECT count(DISTINCT label) FROM gmm), {r('1.0 / (1 + (SELECT count(DISTINCT label) FROM gmm))')}, d, 0.5, {r('var', 5)} FROM gmm WHERE label = 0", "gmm"))
def _(spark, d):
    return _flat(g.add_vector(models(spark, d), [0.5] * 64))


@query("topk8_keep_heaviest", v.with_views(f"SELECT label AS comp_id, {r('weight / (SELECT sum(w) FROM k)')} AS weight, d, {r('mean', 5)} AS mean, {r('var', 5)} AS var FROM gmm JOIN k USING (label)", "gmm", k="SELECT label, any_value(weight) AS w FROM gmm GROUP BY label ORDER BY w DESC, label LIMIT 4"))
def _(spark, d):
    return _flat(g.keep_heaviest(models(spark, d), 4))


@query("sort3_order_components", v.with_views(f"SELECT label AS comp_id, {r('dist', 5)} AS distance, row_number() OVER (ORDER BY dist, label) AS position FROM (SELECT a.label, sqrt(sum((a.mean - b.mean) * (a.mean - b.mean))) AS dist FROM gmm a JOIN gmm b ON a.d = b.d AND b.label = 0 GROUP BY a.label)", "gmm"))
def _(spark, d):
    return g.order_by_distance(models(spark, d)).select("comp_id", F.round("distance", 5).alias("distance"), "position")


@query("pdf11_state_lookup", v.with_views(f"SELECT t, own.label % 4 AS model, (t % 3) AS state, {r('logp', 5)} AS logp FROM own WHERE model_id = (own.label % 4) * 2 + CASE WHEN t % 3 = 2 THEN 1 ELSE 0 END", "gmm", **OWN))
def _(spark, d):
    scores = g.mixture_scores(v.frames(spark, d), label_models(spark, d), ["t", "label"]).withColumnRenamed("model_id", "gmm_id")
    grid = spark.range(4).select(F.col("id").alias("model"), F.explode(F.expr("sequence(0L, 2L)")).alias("state"))
    states = grid.withColumn("gmm_id", F.col("model") * 2 + F.when(F.col("state") == 2, 1).otherwise(0)).withColumn("log_self", F.lit(-0.5)).withColumn("log_next", F.lit(-0.9))
    contexts = grid.withColumn("ctx_key", F.col("state"))
    out = g.state_scores(scores, states, contexts).where("label % 4 = model and t % 3 = ctx_key")
    return out.select("t", "model", "state", F.round("logp", 5).alias("logp"))


@query("pdf14_label_likelihood", v.with_views(f"SELECT label, {r('sum(logp)', 3)} AS logp, count(*) AS frames FROM own WHERE label = model_id GROUP BY label", "gmm", **OWN))
def _(spark, d):
    s = g.mixture_scores(v.frames(spark, d), label_models(spark, d), ["t", "label"])
    return g.label_likelihood(s).withColumn("logp", F.round("logp", 3))


@query("pdf19_posterior_matrix", v.with_views(f"SELECT t, model_id, {r('p / sum(p) OVER (PARTITION BY t)')} AS posterior FROM (SELECT t, model_id, exp((logp - max(logp) OVER (PARTITION BY t)) / 30) AS p FROM own)", "gmm", **OWN))
def _(spark, d):
    s = g.mixture_scores(v.frames(spark, d), label_models(spark, d), ["t"])
    return g.posterior_matrix(s, ["t"]).select("t", "model_id", F.round("posterior", 6).alias("posterior"))


LLR = {"s": "SELECT label, model_id, sum(logp) AS s, count(*) AS n FROM own GROUP BY 1, 2", "llr": "SELECT s.label, s.model_id, (s.s - b.s) / s.n AS score FROM s JOIN s b ON s.label = b.label AND b.model_id = 0 WHERE s.model_id <> 0"}


def trial_scores(spark, d):
    s = g.mixture_scores(v.frames(spark, d), label_models(spark, d), ["t", "label"])
    return g.llr(s, ["label"], 0)


@query("spk1_log_likelihood_ratio", v.with_views(f"SELECT label, model_id, {r('score', 5)} AS score FROM llr", "gmm", **OWN, **LLR))
def _(spark, d):
    return trial_scores(spark, d).withColumn("score", F.round("score", 5))


@query("spk2_z_norm", v.with_views(f"SELECT label, model_id, {r('(score - avg(score) OVER w) / stddev_pop(score) OVER w', 5)} AS score FROM llr WINDOW w AS (PARTITION BY model_id)", "gmm", **OWN, **LLR))
def _(spark, d):
    s = trial_scores(spark, d)
    return g.standardise(s, g.score_stats(s, ["model_id"]), ["model_id"]).select("label", "model_id", F.round("score", 5).alias("score"))


@query("spk2_t_norm", v.with_views(f"SELECT label, model_id, {r('(score - avg(score) OVER w) / stddev_pop(score) OVER w', 5)} AS score FROM llr WINDOW w AS (PARTITION BY label)", "gmm", **OWN, **LLR))
def _(spark, d):
    s = trial_scores(spark, d)
    return g.standardise(s, g.score_stats(s, ["label"]), ["label"]).select("label", "model_id", F.round("score", 5).alias("score"))


@query("spk3_baum_welch_statistics", v.with_views(f"SELECT p.label, comp AS comp_id, d, {r('sum(gamma)', 5)} AS n, {r('sum(gamma * x)', 5)} AS f FROM post p JOIN dims USING (t) WHERE gamma > 0 GROUP BY p.label, comp, d", "gmm", **LP, **POST))
def _(spark, d):
    post = g.posteriors(v.frames(spark, d), models(spark, d), ["t"]).where("gamma > 0")
    acc = g.accumulate(post, ["label", "comp_id"], F.col("gamma"))
    return acc.select("label", "comp_id", F.col("d").cast("long"), F.round("w", 5).alias("n"), F.round("sx", 5).alias("f"))


@query("spk4_model_store", v.with_views(f"SELECT label AS comp_id, {r('weight')} AS weight, d, {r('mean', 5)} AS mean, {r('var', 5)} AS var FROM gmm", "gmm"))
def _(spark, d):
    from ..sources.stores import round_trip

    return _flat(round_trip(models(spark, d)))


@query("sad3_confident_subset", v.with_views("SELECT first, last, label, n FROM sm, (SELECT max(low + bin * width) AS cut FROM (SELECT bin, low, width, sum(total) OVER (ORDER BY bin DESC) AS run FROM h2, e2) WHERE run >= 150) WHERE mean > cut", "runs", "dims", **SEGX,
    e2="SELECT avg(mean) AS low, (max(mean) - avg(mean)) / 50 AS width FROM sm", h2="SELECT least(greatest(floor((mean - low) / width), 0), 49)::BIGINT AS bin, sum(n) AS total FROM sm, e2 GROUP BY 1"))
def _(spark, d):
    return g.confident_subset(segment_values(spark, d), 150).select("first", "last", "label", "n")


@query("sad4_split_on_energy", v.with_views("""SELECT first, last, n, CASE WHEN mean >= low + hi * width THEN 2 WHEN mean <= low + lo * width THEN 1 ELSE 525 END AS label FROM sm, e,
(SELECT greatest(coalesce(max(CASE WHEN above >= 120 THEN bin END), 51) - 1, 50) AS hi, least(coalesce(min(CASE WHEN below >= 90 THEN bin END), 49) + 1, 50) AS lo FROM (SELECT bin, sum(total) OVER (ORDER BY bin DESC) AS above, sum(total) OVER (ORDER BY bin) AS below FROM h))""", "runs", "dims", **SEGX, **HIST))
def _(spark, d):
    return g.split_on_energy(segment_values(spark, d), 1, 2, 90, 120).select("first", "last", "n", "label")
