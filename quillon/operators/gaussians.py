"""Gaussian statistics, mixtures and scores.

Accumulators are rows (keys, d, n, w, sx, sxx), one for each dimension, which Spark merges by sums; models are
rows (model_id, comp_id, weight, mean, var) with array values. Models are small beside frames: scoring
sends each model as one row to all tasks, in blocks of at most ``MAX_COMPONENTS`` components, and sums a model's
components inside the row, so frames are not dealt out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as vec

MIN_VAR = 0.01
MAP_RELEVANCE = 10.0
PRUNE_NATS = 7.0
MAX_COMPONENTS = 20_000


# -- accumulators --------------------------------------------------------------------------------------


def accumulate(frames: DataFrame, keys: list[str], weight: Column | None = None, vec_col: str = "vec") -> DataFrame:
    """AGG-1: n, sum of w, w x and w x^2 by key and dimension; frames without a positive weight don't count."""
    w = F.lit(1.0) if weight is None else weight
    rows = frames.select(*keys, w.alias("_w"), F.posexplode(vec_col).alias("d", "x")).where("_w > 0")
    return rows.groupBy(*keys, "d").agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("x")).alias("sx"),
                                       F.sum(F.col("_w") * F.col("x") * F.col("x")).alias("sxx"))


def merge_accumulators(keys: list[str], *parts: DataFrame) -> DataFrame:
    """AGG-2: the accumulators of a union."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(*keys, "d").agg(*[F.sum(c).alias(c) for c in ("n", "w", "sx", "sxx")])


def finalise(acc: DataFrame, min_var: float = MIN_VAR) -> DataFrame:
    """AGG-3: mean and floored population variance."""
    mean = F.col("sx") / F.col("w")
    return acc.withColumn("mean", mean).withColumn("var", F.greatest(F.col("sxx") / F.col("w") - F.col("mean") * F.col("mean"), F.lit(min_var)))


def fit(frames: DataFrame, keys: list[str], weight: Column | None = None, min_var: float = MIN_VAR) -> DataFrame:
    return finalise(accumulate(frames, keys, weight), min_var)


def as_vectors(stats: DataFrame, keys: list[str], columns: tuple[str, ...] = ("mean", "var")) -> DataFrame:
    """Rows by dimension become arrays in dimension order."""
    packed = stats.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("d", *columns))).alias("_p"))
    return packed.select(*keys, *[F.col("_p")[c].alias(c) for c in columns])


def map_adapt(prior: DataFrame, acc: DataFrame, keys: list[str], relevance: float = MAP_RELEVANCE) -> DataFrame:
    """AGG-4: prior means (keys, d, mean) moved to the data's by w / (w + relevance)."""
    a = F.coalesce(F.col("w") / (F.col("w") + relevance), F.lit(0.0))
    both = prior.select(*keys, "d", "mean").join(acc.select(*keys, "d", "w", "sx"), [*keys, "d"], "left")
    return both.select(*keys, "d", F.when(a > 0, (1 - a) * F.col("mean") + a * F.col("sx") / F.col("w")).otherwise(F.col("mean")).alias("mean"))


def speaker_adaptive(frames: DataFrame, base: DataFrame, own: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """AGG-5: accumulates x minus (own mean - base mean): ``own`` has (key, d, mean), ``base`` has (d, mean)."""
    offset = own.select(key, "d", F.col("mean").alias("m")).join(base.select("d", F.col("mean").alias("b")), "d").select(key, "d", (F.col("m") - F.col("b")).alias("off"))
    rows = frames.select(*{key, *keys}, F.posexplode("vec").alias("d", "x")).join(offset, [key, "d"]).withColumn("x", F.col("x") - F.col("off"))
    return rows.groupBy(*keys, "d").agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(1.0)).alias("w"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))


def mmi_update(mean: np.ndarray, var: np.ndarray, num: tuple, den: tuple, min_var: float = MIN_VAR, most: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """AGG-6: extended Baum-Welch update of one Gaussian from (w, sx, sxx) of both statistics.

    The smoothing constant starts at twice the denominator's weight and doubles, in two rounds, until no
    variance lies below the floor; if none is found in ``most`` tries the model stays.
    """
    (wn, xn, xxn), (wd, xd, xxd) = num, den
    if wn <= 0 or wd <= 0:
        return mean, var
    smooth, ok = 2.0 * wd, False
    for _ in range(2):
        for _ in range(most):
            total = wn - wd + smooth
            new = (smooth * mean + xn - xd) / total
            spread = (smooth * (mean * mean + var) + xxn - xxd) / total - new * new
            smooth *= 2.0
            ok = bool((spread >= min_var).all())
            if ok:
                break
    return (new, spread) if ok else (mean, var)


def mmi(models: DataFrame, num: DataFrame, den: DataFrame) -> DataFrame:
    """AGG-6 for a table of models (model_id, mean, var); statistics as (model_id, w, sx, sxx) with array values."""
    rows = models.join(num.toDF("model_id", "wn", "xn", "xxn"), "model_id").join(den.toDF("model_id", "wd", "xd", "xxd"), "model_id")

    def run(batches):
        for pdf in batches:
            a = lambda r, c: np.array(getattr(r, c))
            new = [mmi_update(a(r, "mean"), a(r, "var"), (r.wn, a(r, "xn"), a(r, "xxn")), (r.wd, a(r, "xd"), a(r, "xxd"))) for r in pdf.itertuples()]
            yield pdf[["model_id"]].assign(mean=[m.tolist() for m, _ in new], var=[v.tolist() for _, v in new])

    return rows.mapInPandas(run, f"model_id {models.schema['model_id'].dataType.simpleString()}, mean array<double>, var array<double>")


# -- thresholds, histograms, transitions ---------------------------------------------------------------


def energy_threshold(energy: DataFrame, keys: list[str], factor: float, column: str = "energy") -> DataFrame:
    """AGG-9: mean and deviation of the values above the mean, and mean - factor * deviation.

    A value that differs from the mean by no more than the rounding of its sum is equal to it, in whatever order values are summed.
    """
    first = energy.groupBy(*keys).agg(F.avg(column).alias("_m"))
    loud = energy.join(first, keys) if keys else energy.crossJoin(F.broadcast(first))
    out = loud.where(F.col(column) - F.col("_m") > F.abs("_m") * 1e-12).groupBy(*keys).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("dev"))
    return out.withColumn("threshold", F.col("mean") - factor * F.col("dev"))


def segment_means(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """AGG-10: mean and number of frames of each segment."""
    return rows.groupBy(*keys).agg(F.avg(column).alias("mean"), F.count(F.lit(1)).alias("n"))


def histogram(rows: DataFrame, column: str, weight: str, bins: int) -> DataFrame:
    """AGG-11: weight in ``bins`` equal bins between the least and largest value: ``bin, total, low, width``."""
    ends = rows.agg(F.min(column).alias("low"), ((F.max(column) - F.min(column)) / bins).alias("width"))
    at = F.when(F.col("width") > 0, F.least(F.greatest(F.floor((F.col(column) - F.col("low")) / F.col("width")), F.lit(0)), F.lit(bins - 1))).otherwise(F.lit(0))
    return rows.crossJoin(F.broadcast(ends)).groupBy(at.cast("long").alias("bin"), "low", "width").agg(F.sum(weight).alias("total"))


def threshold_from_top(hist: DataFrame, wanted: float) -> DataFrame:
    """The lower end of the highest bin above which at least ``wanted`` weight lies; the lowest bin if there is less."""
    w = Window.orderBy(F.desc("bin"))
    run = hist.withColumn("run", F.sum("total").over(w))  # one row for each bin
    return run.agg(F.coalesce(F.max(F.when(F.col("run") >= wanted, F.col("bin"))), F.min("bin")).alias("bin"), F.first("low").alias("low"), F.first("width").alias("width")).select(
        "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("threshold"))


def mixture_cdf(mixture: DataFrame, bins: int, spread: float = 4.0) -> DataFrame:
    """AGG-12: cumulative share of a mixture's density by dimension (weight, d, mean, var): ``d, bin, x, cdf``."""
    reach = mixture.groupBy("d").agg(F.min(F.col("mean") - spread * F.sqrt("var")).alias("low"), F.max(F.col("mean") + spread * F.sqrt("var")).alias("high"))
    step = (F.col("high") - F.col("low")) / (bins - 1)
    grid = reach.select("d", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "low", step.alias("step")).withColumn("x", F.col("low") + F.col("bin") * F.col("step"))
    density = F.col("weight") * F.exp(-F.pow(F.col("x") - F.col("mean"), 2) / (2 * F.col("var"))) / F.sqrt(2 * np.pi * F.col("var"))
    dense = grid.join(F.broadcast(mixture), "d").groupBy("d", "bin", "x").agg(F.sum(density).alias("p"))
    w = Window.partitionBy("d").orderBy("bin")
    return dense.select("d", "bin", "x", (F.sum("p").over(w) / F.sum("p").over(Window.partitionBy("d"))).alias("cdf"))


def inverse_cdf(cdf: DataFrame, shares: DataFrame) -> DataFrame:
    """The least grid value whose cumulative share reaches each wanted ``share``, by dimension."""
    return shares.join(cdf, "d").where("cdf >= share").groupBy("d", "share").agg(F.min("x").alias("x"))


def transitions(labels: DataFrame, order: str = "t", start: int = 0, uni_start: int = 1, bi_start: int = 0) -> tuple[DataFrame, DataFrame]:
    """AGG-13, LM-9: log probabilities of labels and of label changes inside a stream, as natural logarithms.

    A stream starts and ends in label ``start``. Returns (label, p) and (prev, cur, p) of seen changes;
    changes that are not there cost -10. Counts begin at ``uni_start`` and ``bi_start``.
    """
    w = Window.partitionBy("stream_id").orderBy(order)
    steps = labels.select("stream_id", F.coalesce(F.lag("label").over(w), F.lit(start)).alias("prev"), F.col("label").alias("cur"))
    ends = labels.groupBy("stream_id").agg(F.max_by("label", order).alias("prev")).withColumn("cur", F.lit(start))
    steps = steps.unionByName(ends)
    uni = steps.groupBy(F.col("cur").alias("label")).agg((F.count(F.lit(1)) + uni_start).alias("n"))
    total = steps.agg((F.count(F.lit(1)) + 1).alias("total"))
    bi = steps.groupBy("prev", "cur").agg((F.count(F.lit(1)) + bi_start).alias("n")).where("prev <> cur")
    p_bi = bi.join(uni.select(F.col("label").alias("prev"), F.col("n").alias("m")), "prev").select("prev", "cur", F.log(F.col("n") / F.col("m")).alias("p"))
    return uni.crossJoin(F.broadcast(total)).select("label", F.log(F.col("n") / F.col("total")).alias("p")), p_bi


# -- densities -----------------------------------------------------------------------------------------


def with_models(frames: DataFrame, models: DataFrame, most: int = MAX_COMPONENTS) -> DataFrame:
    """JOIN-7: each frame beside each model, whose components stand in the array ``_comps`` in the order of comp_id.

    Models go to all tasks, at most ``most`` components at a time (a single model with more is a block of its own);
    with several blocks the frames are read once for each.
    """
    packed = models.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("comp_id", *[c for c in models.columns if c not in ("model_id", "comp_id")]))).alias("_comps"))
    total = models.count()
    if total <= most:
        return frames.crossJoin(F.broadcast(packed))
    sizes = {r.model_id: r.n for r in models.groupBy("model_id").agg(F.count(F.lit(1)).alias("n")).orderBy("model_id").toLocalIterator()}
    blocks, room = [[]], most
    for m, n in sizes.items():
        if n > room and blocks[-1]:
            blocks.append([])
            room = most
        blocks[-1].append(m)
        room -= n
    out = None
    for b in blocks:
        part = frames.crossJoin(F.broadcast(packed.where(F.col("model_id").isin(b))))
        out = part if out is None else out.unionByName(part)
    return out


def _constants(models: DataFrame) -> DataFrame:
    """The part of a component's score that does not depend on frames is computed once."""
    return models.withColumn("const", vec.log_constant(F.col("var")) + F.log("weight")).select("model_id", "comp_id", "mean", "var", "const")


def _scored(frames: DataFrame, models: DataFrame, most: int = MAX_COMPONENTS) -> DataFrame:
    """The frames' columns, ``model_id`` and ``_lps``: (comp_id, lp) of each component."""
    lps = F.transform("_comps", lambda c: F.struct(c["comp_id"].alias("comp_id"), vec.clamp_log(c["const"] + vec.mahalanobis(F.col("vec"), c["mean"], c["var"])).alias("lp")))
    return with_models(frames, _constants(models), most).select(*frames.columns, "model_id", lps.alias("_lps"))


def component_scores(frames: DataFrame, models: DataFrame, most: int = MAX_COMPONENTS) -> DataFrame:
    """PDF-1, PDF-2: log of weight times density of each component, as ``lp``."""
    return _scored(frames, models, most).select(*frames.columns, "model_id", F.inline("_lps"))


def log_sum(lps: Column, prune: float = PRUNE_NATS) -> Column:
    """PDF-3: log of the summed probabilities of the components within ``prune`` of the best."""
    best = F.array_max(lps)
    return vec.clamp_log(best + F.log(F.aggregate(F.filter(lps, lambda x: x > best - prune), F.lit(0.0), lambda s, x: s + F.exp(x - best))))


def mixture_scores(frames: DataFrame, models: DataFrame, keys: list[str], prune: float = PRUNE_NATS) -> DataFrame:
    """PDF-3, PDF-4: ``logp`` of each frame (named by ``keys``, one row each) under each model; nothing is dealt out."""
    return _scored(frames.select(*keys, "vec"), models).select(*keys, "model_id", log_sum(F.transform("_lps", lambda x: x["lp"]), prune).alias("logp"))


def stream_scores(frames: DataFrame, models: DataFrame, keys: list[str], streams: list[tuple[int, int, float]]) -> DataFrame:
    """PDF-5: weighted sum of the scores of sub-vectors (start, size, weight); streams of weight 0 are left out."""
    used = [s for s in streams if s[2] != 0]
    part = lambda c, lo, size: vec.part(F.col(c), lo, size)
    own = models.select("model_id", "comp_id", *[x for i, (lo, size, _) in enumerate(used) for x in (
        part("mean", lo, size).alias(f"mean{i}"), part("var", lo, size).alias(f"var{i}"), (vec.log_constant(part("var", lo, size)) + F.log("weight")).alias(f"const{i}"))])
    rows = with_models(frames.select(*keys, "vec"), own)
    total = F.lit(0.0)

    def scored(i: int, lo: int, size: int) -> Column:
        return F.transform("_comps", lambda c: vec.clamp_log(c[f"const{i}"] + vec.mahalanobis(part("vec", lo, size), c[f"mean{i}"], c[f"var{i}"])))

    for i, (lo, size, weight) in enumerate(used):
        total = total + weight * log_sum(scored(i, lo, size))
    return rows.select(*keys, "model_id", total.alias("logp"))


def cosine(base: Column, a: Column, b: Column) -> Column:
    """PDF-6: cosine between the offsets of two means from a base mean; null if one is the base."""
    x, y = vec.subtract(base, a), vec.subtract(base, b)
    return F.try_divide(vec.dot(x, y), F.sqrt(vec.dot(x, x)) * F.sqrt(vec.dot(y, y)))


def scaled_distance(a: Column, b: Column, var: Column) -> Column:
    """PDF-6: squared mean difference over a's variances."""
    return -2 * vec.mahalanobis(a, b, var)


def norm_distance(var: Column) -> Column:
    return vec.total(F.transform(var, lambda v: 1 / v))


def posteriors(frames: DataFrame, models: DataFrame, keys: list[str], hard: bool = False, prune: float = PRUNE_NATS) -> DataFrame:
    """PDF-7, AGG-16: each frame's component shares ``gamma``; ``hard`` gives all to the best (the lowest component of equals)."""
    lp = F.transform("_lps", lambda x: x["lp"])
    rows = _scored(frames, models).withColumn("_best", F.array_max(lp))
    if hard:  # components stand in the order of their ids
        shares = F.transform("_lps", lambda x, i: F.struct(x["comp_id"].alias("comp_id"), x["lp"].alias("lp"), F.when(i == F.col("_first"), 1.0).otherwise(0.0).alias("gamma")))
        rows = rows.withColumn("_first", F.array_position(lp, F.col("_best")) - 1)
    else:
        mass = lambda x: F.when(x > F.col("_best") - prune, F.exp(x - F.col("_best"))).otherwise(0.0)
        rows = rows.withColumn("_sum", F.aggregate(lp, F.lit(0.0), lambda s, x: s + mass(x)))
        shares = F.transform("_lps", lambda x: F.struct(x["comp_id"].alias("comp_id"), x["lp"].alias("lp"), (mass(x["lp"]) / F.col("_sum")).alias("gamma")))
    return rows.select(*frames.columns, "model_id", F.inline(shares))


def occupation(post: DataFrame) -> DataFrame:
    """AGG-16: soft counts of components, heaviest first in ``rank``."""
    total = post.groupBy("model_id", "comp_id").agg(F.sum("gamma").alias("count"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy("model_id").orderBy(F.desc("count"), "comp_id")))


def em_step(frames: DataFrame, models: DataFrame, keys: list[str], hard: bool = False, min_count: float = 20.0, never_prune: bool = False,
            min_var: float = MIN_VAR) -> DataFrame:
    """PDF-7, PDF-8: one step; components with at most ``min_count`` frames are pruned, weights are shares of the rest."""
    post = posteriors(frames, models, keys, hard).where("gamma > 0")
    stats = fit(post, ["model_id", "comp_id"], F.col("gamma"), min_var)
    kept = as_vectors(stats if never_prune else stats.where(F.col("w") > min_count), ["model_id", "comp_id"], ("mean", "var", "w"))
    total = F.sum("_w").over(Window.partitionBy("model_id"))
    return kept.withColumn("_w", F.col("w")[0]).select("model_id", "comp_id", (F.col("_w") / total).alias("weight"), "mean", "var")


def split_heaviest(models: DataFrame, shift: float = 0.3) -> DataFrame:
    """PDF-9: halves the heaviest component; its copy's mean moves by -shift deviations on the widest dimension."""
    w = Window.partitionBy("model_id")
    rows = models.withColumn("_r", F.row_number().over(w.orderBy(F.desc("weight"), "comp_id"))).withColumn("_next", F.max("comp_id").over(w) + 1)
    first = F.array_position(F.col("var"), F.array_max("var")) - 1
    moved = F.transform("mean", lambda m, i: F.when(i == first, m - shift * F.sqrt(F.array_max("var"))).otherwise(m))
    half = F.when(F.col("_r") == 1, F.col("weight") / 2).otherwise(F.col("weight"))
    stay = rows.select("model_id", F.when(F.col("_r") == 1, F.col("_next")).otherwise(F.col("comp_id")).alias("comp_id"), half.alias("weight"), "mean", "var")
    copy = rows.where("_r = 1").select("model_id", "comp_id", half.alias("weight"), moved.alias("mean"), "var")
    return stay.unionByName(copy)


def keep_heaviest(models: DataFrame, k: int) -> DataFrame:
    """TOPK-8: the k heaviest components with weights that sum to 1 again."""
    w = Window.partitionBy("model_id")
    rows = models.withColumn("_r", F.row_number().over(w.orderBy(F.desc("weight"), "comp_id"))).where(F.col("_r") <= k).drop("_r")
    return rows.withColumn("weight", F.col("weight") / F.sum("weight").over(w))


def merge_mixtures(a: DataFrame, b: DataFrame, share: float) -> DataFrame:
    """PDF-10: interpolation of two mixtures of one model: a's components with weight share, b's with the rest."""
    top = a.groupBy("model_id").agg((F.max("comp_id") + 1).alias("_n"))
    moved = b.join(top, "model_id", "left").select("model_id", (F.col("comp_id") + F.coalesce("_n", F.lit(0))).alias("comp_id"), (F.col("weight") * (1 - share)).alias("weight"), "mean", "var")
    return a.select("model_id", "comp_id", (F.col("weight") * share).alias("weight"), "mean", "var").unionByName(moved)


def add_vector(models: DataFrame, vector: list[float]) -> DataFrame:
    """PDF-10: a new component at a bare vector: all weights become 1 / (n + 1), its variance is component 0's."""
    n = F.count(F.lit(1)).over(Window.partitionBy("model_id"))
    rows = models.withColumn("_n", n)
    new = rows.where("comp_id = 0").select("model_id", F.col("_n").cast("long").alias("comp_id"), (1 / (F.col("_n") + 1)).alias("weight"),
                                          F.array(*[F.lit(float(x)) for x in vector]).alias("mean"), "var")
    return rows.select("model_id", F.col("comp_id").cast("long").alias("comp_id"), (1 / (F.col("_n") + 1)).alias("weight"), "mean", "var").unionByName(new)


def order_by_distance(models: DataFrame) -> DataFrame:
    """SORT-3: components by the distance of their means from component 0's, as ``position``."""
    first = models.where("comp_id = 0").select("model_id", F.col("mean").alias("_m"))
    rows = models.join(F.broadcast(first), "model_id").withColumn("distance", F.sqrt(vec.squared_distance(F.col("mean"), F.col("_m")))).drop("_m")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("model_id").orderBy("distance", "comp_id")))


def state_scores(scores: DataFrame, states: DataFrame, contexts: DataFrame) -> DataFrame:
    """PDF-11: log density and transitions of the state that a model uses in a context.

    ``scores`` has (t, gmm_id, logp), ``states`` (model, state, gmm_id, log_self, log_next), ``contexts`` (model, ctx_key, state).
    """
    return contexts.join(states, ["model", "state"]).join(scores, "gmm_id")


def label_likelihood(scores: DataFrame) -> DataFrame:
    """PDF-14: total log likelihood of each label's frames under its own model."""
    return scores.where("label = model_id").groupBy("label").agg(F.sum("logp").alias("logp"), F.count(F.lit(1)).alias("frames"))


def stream_decisions(scores: DataFrame, rules: DataFrame) -> DataFrame:
    """PDF-18, JOIN-11, AGG-17: phone scores from the rules that apply: sum of each rule's log odds in the wanted direction.

    ``scores`` has (t, rule, yes, no); ``rules`` has (phone, rule, wanted) with wanted 1, 0, or null for no say.
    """
    odds = F.when(F.col("wanted") == 1, F.col("yes") - F.col("no")).otherwise(F.col("no") - F.col("yes"))
    return scores.join(F.broadcast(rules.where("wanted is not null")), "rule").groupBy("t", "phone").agg(F.sum(odds).alias("score"))


def posterior_matrix(scores: DataFrame, keys: list[str], scale: float = 30.0) -> DataFrame:
    """PDF-19: shares of exp(logp / scale) over the models of each frame."""
    w = Window.partitionBy(*keys)
    p = F.exp((F.col("logp") - F.max("logp").over(w)) / scale)
    rows = scores.withColumn("_p", p)
    return rows.withColumn("posterior", F.col("_p") / F.sum("_p").over(w)).drop("_p")


# -- normalisation -------------------------------------------------------------------------------------


def cmvn(dims: DataFrame, by: list[str], mean: bool = True, var: bool = True, keep: list[int] | None = None) -> DataFrame:
    """WIN-9: each dimension less its group's mean, over its group's deviation; dimensions in ``keep`` stay.

    Rows are (keys, d, x). Means and deviations are an aggregate that is joined back, so a group is never one window.
    """
    stats = dims.groupBy(*by, "d").agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    rows = dims.join(stats, [*by, "d"])
    held = F.col("d").isin(keep) if keep else F.lit(False)
    m = F.when(held, 0.0).otherwise(F.col("_m") if mean else F.lit(0.0))
    s = F.when(held | (F.col("_s") == 0), 1.0).otherwise(F.col("_s") if var else F.lit(1.0))
    return rows.withColumn("x", (F.col("x") - m) / s).drop("_m", "_s")


def best_warp(scores: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-10: the warp with the largest total log likelihood; the lowest of equals."""
    total = scores.groupBy(*keys, "warp").agg(F.sum("logp").alias("logp"))
    return total.groupBy(*keys).agg(F.max(F.struct("logp", (-F.col("warp")).alias("w"))).alias("_b")).select(*keys, (-F.col("_b.w")).alias("warp"), F.col("_b.logp").alias("logp"))


# -- verification --------------------------------------------------------------------------------------


def llr(scores: DataFrame, keys: list[str], ubm) -> DataFrame:
    """SPK-1: mean log likelihood ratio of each model against the background model ``ubm``."""
    sums = scores.groupBy(*keys, "model_id").agg(F.sum("logp").alias("s"), F.count(F.lit(1)).alias("n"))
    back = sums.where(F.col("model_id") == ubm).select(*keys, F.col("s").alias("b"))
    return sums.where(F.col("model_id") != ubm).join(back, keys).select(*keys, "model_id", ((F.col("s") - F.col("b")) / F.col("n")).alias("score"))


def standardise(scores: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """SPK-2: scores less the mean over the deviation of ``stats`` (keys, mean, dev); 0 where there is no deviation, as all scores are the mean."""
    z = F.when(F.col("dev") > 0, (F.col("score") - F.col("mean")) / F.col("dev")).otherwise(0.0)
    return scores.join(stats, keys).withColumn("score", z).drop("mean", "dev")


def score_stats(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("dev"))


# -- selection -----------------------------------------------------------------------------------------


def confident_subset(segment_scores: DataFrame, wanted: int, bins: int = 50) -> DataFrame:
    """SAD-3: segments whose mean score lies above the threshold under which ``wanted`` frames are left.

    ``segment_scores`` has (mean, n). Bins reach from the mean of means to the best; whatever is worse is in the first.
    """
    ends = segment_scores.agg(F.avg("mean").alias("low"), ((F.max("mean") - F.avg("mean")) / bins).alias("width"))
    at = F.least(F.greatest(F.floor((F.col("mean") - F.col("low")) / F.col("width")), F.lit(0)), F.lit(bins - 1)).cast("long")
    hist = segment_scores.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin"), "low", "width").agg(F.sum("n").alias("total"))
    cut = threshold_from_top(hist, wanted)
    return segment_scores.crossJoin(F.broadcast(cut.select("threshold"))).where("mean > threshold").drop("threshold")


def split_on_energy(segment_means_: DataFrame, silence: int, sound: int, quiet: int, loud: int, half: int = 50, unknown: int = 525) -> DataFrame:
    """SAD-4: labels segments by their mean energy: the loudest ``loud`` frames are sound, the quietest ``quiet`` silence.

    Of 2 * half bins the upper half may become sound, the lower silence; the rest is ``unknown``.
    """
    hist = histogram(segment_means_, "mean", "n", 2 * half)
    up, down = Window.orderBy(F.desc("bin")), Window.orderBy("bin")
    runs = hist.select("bin", "low", "width", F.sum("total").over(up).alias("above"), F.sum("total").over(down).alias("below"))
    cut = runs.agg(
        F.greatest(F.coalesce(F.max(F.when(F.col("above") >= loud, F.col("bin"))), F.lit(half + 1)) - 1, F.lit(half)).alias("hi"),
        F.least(F.coalesce(F.min(F.when(F.col("below") >= quiet, F.col("bin"))), F.lit(half - 1)) + 1, F.lit(half)).alias("lo"),
        F.first("low").alias("low"), F.first("width").alias("width"))
    limits = cut.select((F.col("low") + F.col("hi") * F.col("width")).alias("s_min"), (F.col("low") + F.col("lo") * F.col("width")).alias("q_max"))
    label = F.when(F.col("mean") >= F.col("s_min"), sound).when(F.col("mean") <= F.col("q_max"), silence).otherwise(unknown)
    return segment_means_.crossJoin(F.broadcast(limits)).withColumn("label", label).drop("s_min", "q_max")
