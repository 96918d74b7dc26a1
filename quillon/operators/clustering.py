"""Driver loops over Spark jobs: mixture training, diarization, speech detection, context trees.

Every round is a plan over all frames whose small result (models, pair scores) is written before the next round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import stores
from ..sources.stores import materialised
from . import gaussians as g
from . import hmm
from . import intervals as iv


def initial_clusters(frames: int, per_gaussian: int, gaussians: int, least: int, most: int) -> int:
    """DIA-1: rounded frames over what a cluster needs, plus one, inside the limits plus one."""
    n = int(0.5 + frames / (per_gaussian * gaussians)) + 1
    return min(max(n, least + 1), most + 1)


def train_mixture(frames: DataFrame, keys: list[str], components: int, steps: int = 3, min_count: float = 20.0, min_var: float = g.MIN_VAR) -> DataFrame:
    """PDF-13, TRN-2: fits one Gaussian and splits the heaviest until there are ``components``, with ``steps`` EM steps after each split."""
    one = g.as_vectors(g.fit(frames, [], min_var=min_var), [], ("mean", "var"))
    models = materialised(one.select(F.lit(0).cast("long").alias("model_id"), F.lit(0).cast("long").alias("comp_id"), F.lit(1.0).alias("weight"), "mean", "var"))
    while models.count() < components:
        before = models.count()
        models = g.split_heaviest(models)
        for _ in range(steps):
            models = materialised(g.em_step(frames, models, keys, min_count=min_count, min_var=min_var))
        if models.count() <= before:
            break
    return models


def cluster_models(frames: DataFrame) -> DataFrame:
    """DIA-6: what is kept of each cluster of (label, vec): ``cluster, frames, weight, mean, var``, one Gaussian each."""
    stats = g.as_vectors(g.fit(frames, ["label"]), ["label"], ("mean", "var", "n"))
    total = frames.agg(F.count(F.lit(1)).alias("total"))
    return stats.crossJoin(F.broadcast(total)).select(F.col("label").alias("cluster"), F.col("n")[0].alias("frames"), (F.col("n")[0] / F.col("total")).alias("weight"), "mean", "var")


def save_clusters(frames: DataFrame, path: str) -> None:
    """DIA-6: writes the clusters' models as a store."""
    stores.write(cluster_models(frames), path, "clusters")


def load_clusters(spark: SparkSession, path: str) -> DataFrame:
    """DIA-6: a store's clusters as models for scoring, and their frames: ``model_id, comp_id, weight, mean, var, frames``."""
    rows = stores.read(spark, path, "clusters")
    return rows.select(F.col("cluster").alias("model_id"), F.lit(0).cast("long").alias("comp_id"), F.lit(1.0).alias("weight"), "mean", "var", "frames")


def pair_gains(stats: DataFrame, only: int | None = None) -> DataFrame:
    """DIA-3, JOIN-8: gain in log likelihood from merging each pair of clusters (a < b), each one Gaussian of the merged data.

    With ``only``, the pairs of that cluster alone.

    ``stats`` has (label, d, n, w, sx, sxx). With one Gaussian a cluster's likelihood is a function of its variances alone:
    gain = sum over dimensions of (w_a ln var_a + w_b ln var_b - (w_a + w_b) ln var_ab) / 2.
    """
    var = F.greatest(F.col("sxx") / F.col("w") - F.pow(F.col("sx") / F.col("w"), 2), F.lit(g.MIN_VAR))
    own = stats.withColumn("lv", F.col("w") * F.log(var))
    a, b = (own.select(F.col("label").alias(x), "d", *[F.col(c).alias(f"{c}_{x}") for c in ("w", "sx", "sxx", "lv")]) for x in "ab")
    w = F.col("w_a") + F.col("w_b")
    both = F.greatest((F.col("sxx_a") + F.col("sxx_b")) / w - F.pow((F.col("sx_a") + F.col("sx_b")) / w, 2), F.lit(g.MIN_VAR))
    gain = (F.col("lv_a") + F.col("lv_b") - w * F.log(both)) / 2
    pairs = a.join(b, "d").where("a < b")
    if only is not None:
        one = (a.where(F.col("a") == only).join(b, "d"), a.join(b.where(F.col("b") == only), "d"))
        pairs = one[0].unionByName(one[1]).where("a < b")
    return pairs.groupBy("a", "b").agg(F.sum(gain).alias("gain"))


def cluster(frames: DataFrame, penalty: float = 0.0, least: int = 1) -> tuple[DataFrame, list[tuple[int, int, float]]]:
    """DIA-4: merges the pair with the largest gain plus ``penalty`` while that is above 0 and more than ``least`` clusters are left.

    ``frames`` has (label, vec). Accumulators are merged, not frames, so a round reads only one row for each cluster and dimension,
    and computes the gains of the merged cluster's pairs alone.
    """
    stats, merges = materialised(g.accumulate(frames, ["label"])), []
    left = stats.select("label").distinct().count()
    gains = materialised(pair_gains(stats), "gains")
    while left > least:
        best = gains.orderBy(F.desc("gain"), "a", "b").first()
        if best is None or best.gain + penalty <= 0:
            break
        merges.append((best.a, best.b, best.gain))
        stats = materialised(g.merge_accumulators(["label"], stats.withColumn("label", F.when(F.col("label") == best.b, best.a).otherwise(F.col("label")))), "step", stats)
        gone = F.col("a").isin(best.a, best.b) | F.col("b").isin(best.a, best.b)
        gains = materialised(gains.where(~gone).unionByName(pair_gains(stats, best.a)), "gains", gains)
        left -= 1
    relabelled = frames
    for a, b, _ in merges:
        relabelled = relabelled.withColumn("label", F.when(F.col("label") == b, a).otherwise(F.col("label")))
    return relabelled, merges


def align_and_train(frames: DataFrame, labels: DataFrame, rounds: int = 2, min_frames: int = 3, change: float = -5.0) -> DataFrame:
    """DIA-2: segments of frames (stream_id, t, vec) after ``rounds`` of fitting each label's Gaussian and decoding again."""
    segs = iv.collapse(labels)
    for _ in range(rounds):
        own = iv.expand(segs).join(frames, ["stream_id", "t"])
        stats = g.as_vectors(g.fit(own, ["label"]), ["label"], ("mean", "var"))
        models = materialised(stats.select(F.col("label").cast("long").alias("model_id"), F.lit(0).cast("long").alias("comp_id"), F.lit(1.0).alias("weight"), "mean", "var"))
        scores = g.mixture_scores(frames.select("stream_id", "t", "vec"), models, ["stream_id", "t"]).withColumnRenamed("model_id", "label")
        segs = materialised(hmm.decode_segments(scores, min_frames, change).withColumn("stream_id", F.col("stream_id").cast(frames.schema["stream_id"].dataType)))
    return segs


def detect_speech(frames: DataFrame, energy_dim: int = 0, rounds: int = 2, min_frames: int = 3, change: float = -5.0, factor: float = 0.5) -> DataFrame:
    """SAD-1: starts from frames above an energy threshold (label 2) and others (label 1), then aligns and trains."""
    e = frames.select("stream_id", "t", F.col("vec")[energy_dim].alias("energy"))
    cut = g.energy_threshold(e, ["stream_id"], factor).select("stream_id", "threshold")
    start = e.join(cut, "stream_id").select("stream_id", "t", F.when(F.col("energy") > F.col("threshold"), 2).otherwise(1).cast("long").alias("label"))
    return align_and_train(frames, start, rounds, min_frames, change)


def energy_speech(energy: DataFrame, factor: float = 2.0) -> DataFrame:
    """SAD-2: runs above (label 2) and not above (label 1) each stream's own threshold, by frame."""
    cut = g.energy_threshold(energy, ["stream_id"], factor).select("stream_id", "threshold")
    return iv.collapse(energy.join(cut, "stream_id").select("stream_id", "t", F.when(F.col("energy") > F.col("threshold"), 2).otherwise(1).cast("long").alias("label")))


def context_tree(stats: DataFrame, questions: dict[str, list[int]], min_gain: float = 0.10, min_count: float = 250.0, most: int = 250) -> list[dict]:
    """PDF-12: splits a state's contexts by yes/no questions on the left or right neighbour.

    ``stats`` has (left, right, d, n, w, sx, sxx), the accumulators of each context. Of all questions the one with the largest
    likelihood wins; it is taken if it gains more than ``min_gain`` for each frame and both sides have more than
    ``min_count`` frames. Accumulators are summed by Spark for all questions of a node in one job; frames are not read again.
    """
    var = F.greatest(F.col("sxx") / F.col("w") - F.pow(F.col("sx") / F.col("w"), 2), F.lit(g.MIN_VAR))
    tests = [(side, name) for side in ("left", "right") for name in sorted(questions)]
    todo, leaves = [[]], []
    while todo:
        path = todo.pop(0)
        node = stats
        for side, name, yes in path:
            hit = F.col(side).isin(questions[name])
            node = node.where(hit if yes else ~hit)
        asked = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), F.col(side).isin(questions[name]).alias("yes")) for i, (side, name) in enumerate(tests)]))
        sums = node.select("*", asked.alias("x")).groupBy("x.q", "x.yes", "d").agg(*[F.sum(c).alias(c) for c in ("n", "w", "sx", "sxx")])
        total = node.groupBy("d").agg(*[F.sum(c).alias(c) for c in ("n", "w", "sx", "sxx")]).agg(F.sum(-F.col("w") * F.log(var) / 2).alias("ll"), F.max("w").alias("w")).first()
        split = sums.groupBy("q", "yes").agg(F.sum(-F.col("w") * F.log(var) / 2).alias("ll"), F.max("w").alias("w"))
        split = split.groupBy("q").agg(F.sum("ll").alias("ll"), F.min("w").alias("least"), F.count(F.lit(1)).alias("sides")).where(f"sides = 2 and least > {min_count}")
        # Rounded, so that equal likelihoods are equal in whatever order they were summed.
        best = split.orderBy(F.desc(F.round("ll", 6)), "q").first()
        if best is not None and total.w and (best.ll - total.ll) / total.w > min_gain and len(leaves) + len(todo) + 2 <= most:
            side, name = tests[best.q]
            todo += [[*path, (side, name, True)], [*path, (side, name, False)]]
        else:
            leaves.append({"path": path, "frames": total.w, "ll": total.ll})
    return leaves
