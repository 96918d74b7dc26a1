"""Programs: whole jobs from files to files, put together from the operators.

``python -m quillon.programs NAME --key value ...`` runs one in a Spark session; ``PROGRAMS`` has the functions, which take a session and
keyword arguments. Vectors are read from binary vector files, segments from segment files, models from stores.
"""

from __future__ import annotations

import inspect
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import clustering as cl
from .operators import gaussians as g
from .operators import intervals as iv
from .operators import recognise as rc
from .operators import search as se
from .operators import signal as sg
from .sources import language as la
from .sources import segments as sm
from .sources import stores
from .sources import vectors as ve
from .streaming import online as on

PROGRAMS: dict[str, Callable] = {}


def program(fn: Callable) -> Callable:
    PROGRAMS[fn.__name__.replace("_", "-")] = fn
    return fn


def _segments(spark: SparkSession, path: str) -> DataFrame:
    return sm.read_segments(spark, path, prefix_len=3, check=False)


def _labelled(spark: SparkSession, vectors: str, segments: str) -> DataFrame:
    """Frames inside segments, with their labels."""
    return iv.expand(_segments(spark, segments)).join(ve.read_vectors(spark, vectors), ["stream_id", "t"])


def _scores(frames: DataFrame, models: DataFrame) -> DataFrame:
    return g.mixture_scores(frames, models, ["stream_id", "t"])


@program
def extract_features(spark: SparkSession, *, files: str, output: str, cepstra: int = 12, warp: float = 1.0) -> None:
    """Features with slopes of the raw sound files that a list names, as a table (stream_id, t, vec)."""
    sg.deltas(sg.extract(sg.listed_pcm(spark, files), sg.FeatureOptions(cepstra=cepstra, warp=warp))).write.mode("overwrite").parquet(output)


@program
def segment(spark: SparkSession, *, vectors: str, output: str, rounds: int = 2, min_frames: int = 3, factor: float = 0.5) -> None:
    """Speech and silence of each stream, as segment files."""
    sm.write_segments(cl.detect_speech(ve.read_vectors(spark, vectors), rounds=rounds, min_frames=min_frames, factor=factor), output)


@program
def cluster(spark: SparkSession, *, vectors: str, segments: str, output: str, piece: int = 250, clusters: int = 8, penalty: float = 0.0, store: str = "") -> None:
    """Who speaks when: pieces of segments are dealt to clusters, which are merged while that gains; a store keeps the clusters."""
    start = iv.round_robin(_segments(spark, segments), piece, clusters)
    frames = iv.expand(start).join(ve.read_vectors(spark, vectors), ["stream_id", "t"])
    out, _ = cl.cluster(frames, penalty)
    if store:
        cl.save_clusters(out, store)
    sm.write_segments(iv.collapse(out.select("stream_id", "t", "label")), output)


@program
def choose_warp(spark: SparkSession, *, vectors: str, models: str, output: str) -> None:
    """The warp step whose model (model_id is the step) fits each stream best."""
    scores = _scores(ve.read_vectors(spark, vectors), stores.read(spark, models, "gmm")).withColumnRenamed("model_id", "warp")
    g.best_warp(scores, ["stream_id"]).write.mode("overwrite").parquet(output)


@program
def verify(spark: SparkSession, *, vectors: str, models: str, output: str, background: int = 0) -> None:
    """Log likelihood ratios of each stream under each model, normalised by model and then by stream."""
    s = g.llr(_scores(ve.read_vectors(spark, vectors), stores.read(spark, models, "gmm")), ["stream_id"], background)
    z = g.standardise(s, g.score_stats(s, ["model_id"]), ["model_id"]).select("stream_id", "model_id", F.col("score").alias("z"))
    t = g.standardise(s, g.score_stats(s, ["stream_id"]), ["stream_id"]).select("stream_id", "model_id", F.col("score").alias("t"))
    s.join(z, ["stream_id", "model_id"]).join(t, ["stream_id", "model_id"]).write.mode("overwrite").parquet(output)


@program
def speaker_statistics(spark: SparkSession, *, vectors: str, models: str, output: str) -> None:
    """Soft counts and sums of each stream under a mixture's components."""
    post = g.posteriors(ve.read_vectors(spark, vectors), stores.read(spark, models, "gmm"), ["stream_id", "t"]).where("gamma > 0")
    stores.write(g.accumulate(post, ["stream_id", "model_id", "comp_id"], F.col("gamma")), output, "accumulators")


@program
def build_language_model(spark: SparkSession, *, arpa: str, output: str, vocabulary: str = "") -> None:
    """An n-gram store of an ARPA file, of the words of a dictionary if one is given."""
    words = la.read_lexicon(spark, vocabulary).select("word").distinct() if vocabulary else None
    stores.write(la.read_arpa(spark, arpa, words), output, "ngram")


@program
def build_lexicon(spark: SparkSession, *, dictionary: str, output: str, phones: str = "") -> None:
    """A tree store of a pronunciation dictionary."""
    words = la.read_lexicon(spark, dictionary, la.read_phones(spark, phones) if phones else None)
    nodes = se.build_trie(words.select("word_id", "phones"))
    stores.write(nodes.select(F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), "phone", "next", "depth", "word_id"), output, "trie")


@program
def make_training_set(spark: SparkSession, *, vectors: str, segments: str, output: str) -> None:
    """Labelled frames with a part for each label."""
    _labelled(spark, vectors, segments).select("stream_id", "t", "vec", "label").write.mode("overwrite").partitionBy("label").parquet(output)


@program
def merge_training_sets(spark: SparkSession, *, first: str, second: str, output: str) -> None:
    """The records of two training sets."""
    spark.read.parquet(first).unionByName(spark.read.parquet(second)).write.mode("overwrite").partitionBy("label").parquet(output)


@program
def train_model(spark: SparkSession, *, training: str, label: int, output: str, components: int = 8, steps: int = 3) -> None:
    """A mixture of one label's frames; its model_id is the label."""
    frames = spark.read.parquet(training).where(F.col("label") == label).select("stream_id", "t", "vec")
    stores.write(cl.train_mixture(frames, ["stream_id", "t"], components, steps).withColumn("model_id", F.lit(label).cast("long")), output, "gmm")


@program
def finish_training(spark: SparkSession, *, statistics: str, output: str) -> None:
    """Gaussians of stored statistics (label, d, n, w, sx, sxx), one model of one component for each label."""
    one = g.as_vectors(g.finalise(g.merge_accumulators(["label"], stores.read(spark, statistics, "accumulators"))), ["label"], ("mean", "var"))
    stores.write(one.select(F.col("label").cast("long").alias("model_id"), F.lit(0).cast("long").alias("comp_id"), F.lit(1.0).alias("weight"), "mean", "var"), output, "gmm")


@program
def train_mmi(spark: SparkSession, *, models: str, numerator: str, denominator: str, output: str) -> None:
    """Models moved by the difference of two stores of statistics."""
    old = stores.read(spark, models, "gmm")
    sums = [g.as_vectors(stores.read(spark, p, "accumulators"), ["label"], ("w", "sx", "sxx")).select("label", F.col("w")[0].alias("w"), "sx", "sxx") for p in (numerator, denominator)]
    new = g.mmi(old.select("model_id", "mean", "var"), *sums)
    stores.write(old.drop("mean", "var").join(new, "model_id"), output, "gmm")


@program
def adapt_means(spark: SparkSession, *, models: str, training: str, output: str, relevance: float = g.MAP_RELEVANCE) -> None:
    """Means of one-component models moved to the frames of the label of the same number."""
    old = stores.read(spark, models, "gmm")
    prior = old.select(F.col("model_id").alias("label"), F.posexplode("mean").alias("d", "mean"))
    acc = g.accumulate(spark.read.parquet(training), ["label"])
    moved = g.as_vectors(g.map_adapt(prior, acc.withColumn("label", F.col("label").cast("long")), ["label"], relevance), ["label"], ("mean",))
    stores.write(old.drop("mean").join(moved.withColumnRenamed("label", "model_id"), "model_id"), output, "gmm")


@program
def merge_models(spark: SparkSession, *, first: str, second: str, output: str) -> None:
    """The second store's models, and those of the first that the second lacks."""
    a, b = stores.read(spark, first, "gmm"), stores.read(spark, second, "gmm")
    stores.write(b.unionByName(a.join(b.select("model_id").distinct(), "model_id", "left_anti").select(b.columns)), output, "gmm")


@program
def normalise_weights(spark: SparkSession, *, models: str, output: str, keep: int = 64) -> None:
    """Each model's heaviest components, with weights that sum to one."""
    stores.write(g.keep_heaviest(stores.read(spark, models, "gmm"), keep), output, "gmm")


@program
def prepare_statistics(spark: SparkSession, *, vectors: str, segments: str, output: str) -> None:
    """Statistics of each label's frames."""
    stores.write(g.accumulate(_labelled(spark, vectors, segments), ["label"]), output, "accumulators")


@program
def average_energy(spark: SparkSession, *, vectors: str, output: str, dimension: int = 0, factor: float = 0.5) -> None:
    """Mean energy of the louder frames of each stream, and the threshold below it."""
    e = ve.read_vectors(spark, vectors).select("stream_id", F.col("vec")[dimension].alias("energy"))
    g.energy_threshold(e, ["stream_id"], factor).write.mode("overwrite").parquet(output)


@program
def preprocess(spark: SparkSession, *, files: str, output: str) -> None:
    """The lines of a file list as a table."""
    la.read_file_list(spark, files).write.mode("overwrite").parquet(output)


@program
def recognise(spark: SparkSession, *, scores: str, dictionary: str, arpa: str, output: str, beam: float = 200.0, lm_scale: float = 27.5) -> None:
    """Words of each utterance of a table of scores (utt, t, phone, state, logp), as lines."""
    lexicon = [(r.word, tuple(r.phones)) for r in la.read_lexicon(spark, dictionary).select("word", "phones").toLocalIterator()]
    lm = la.read_arpa(spark, arpa).where("n <= 2").select("n", "w1", "w2", "p", "bo")
    uni, bi = {}, {}
    for r in lm.toLocalIterator():  # the decoder holds its model in memory, as it does its tree
        if r.n == 1:
            uni[r.w1] = (r.p, r.bo)
        else:
            bi[r.w1, r.w2] = r.p
    words = rc.recognise(spark.read.parquet(scores), lexicon, rc.Bigram(uni, bi), rc.Search(beam=beam, lm_scale=lm_scale))
    lines = la.hypothesis_lines(words).repartition("utt").sortWithinPartitions("utt", "ord")
    lines.select(F.concat_ws(" ", F.concat(F.lit("("), "utt", F.lit(")")), "value")).write.mode("overwrite").text(output)


@program
def listen(spark: SparkSession, *, input: str, output: str, checkpoint: str, run: int = on.RUN) -> None:
    """Closed utterances of a folder of energy tables (stream_id, t, energy) that keeps growing; ends when all there is has been read."""
    schema = spark.read.parquet(input).schema
    on.run_available(on.online_segments(spark.readStream.schema(schema).parquet(input), run), output, checkpoint)


def arguments(name: str, words: list[str]) -> dict:
    """Typed keyword arguments of a program from ``--key value`` pairs; an unknown or missing key is an error."""
    if name not in PROGRAMS:
        raise SystemExit(f"no program {name}; there are {', '.join(sorted(PROGRAMS))}")
    known = {k.replace("_", "-"): p for k, p in inspect.signature(PROGRAMS[name]).parameters.items() if k != "spark"}
    if len(words) % 2:
        raise SystemExit("each --key needs a value")
    out = {}
    for key, value in zip(words[::2], words[1::2], strict=True):
        p = known.get(key.removeprefix("--"))
        if p is None:
            raise SystemExit(f"{name} has no option {key}")
        kind = type(p.default) if p.default is not p.empty else (int if p.annotation == "int" else str)
        out[p.name] = kind(value)
    lacking = [k for k, p in known.items() if p.default is p.empty and p.name not in out]
    if lacking:
        raise SystemExit(f"{name} needs --{', --'.join(lacking)}")
    return out


def main(words: list[str]) -> None:
    if not words:
        raise SystemExit(f"programs: {', '.join(sorted(PROGRAMS))}")
    options = arguments(words[0], words[1:])
    spark = SparkSession.builder.appName(words[0]).getOrCreate()
    PROGRAMS[words[0]](spark, **options)


if __name__ == "__main__":
    main(sys.argv[1:])
