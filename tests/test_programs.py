"""Whole jobs from files to files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import programs
from quillon.sources import segments as sm
from quillon.sources import stores
from quillon.sources import vectors as ve


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two streams of vectors in which loud and quiet stretches take turns."""
    top = tmp_path_factory.mktemp("programs")
    (top / "vec").mkdir()
    r = np.random.default_rng(0)
    for s in ("a", "b"):
        rows = [(s, t, [float(x) for x in r.normal(8.0 if t // 40 % 2 else -8.0, 1, 2)]) for t in range(240)]
        body = ve.encode_vectors(spark.createDataFrame(rows, "stream_id string, t long, vec array<double>")).first().content
        (top / "vec" / f"{s}.bin").write_bytes(bytes(body))
    return top


def run(spark, name, **options):
    words = [x for k, v in options.items() for x in (f"--{k.replace('_', '-')}", str(v))]
    programs.PROGRAMS[name](spark, **programs.arguments(name, words))


def test_from_vectors_to_models(spark, folder):
    p = lambda x: f"file://{folder}/{x}"
    run(spark, "segment", vectors=p("vec"), output=p("seg"))
    found = sm.read_segments(spark, p("seg"), prefix_len=3, check=False)
    assert found.select("stream_id").distinct().count() == 2 and found.select("label").distinct().count() == 2
    run(spark, "cluster", vectors=p("vec"), segments=p("seg"), output=p("clu"), piece=40, clusters=4, penalty=5.0, store=p("clu-store"))
    assert stores.read(spark, p("clu-store"), "clusters").agg(F.sum("frames")).first()[0] > 400
    run(spark, "make-training-set", vectors=p("vec"), segments=p("seg"), output=p("set"))
    run(spark, "merge-training-sets", first=p("set"), second=p("set"), output=p("both"))
    assert spark.read.parquet(p("both")).count() == 2 * spark.read.parquet(p("set")).count()
    run(spark, "train-model", training=p("set"), label=2, output=p("m2"), components=2, steps=1)
    run(spark, "prepare-statistics", vectors=p("vec"), segments=p("seg"), output=p("acc"))
    run(spark, "finish-training", statistics=p("acc"), output=p("one"))
    means = {x.model_id: x.mean for x in stores.read(spark, p("one"), "gmm").collect()}
    assert means[1][0] < -6 < 6 < means[2][0]
    run(spark, "adapt-means", models=p("one"), training=p("set"), output=p("map"))
    run(spark, "train-mmi", models=p("one"), numerator=p("acc"), denominator=p("acc"), output=p("mmi"))
    run(spark, "merge-models", first=p("one"), second=p("m2"), output=p("merged"))
    assert sorted({x.model_id for x in stores.read(spark, p("merged"), "gmm").collect()}) == [1, 2]
    run(spark, "normalise-weights", models=p("merged"), output=p("top"), keep=1)
    assert [x.weight for x in stores.read(spark, p("top"), "gmm").collect()] == [1.0, 1.0]
    run(spark, "verify", vectors=p("vec"), models=p("one"), output=p("trials"), background=1)
    assert spark.read.parquet(p("trials")).count() == 2
    run(spark, "choose-warp", vectors=p("vec"), models=p("one"), output=p("warp"))
    run(spark, "speaker-statistics", vectors=p("vec"), models=p("one"), output=p("bw"))
    run(spark, "average-energy", vectors=p("vec"), output=p("energy"))
    assert all(x.threshold < x.mean for x in spark.read.parquet(p("energy")).collect())


def test_from_text_to_words(spark, folder):
    p = lambda x: f"file://{folder}/{x}"
    (folder / "dict").write_text("ab p q\nc q\n")
    (folder / "phones").write_text("Number of phones: 2\nNumber of SIL's: 0\np\nq\n")
    (folder / "lm").write_text("\\data\\\nngram 1=3\nngram 2=1\n\n\\1-grams:\n-1.0 <s> -0.1\n-0.5 ab -0.2\n-0.7 c\n\n\\2-grams:\n-0.1 ab c\n\n\\end\\\n")
    run(spark, "build-lexicon", dictionary=p("dict"), output=p("tree"), phones=p("phones"))
    assert stores.read(spark, p("tree"), "trie").where("word_id is not null").count() == 2
    run(spark, "build-language-model", arpa=p("lm"), output=p("ngrams"), vocabulary=p("dict"))
    assert stores.read(spark, p("ngrams"), "ngram").count() == 3
    rows = [("u", t, ph, s, 0.0 if (ph == "p") == (t < 6) else -9.0) for t in range(12) for ph in "pq" for s in range(3)]
    spark.createDataFrame(rows, "utt string, t long, phone string, state long, logp double").write.parquet(p("scores"))
    run(spark, "recognise", scores=p("scores"), dictionary=p("dict"), arpa=p("lm"), output=p("hyp"))
    assert [x.value.split()[:2] for x in spark.read.text(p("hyp")).collect()][0] == ["(u)", "ab"]
    (folder / "s.raw").write_bytes(np.arange(2000, dtype="<i2").tobytes())
    (folder / "list").write_text(f"{folder}/s.raw meta hyp\n")
    run(spark, "extract-features", files=p("list"), output=p("features"))
    assert len(spark.read.parquet(p("features")).first().vec) == 26
    run(spark, "preprocess", files=p("list"), output=p("table"))
    assert spark.read.parquet(p("table")).first().meta == "meta"
    energy = [("s", t, 1.0 if t % 40 < 10 else -1.0) for t in range(100)]
    spark.createDataFrame(energy, "stream_id string, t long, energy double").write.parquet(p("live"))
    run(spark, "listen", input=p("live"), output=p("utts"), checkpoint=p("state"))
    assert spark.read.parquet(p("utts")).count() == 2


def test_arguments():
    for words, said in ((["nothing"], "no program"), (["segment", "--vectors"], "needs a value"), (["segment", "--x", "1"], "no option"), (["segment", "--vectors", "v"], "needs --output")):
        with pytest.raises(SystemExit, match=said):
            programs.arguments(words[0], words[1:])
    assert programs.arguments("train-model", ["--training", "a", "--label", "3", "--output", "b", "--steps", "2"]) == {"training": "a", "label": 3, "output": "b", "steps": 2}
