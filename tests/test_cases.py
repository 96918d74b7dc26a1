"""Hand-computed cases of the timeline, statistics, language-model and search operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import config
from quillon.functions import text as tx
from quillon.functions import vectors as vec
from quillon.operators import clustering as cl
from quillon.operators import gaussians as g
from quillon.operators import hmm
from quillon.operators import intervals as iv
from quillon.operators import ngrams as ng
from quillon.operators import search as se
from quillon.operators import signal as sg
from quillon.sources import language as la
from quillon.sources import segments as sm
from quillon.sources import stores
from quillon.sources import vectors as ve

DDL = "stream_id string, first long, last long, label long"


def segs(spark, *rows):
    return spark.createDataFrame([("s", *r) for r in rows], DDL)


def got(df):
    return sorted((x["first"], x["last"], x["label"]) for x in df.collect())


def test_intersect(spark):
    assert got(iv.intersect(segs(spark, (0, 9, 1), (20, 29, 2)), segs(spark, (5, 24, 0)))) == [(5, 9, 1), (20, 24, 2)]
    one = segs(spark, (0, 10, 1)), segs(spark, (10, 20, 0))
    assert got(iv.intersect(*one, compat=True)) == [] and got(iv.intersect(*one)) == [(10, 10, 1)]


def test_subtract(spark):
    a, b = segs(spark, (0, 9, 1)), segs(spark, (5, 6, 0))
    assert got(iv.subtract(a, b)) == [(0, 4, 1), (7, 9, 1)]
    assert got(iv.subtract(a, b, compat=True, pool=40)) == [(0, 5, 1), (7, 10, 1)]


@pytest.mark.parametrize("bucket", [3, 512])
def test_intersection_and_difference_cover_the_source(spark, bucket):
    r = random.Random(bucket)

    def timeline():
        rows, at = [], 0
        for _ in range(40):
            at += r.randrange(0, 6)
            n = r.randrange(1, 30)
            rows.append((at, at + n - 1, r.randrange(3)))
            at += n
        return rows

    a, b = timeline(), timeline()
    both = iv.intersect(segs(spark, *a), segs(spark, *b), bucket=bucket)
    left = iv.subtract(segs(spark, *a), segs(spark, *b))
    frames = lambda rows: {(t, x) for f, e, x in rows for t in range(f, e + 1)}
    fb = {t for t, _ in frames(b)}
    assert frames(got(both)) == {(t, x) for t, x in frames(a) if t in fb}
    assert frames(got(left)) == {(t, x) for t, x in frames(a) if t not in fb}


def timeline_of(r, n, low=0):
    rows, at = [], 0
    for _ in range(n):
        at += r.randrange(0, 6)
        size = r.randrange(1, 30)
        rows.append((at, at + size - 1, low + r.randrange(3)))
        at += size
    return rows


def plan_of(df):
    return df._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("seed", [1, 2])
def test_differences_and_consensus_without_frames(spark, seed):
    r = random.Random(seed)
    a, b = timeline_of(r, 30), timeline_of(r, 20, 5) + [(3, 40, 4), (600, 1700, 6)]
    label = {t: x for f, e, x in a for t in range(f, e + 1)}
    held = {t: min(x for f, e, x in b if f <= t <= e) for f, e, _ in b for t in range(f, e + 1)}
    free = sorted(t for t in label if t not in held)
    runs = [[f for f in free if f - free.index(f) == k] for k in sorted({f - i for i, f in enumerate(free)})]
    out = iv.subtract(segs(spark, *a), segs(spark, *b), compat=True, pool=300)
    assert got(out) == [(x[0], x[-1] + 1, label[x[-1]]) for x in runs if x[-1] < 299]
    combos = {}
    for t in sorted(label.keys() | held.keys()):
        combos.setdefault((label.get(t), held.get(t)), []).append(t)
    number = {c: 0 for c, ts in combos.items() if len(ts) < 10} | {c: k + 1 for k, c in enumerate(c for c, ts in combos.items() if len(ts) > 20)}
    wanted = [(ts[i], next(u for u in ts[i:] if u + 1 not in ts), number[c]) for c, ts in combos.items() if c in number for i in range(len(ts)) if ts[i] - 1 not in ts]
    both = iv.consensus([segs(spark, *a), segs(spark, *b)], keep=20, drop=10)
    assert got(both) == sorted(wanted)
    # A sequence of frames from first to last would make a row for each frame.
    assert not any("sequence(first" in plan_of(x) for x in (out, both))


def test_low_energy_without_frames(spark):
    """Against the machine that goes through a segment frame by frame."""
    r = random.Random(5)
    rows = timeline_of(r, 40) + [(1000, 2600, 1), (3000, 3000, 2), (3100, 3100, 2)]
    loud = {t for t in range(3100) if r.random() < 0.6} | {3100}
    energy = spark.createDataFrame([("s", t, 1.0 if t in loud else (0.0 if t % 3 else float("nan"))) for t in range(3101) if t % 7], "stream_id string, t long, energy double")
    loud = {t for t in loud if t % 7}

    def parts(first, last, label, silence, speech, pad):
        out, start, quiet = [], first, 0
        for t in range(first, last + 1):
            if t not in loud:
                quiet += 1
                continue
            if quiet > silence:
                if t - quiet + pad - start > speech:
                    out.append((start, t - quiet + pad, label))
                start = t - pad
            quiet = 0
        end = last - quiet + pad if quiet > silence else last
        return out + [(start, end, label)] * (last > first and end - start > speech)

    for options in ((0, 3, 1), (2, 0, 5), (1, 4, 0)):
        out = iv.drop_low_energy(segs(spark, *rows), energy, 0.5, *options)
        assert got(out) == sorted(x for s in rows for x in parts(*s, *options))
        assert "sequence(first" not in plan_of(out)


def test_gaps_and_widening(spark):
    assert got(iv.fill_gaps(segs(spark, (0, 4, 1), (10, 14, 1)), 9)) == [(0, 4, 1), (5, 9, 9), (10, 14, 1)]
    assert got(iv.widen(segs(spark, (10, 19, 1), (30, 39, 2)), 0, 3)) == [(7, 22, 1), (27, 39, 2)]


def test_halving_and_cutting(spark):
    parts = {(x["first"], x["last"], x["part"]) for x in iv.halve(segs(spark, (0, 4, 1), (7, 7, 1))).collect()}
    assert parts == {(0, 1, "A"), (2, 4, "B"), (7, 7, "A")}
    assert got(iv.max_length(segs(spark, (0, 249, 1)), 1, 100, 50)) == [(0, 99, 1), (100, 249, 1)]


def test_sequential_machines(spark):
    assert got(iv.absorb_short(segs(spark, (0, 79, 3), (80, 89, 1), (90, 179, 3)), 3, 1, 74)) == [(0, 179, 3)]
    assert got(iv.resolve_overlap(segs(spark, (0, 4, 1), (5, 9, 7), (10, 14, 2)), 7)) == [(0, 4, 1), (5, 9, 1), (5, 9, 2), (10, 14, 2)]
    mask = spark.createDataFrame([("s", t, t < 20 or 24 <= t < 30) for t in range(50)], "stream_id string, t long, on boolean")
    assert got(iv.mask_to_segments(mask, 10)) == [(0, 29, 2), (30, 49, 1)]
    energy = spark.createDataFrame([("s", t, 0.0 if 40 <= t < 90 else 1.0) for t in range(140)], "stream_id string, t long, energy double")
    assert got(iv.drop_low_energy(segs(spark, (0, 139, 1)), energy, 0.5)) == [(0, 45, 1), (85, 139, 1)]


def test_relabel_long_is_strict(spark):
    rows = iv.relabel_long(segs(spark, (0, 99, 1), (100, 200, 1)), 1, 2, 100).collect()
    assert sorted((x["first"], x["label"], x["changed"]) for x in rows) == [(0, 1, 0), (100, 2, 101)]


def test_concat_refuses_disorder(spark):
    assert got(iv.concat(segs(spark, (0, 9, 1)), segs(spark, (10, 19, 1), (20, 29, 2)))) == [(0, 19, 1), (20, 29, 2)]
    with pytest.raises(Exception, match="ends before"):
        iv.concat(segs(spark, (0, 9, 1)), segs(spark, (1, 5, 1))).collect()


def test_segment_files(spark, tmp_path):
    path = tmp_path / "a.rttm"
    path.write_text("SPKR-INFO f 1 <NA>\nSPEAKER f 5 1.000 2.000 <NA> <NA> SPK02 <NA>\n")
    x = sm.read_segments(spark, str(path), prefix_len=3).first()
    assert (x["first"], x["last"], x["label"], x["warp"]) == (100, 298, 2, 5)
    line = [r.value for r in sm.segment_lines(sm.read_segments(spark, str(path), prefix_len=3)).orderBy("ord", "sub").collect()]
    assert line == ["SPKR-INFO f 1 <NA> <NA> <NA> unknown SPK02 <NA>", "SPEAKER f 5 1.000 1.990 <NA> <NA> SPK02 <NA>"]
    with pytest.raises(Exception, match="unknown label"):
        sm.read_segments(spark, str(path), label_map={"A": 1}).collect()
    (tmp_path / "u").write_text("f 1 1.00 2.00\nf 2 0.29 0.58\n")
    assert [(x["first"], x["last"]) for x in sm.read_regions(spark, str(tmp_path / "u"), "f").orderBy("first").collect()] == [(29, 57), (100, 199)]
    assert sm.read_regions(spark, str(tmp_path / "u"), "f", channel=2, compat=True).first()["first"] == int(0.29 * 100) == 28
    (tmp_path / "v").write_text("f 1 3.00 4.00\nf 1 1.00 2.00\n")
    with pytest.raises(Exception, match="not sorted"):
        sm.read_regions(spark, str(tmp_path / "v")).collect()
    assert sm.read_regions(spark, str(tmp_path / "v"), check=False).count() == 2


def test_vector_files(spark, tmp_path):
    f = spark.createDataFrame([("a", t, [float(t), 0.5]) for t in range(5)], "stream_id string, t long, vec array<double>")
    (tmp_path / "a.bin").write_bytes(bytes(ve.encode_vectors(f).first().content))
    assert sorted((x.t, x.vec) for x in ve.read_vectors(spark, str(tmp_path / "a.bin")).collect()) == [(t, [float(t), 0.5]) for t in range(5)]
    (tmp_path / "a.txt").write_text(" 1 2\n3 4\n\n5 6\n")
    assert [x.vec for x in ve.read_text_vectors(spark, str(tmp_path / "a.txt"), [1.0, 2.0], [2.0, 1.0]).orderBy("t").collect()] == [[0.0, 0.0], [1.0, 2.0]]
    (tmp_path / "a.raw").write_bytes(np.array([1, -2, 300], "<i2").tobytes() + b"x")
    assert ve.read_pcm(spark, str(tmp_path / "a.raw")).first().pcm == [1, -2, 300]
    (tmp_path / "b.raw").write_bytes(b"\x05\x00")
    (tmp_path / "list").write_text(f"{tmp_path}/a.raw x\n\n{tmp_path}/b.raw\n")
    assert sorted((x.stream_id, x.pcm) for x in sg.listed_pcm(spark, str(tmp_path / "list")).collect()) == [("a", [1, -2, 300]), ("b", [5])]


def test_gaussian_fit_and_merge(spark):
    f = spark.createDataFrame([([0.0], 2.0), ([3.0], 1.0), ([9.0], 0.0)], "vec array<double>, w double")
    x = g.fit(f, [], F.col("w")).first()
    assert (x.n, x.w, x.mean, x["var"]) == (2, 3.0, 1.0, 2.0)
    parts = [g.accumulate(f.where(c), [], F.col("w")) for c in ("w > 1", "w <= 1")]
    assert g.finalise(g.merge_accumulators([], *parts)).first()["var"] == 2.0


def test_log_sum_drops_far_components(spark):
    df = spark.createDataFrame([([-10.0, -12.0, -18.0],), ([float("nan")],), ([-5000.0],)], "lps array<double>")
    out = [x[0] for x in df.select(g.log_sum(F.col("lps"))).collect()]
    assert out[0] == pytest.approx(-9.873072, abs=1e-6) and out[1:] == [-1000.0, -1000.0]


def test_scores_do_not_depend_on_blocks(spark):
    r = np.random.default_rng(3)
    f = spark.createDataFrame([(t, [float(x) for x in r.normal(0, 2, 3)]) for t in range(20)], "t long, vec array<double>")
    rows = [(m, c, 1.0 / (m + 1), [float(x) for x in r.normal(0, 2, 3)], [1.0, 2.0, 0.5]) for m in range(5) for c in range(m + 1)]
    models = spark.createDataFrame(rows, "model_id long, comp_id long, weight double, mean array<double>, var array<double>")
    whole = sorted((x.t, x.model_id, x.comp_id, x.lp) for x in g.component_scores(f, models).collect())
    for most in (1, 4, 7):
        assert sorted((x.t, x.model_id, x.comp_id, x.lp) for x in g.component_scores(f, models, most).collect()) == whole
    assert len(whole) == 20 * 15
    plan = g.mixture_scores(f, models, ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(t" not in plan


def test_em_raises_likelihood_and_weights_sum_to_one(spark):
    r = np.random.default_rng(0)
    rows = [(int(t), [float(x) for x in r.normal((t % 2) * 4, 1, 3)]) for t in range(300)]
    f = spark.createDataFrame(rows, "t long, vec array<double>")
    m, before = cl.train_mixture(f, ["t"], 1), None
    for k in range(4):
        m = g.split_heaviest(m) if k == 0 else g.em_step(f, m, ["t"])
        score = g.mixture_scores(f, m, ["t"], prune=1e9).agg(F.sum("logp")).first()[0]
        assert m.agg(F.sum("weight")).first()[0] == pytest.approx(1)
        assert before is None or score >= before - 1e-6
        before = score


def test_mmi_moves_towards_the_numerator():
    mean, var = np.array([0.0]), np.array([1.0])
    new, spread = g.mmi_update(mean, var, (10.0, np.array([10.0]), np.array([20.0])), (5.0, np.array([0.0]), np.array([5.0])))
    assert 0 < new[0] < 1 and spread[0] > 0
    assert g.mmi_update(mean, var, (0.0, mean, mean), (1.0, mean, mean))[0] is mean


def test_transitions(spark):
    rows = spark.createDataFrame([("s", 0, 1), ("s", 1, 2), ("s", 2, 1)], "stream_id string, t long, label long")
    uni, bi = g.transitions(rows)
    p = {x.label: x.p for x in uni.collect()}
    q = {(x.prev, x.cur): x.p for x in bi.collect()}
    assert p[1] == pytest.approx(math.log(3 / 5)) and q[(1, 2)] == pytest.approx(math.log(1 / 3))


def test_deltas_double_the_slope(spark):
    f = spark.createDataFrame([("s", t, [float(t)]) for t in range(7)], "stream_id string, t long, vec array<double>")
    assert [x.vec[1] for x in sg.deltas(f).orderBy("t").collect()] == [2.0] * 7


def test_window_features_of_a_tone():
    t = np.arange(512)
    tone = np.round(8000 * np.sin(2 * np.pi * 1000 * t / 16000)).astype(np.int32)
    x = sg.window_features(np.stack([tone, np.zeros(512, np.int32)]), sg.FeatureOptions(zero_crossings=True))
    assert x.shape == (2, 15) and x[0, 13] in (31, 32) and np.allclose(x[1, :13], 0)
    mel = sg.window_features(tone[None], sg.FeatureOptions(only_mel=True))[0]
    assert abs(int(mel.argmax()) - int(np.searchsorted(sg.mel_edges()[1:-1], 1000 / 8000 * 256))) <= 1
    assert (sg.mel_edges(sg.warp_factor(10)) <= sg.mel_edges(sg.warp_factor(0))).all()


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, -1.0, 3.0], [1.0, 2.0, 4.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    x = df.select(vec.one_hot_max(a).alias("hot"), vec.squared_distance(a, b).alias("d"), vec.floor_at(a, 0.0).alias("f"), vec.any_negative(a).alias("n"),
                  vec.product(b).alias("p"), vec.mahalanobis(a, b, b).alias("m"), vec.part(a, 1, 2).alias("s")).first()
    assert x.hot == [3.0, 0.0, 0.0] and x.d == 14.0 and x.f.vec == [3.0, 0.0, 3.0] and x.f.floored and x.n and x.p == 8.0
    assert x.m == pytest.approx(-0.5 * (4 + 4.5 + 0.25)) and x.s == [-1.0, 3.0]


def test_strings(spark):
    df = spark.createDataFrame([("word rest of it \n", "a/b/c.d.wav", "x y (utt-1)")], "l string, p string, r string")
    head, rest = tx.head_and_rest(F.col("l"))
    x = df.select(head, rest, tx.basename(F.col("p")), tx.utterance_label(F.col("r"))).first()
    assert tuple(x) == ("word", "rest of it", "c.d", "utt-1")


def tiny_lm(spark):
    uni = spark.createDataFrame([("a", -1.0, -0.3), ("b", -1.5, -0.2), ("c", -2.0, 0.0)], "w1 string, p double, bo double")
    bi = spark.createDataFrame([("a", "b", -0.5, -0.1)], "w1 string, w2 string, p double, bo double")
    return ng.Ngrams(uni, bi, spark.createDataFrame([], "w1 string, w2 string, w3 string, p double"))


def test_back_off(spark):
    lm = tiny_lm(spark)
    pairs = {(x.w1, x.w2): x.p for x in ng.bigram(spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "zz")], "w1 string, w2 string"), lm).collect()}
    assert pairs[("a", "b")] == -0.5 and pairs[("b", "a")] == pytest.approx(-1.2) and pairs[("a", "zz")] is None
    x = ng.trigram(spark.createDataFrame([("a", "b", "c")], "w1 string, w2 string, w3 string"), lm).first()
    assert x.p == pytest.approx(-2.3) and (x.order, x.h1, x.h2) == (1, None, "c")
    d = {x.w3: x.p for x in ng.next_words(spark.createDataFrame([("a", "b")], "w1 string, w2 string"), lm).collect()}
    assert d["c"] == pytest.approx(-2.3) and len(d) == 3
    assert ng.inconsistent(lm).count() == 0


def test_arpa_and_lexicon_files(spark, tmp_path):
    (tmp_path / "lm").write_text("\\data\\\nngram 1=3\n\n\\1-grams:\n-99 <s> -0.5\n-1.2 b\n-1 c -0.1\n\n\\2-grams:\n-0.4 <s> b\n-0.7 b zz\n\\end\\\n")
    vocab = spark.createDataFrame([("<s>",), ("b",), ("c",)], "word string")
    rows = sorted((x.n, x.w1, x.w2 or "", x.p, x.bo) for x in la.read_arpa(spark, str(tmp_path / "lm"), vocab).collect())
    assert rows == [(1, "<s>", "", -9e30, -0.5), (1, "b", "", -1.2, 0.0), (1, "c", "", -1.0, -0.1), (2, "<s>", "b", -0.4, 0.0)]
    (tmp_path / "d").write_text("ab a b\nc c\nab a p\n")
    lex = sorted((x.word, x.word_id, x.variant, x.phones) for x in la.read_lexicon(spark, str(tmp_path / "d")).collect())
    assert lex == [("ab", 0, 1, ["a", "b"]), ("ab", 0, 2, ["a", "p"]), ("c", 1, 1, ["c"])]
    with pytest.raises(Exception, match="unknown phone p"):
        la.read_lexicon(spark, str(tmp_path / "d"), spark.createDataFrame([("a",), ("b",), ("c",)], "name string")).collect()


def test_headings_hold_for_later_blocks(spark, tmp_path):
    """Files that are read in many blocks, some without a heading."""
    for k in range(2):
        (tmp_path / f"f{k}").write_text("".join(f"## u{k}{u} ##\n" + "".join(f"#Phone# a b c |{i}|1|2|3|4|5|\n" for i in range(40)) for u in range(30)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        rows = la.read_alignment(spark, str(tmp_path))
        assert "wholetext" not in rows._jdf.queryExecution().toString()
        seen = {x.utt: (x.n, x.b) for x in rows.groupBy("utt").agg(F.count("*").alias("n"), F.sum("b1").alias("b")).collect()}
        files = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert files > 10 and seen == {f"u{k}{u}": (40, 780) for k in range(2) for u in range(30)}


def test_lines_of_an_utterance_are_in_one_file(spark, tmp_path):
    """Banners and phone lines are both dealt out by utterance before, and their partitions differ in size."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    try:
        b = (F.col("id") % 50).cast("int")
        rows = spark.range(60_000).select(F.concat(F.lit("u"), F.floor(F.col("id") / 50)).alias("utt"), *[F.lit(x).alias(x) for x in "lmr"], *[b.alias(f"{x}{k}") for k in (1, 2, 3) for x in "be"])
        sm.in_order(la.alignment_lines(rows), "utt", "ord").write.text(str(tmp_path / "a"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    seen = la.read_alignment(spark, str(tmp_path / "a")).groupBy("utt").count().collect()
    assert len(seen) == 1200 and {x["count"] for x in seen} == {50}


def test_a_value_equal_to_the_mean_is_not_above_it(spark):
    """Summed in this order, the mean of these is 44.309999999999995."""
    values = [44.31, 9.27, 79.35, 15.01, 73.61, 13.91, 74.71, 59.16, 29.46, 27.71, 60.91]
    for rows in (values, values[::-1], sorted(values)):
        e = spark.createDataFrame([("s", x) for x in rows], "stream_id string, energy double").coalesce(1)
        assert g.energy_threshold(e, ["stream_id"], 2.0).first().mean == pytest.approx((79.35 + 73.61 + 74.71 + 59.16 + 60.91) / 5, abs=1e-9)


def test_trie_shares_next_phones(spark):
    lex = spark.createDataFrame([(0, ["a", "b"]), (1, ["a", "c"])], "word_id long, phones array<string>")
    assert se.build_trie(lex).select("node").distinct().count() == 4
    assert se.build_trie(lex, share_next=False).select("node").distinct().count() == 3
    p = spark.createDataFrame([(0, -2.0), (1, -1.0)], "word_id long, p double")
    assert {x.prefix: x.bound for x in se.look_ahead(lex, p).collect()} == {"a": -1.0, "a b": -2.0, "a c": -1.0}


def test_pruning(spark):
    tok = spark.createDataFrame([(0, 0, 0, 0, i, ll) for i, ll in enumerate((0.0, -1.5, -2.2, -2.8, -3.5))], "t long, node long, state long, hist long, path_id long, ll double")
    assert sorted(x.ll for x in se.histogram_prune(tok, 100.0, 4).collect()) == [-1.5, 0.0]
    assert sorted(x.ll for x in se.beam(tok, 2.2).collect()) == [-1.5, 0.0]
    sizes = [se.beam(tok, w).count() for w in (0.5, 2.0, 3.0, 9.0)]
    assert sizes == sorted(sizes)
    assert se.recombine(tok).count() == 1 and se.recombine(tok).first().path_id == 0


def test_long_paths_and_circles(spark):
    n = 300
    links = spark.createDataFrame([("u", i, i - 1 if i else None) for i in range(n)], "utt string, path_id long, prev_id long")
    end = lambda k: spark.createDataFrame([("u", k)], "utt string, path_id long")
    back = {x.back: x.path_id for x in se.traceback(links, end(n - 1)).collect()}
    assert back == {k: n - 1 - k for k in range(n)}
    ring = spark.createDataFrame([("u", i, (i + 1) % 3) for i in range(3)], links.schema)
    with pytest.raises(ValueError, match="circle"):
        se.traceback(ring, end(0))
    arcs = ring.select("utt", F.col("path_id").alias("src"), F.col("prev_id").alias("dst"))
    with pytest.raises(ValueError, match="circle"):
        se.count_paths(arcs, end(0).withColumnRenamed("path_id", "node"), end(2).withColumnRenamed("path_id", "node"))


def test_an_utterance_too_short_to_align_has_no_rows(spark):
    rows = [(u, t, p, 0, -1.0) for u, n in (("long", 5), ("short", 1)) for t in range(n) for p in ("x", "y")]
    scores = spark.createDataFrame(rows, "utt string, t long, phone string, state long, logp double")
    said = spark.createDataFrame([("long", ["x", "y"]), ("short", ["x", "y"])], "utt string, phones array<string>")
    assert {x.utt for x in hmm.forced_alignment(scores, said, states=1).repartition(1).collect()} == {"long"}


def test_sounds_are_made_by_all_tasks(spark, tmp_path):
    """A table of one small file, whose sounds are far larger."""
    from quillon.plans import signal_queries as sq

    spark.range(300).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    sound = sq.sound(spark, str(tmp_path))
    assert sound.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sg.per_window(sound, sg.centred).where("size(vec) = 512").count() == 300 * 6


def test_references_are_not_dealt_out_by_document(spark, tmp_path):
    from quillon.plans import search_queries as sq

    spark.createDataFrame([(1, "The cat, the dog"), (2, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    ref, hyp = sq.ref_and_hyp(spark, str(tmp_path))
    assert [(x.ord, x.word, x.hist) for x in ref.orderBy("ord").collect()] == [(0, "the", None), (1, "cat", "the"), (2, "the", "cat"), (3, "dog", "the")]
    assert all("Exchange" not in x._jdf.queryExecution().executedPlan().toString() for x in (ref, hyp))


def test_shared_folder_is_needed_on_a_cluster():
    class Conf(dict):
        def get(self, k, default=None):
            return dict.get(self, k, default)

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

        class sparkContext:  # noqa: N801
            applicationId = "app-1"  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stores.scratch(Session(), "x")
    Session.conf["spark.checkpoint.dir"] = "file:///shared/"
    assert stores.scratch(Session(), "x").startswith("file:///shared/quillon-app-1/x-")


def test_written_tables_are_deleted(spark):
    import pathlib

    t = stores.materialised(spark.range(3), "one")
    path = pathlib.Path(t._quillon_path.removeprefix("file://"))
    assert path.is_dir() and stores.materialised(t.select("id"), "two", t).count() == 3 and not path.exists()


def test_token_operators(spark):
    lex = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, ["a", "c"])], "word_id long, phones array<string>")
    met = {(x.end_phone, x.start_phone): x.pairs for x in se.context_matrix(lex).collect()}
    assert met == {("b", "a"): 4, ("b", "b"): 2, ("c", "a"): 2, ("c", "b"): 1}
    assert [(x.phone, x.words) for x in se.missing_models(lex, spark.createDataFrame([("a",), ("b",)], "phone string")).collect()] == [("c", 1)]
    tok = spark.createDataFrame([("u", 1, 5, 1, -1.0), ("u", 2, 5, 2, -3.0), ("u", 2, 6, 3, -2.0), ("v", 1, 6, 4, -1.0)], "utt string, t long, node long, path_id long, ll double")
    assert sorted((x.utt, x.path_id) for x in se.final_tokens(tok).collect()) == [("u", 3), ("v", 4)]
    allowed = spark.createDataFrame([("u", 5)], "utt string, node long")
    assert [(x.utt, x.path_id) for x in se.final_tokens(tok, allowed).collect()] == [("u", 2)]


def test_lattices_and_errors(spark):
    arcs = spark.createDataFrame([("u", 0, 1, "a", -1.0, -0.1, -1.1), ("u", 1, 2, "b", -1.0, -0.1, -1.1), ("u", 0, 2, "c", -3.0, -0.1, -3.1)], "utt string, src long, dst long, word string, am double, lm double, total double")
    end = lambda n: spark.createDataFrame([("u", n)], "utt string, node long")
    assert sorted(x.words for x in se.paths(arcs, end(0), end(2)).collect()) == [["a", "b"], ["c"]]
    post = {x.word: x.posterior for x in se.arc_posteriors(arcs, end(0), end(2)).collect()}
    assert post["a"] + post["c"] == pytest.approx(1) and post["a"] == pytest.approx(math.exp(-2.2) / (math.exp(-2.2) + math.exp(-3.1)))
    regions = spark.createDataFrame([(1, 0, 1, "AM")], "sub long, del long, ins long, blame string")
    assert se.word_error_rate(regions, spark.createDataFrame([(4,)], "words long")).first().wer == 50.0


def test_viterbi_and_decoding_by_brute_force():
    import itertools

    r = np.random.default_rng(1)
    obs, trans, start = r.normal(size=(5, 3)), r.normal(size=(3, 3)), r.normal(size=3)
    score = lambda p: start[p[0]] + sum(obs[t, s] for t, s in enumerate(p)) + sum(trans[a, b] for a, b in itertools.pairwise(p))
    best = max(itertools.product(range(3), repeat=5), key=score)
    path, ll = hmm.viterbi(obs, trans, start)
    assert tuple(path) == best and ll == pytest.approx(score(best))
    total = np.logaddexp.reduce([score(p) for p in itertools.product(range(3), repeat=5)])
    gamma, _, ll = hmm.forward_backward(obs, trans, start)
    assert ll == pytest.approx(total) and np.allclose(gamma.sum(1), 1)

    def legal(p):
        runs = [len(list(x)) for _, x in itertools.groupby(p)]
        return all(n >= 2 for n in runs[:-1])

    obs = r.normal(size=(7, 3)) * 2
    value = lambda p: sum(obs[t, s] for t, s in enumerate(p)) - sum(a != b for a, b in itertools.pairwise(p))
    want = max((p for p in itertools.product(range(3), repeat=7) if legal(p)), key=value)
    assert value(tuple(hmm.segment_decode(obs, 2, -1.0))) == pytest.approx(value(want))


def test_mllr_recovers_a_shift():
    r = np.random.default_rng(0)
    means, var = r.normal(size=(30, 3)), np.ones((30, 3))
    w = np.full(30, 50.0)
    m = hmm.mllr_mean_transform(means, var, w, (means + 1.0) * w[:, None], weight=1e-6)
    assert np.allclose(m[:, 0], 1, atol=1e-3) and np.allclose(m[:, 1:], np.eye(3), atol=1e-3)


def test_clustering_merges_like_with_like(spark):
    r = np.random.default_rng(0)
    rows = [(k, [float(x) for x in r.normal((k % 2) * 6, 1, 2)]) for k in range(4) for _ in range(60)]
    f = spark.createDataFrame(rows, "label long, vec array<double>")
    out, merges = cl.cluster(f, penalty=20.0)
    assert {frozenset((a % 2, b % 2)) for a, b, _ in merges} == {frozenset((0,)), frozenset((1,))}
    assert sorted(x.label for x in out.select("label").distinct().collect()) == [0, 1]
    assert cl.initial_clusters(1000, 10, 5, 2, 16) == 17 and cl.initial_clusters(0, 10, 5, 2, 16) == 3


def test_context_tree_finds_the_question(spark):
    rows = [(left, 0, [float(left % 2) * 5 + (i % 7) * 0.1]) for left in range(4) for i in range(100)]
    acc = g.accumulate(spark.createDataFrame(rows, "left long, right long, vec array<double>"), ["left", "right"])
    leaves = cl.context_tree(acc, {"odd": [1, 3], "low": [0, 1]}, min_count=50)
    assert sorted(x["path"] for x in leaves) == [[("left", "odd", False)], [("left", "odd", True)]]


def test_options(tmp_path, monkeypatch):
    (tmp_path / "c").write_text("beam 100\nlm_scale 20 # scale\n")
    (tmp_path / "e").write_text('{"beam": 50, "state_beam": 10}')
    monkeypatch.setenv(config.ENV, str(tmp_path / "e"))
    o = config.load(["-c", str(tmp_path / "c"), "--lm-scale", "25", "--compat"])
    assert (o.beam, o.lm_scale, o.state_beam, o.compat) == (100.0, 25.0, 10.0, True)
    with pytest.raises(KeyError):
        config.load(["--nothing", "1"])


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_recognition_by_brute_force(seed):
    import itertools

    from quillon.operators.recognise import Bigram, Lexicon, Search, decode

    r = np.random.default_rng(seed)
    lex = [("ab", ("a", "b")), ("a", ("a",)), ("ba", ("b", "a")), ("aa", ("a", "a"))]
    lm = Bigram({w: (-0.3 * (i + 1), -0.2) for i, (w, _) in enumerate(lex)}, {("ab", "a"): -0.1, ("a", "ba"): -0.2})
    o = Search(states=1, lm_scale=2.0, word_penalty=0.1, beam=1e9, state_beam=1e9, end_beam=1e9)
    obs = {(t, p): float(r.normal() * 3) for t in range(6) for p in "ab"}
    words = decode(lambda t, p, s: obs[t, p], 6, Lexicon(lex), lm, o)

    def score(ws):
        chain = [p for w in ws for p in dict(lex)[w]]
        if len(chain) > 6:
            return -np.inf
        ends = np.cumsum([len(dict(lex)[w]) for w in ws])
        text = sum(2.0 * lm(b, w) - 0.1 for b, w in itertools.pairwise(["<s>", *ws]))
        best = -np.inf
        for cuts in itertools.combinations(range(1, 6), len(chain) - 1):
            edges = [0, *cuts, 6]
            total = text + len(ws) * o.log_next
            for k, p in enumerate(chain):
                total += sum(obs[t, p] for t in range(edges[k], edges[k + 1])) + (edges[k + 1] - edges[k] - 1) * o.log_self
                total += o.log_next * (k > 0 and k not in ends)
            best = max(best, total)
        return best

    every = [ws for n in range(1, 7) for ws in itertools.product(dict(lex), repeat=n)]
    want = max(every, key=score)
    assert [w for w, *_ in words] == list(want)
    assert sum(am + lms for *_, am, lms in words) == pytest.approx(score(want))
    assert [b + 1 for _, _, b, _, _ in words[:-1]] == [a for _, a, _, _, _ in words[1:]]
