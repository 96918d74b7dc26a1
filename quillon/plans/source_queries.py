"""Queries that write files of each format and read them back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config
from ..operators import gaussians as g
from ..sources import language as la
from ..sources import segments as se
from ..sources import stores
from ..sources import vectors as ve
from . import views as v
from ..operators.search import build_trie
from .gaussian_queries import OWN, label_models
from .language_queries import LM, PRE, lexicon, texts
from .registry import Registry
from .search_queries import ARC, lattice

REGISTRY = Registry()
query = REGISTRY.query


@query("src4_segments_round_trip", v.with_views("SELECT stream_id::VARCHAR AS stream_id, first, last - 1 AS last, label FROM segments_user", "segments_user"))
def _(spark, d):
    path = stores.scratch(spark, "segments")
    se.write_segments(v.segments_user(spark, d), path, "SPK")
    return se.read_segments(spark, path, prefix_len=3, check=False).select("stream_id", "first", "last", "label")


@query("snk1_segment_lines", v.with_views("""SELECT printf('SPEAKER %d 0 %.3f %.3f <NA> <NA> SPK%02d <NA>', stream_id, first / 100.0, (last - first + 1) / 100.0, label) AS value FROM segments_user
UNION ALL SELECT DISTINCT printf('SPKR-INFO %d 1 <NA> <NA> <NA> unknown SPK%02d <NA>', stream_id, label) FROM segments_user""", "segments_user"))
def _(spark, d):
    return se.segment_lines(v.segments_user(spark, d)).select("value")


@query("src5_regions", v.with_views("SELECT stream_id::VARCHAR AS stream_id, 1 AS channel, first, last FROM regions", "regions"))
def _(spark, d):
    path = stores.scratch(spark, "regions")
    v.regions(spark, d).select(F.format_string("%d 1 %.2f %.2f", "stream_id", F.col("first") / 100.0, (F.col("last") + 1) / 100.0)).write.text(path)
    return se.read_regions(spark, path, channel=1)


@query("snk12_frame_labels", v.with_views("SELECT t, label FROM frames", "frames"))
def _(spark, d):
    path = stores.scratch(spark, "labels")
    se.write_frame_labels(v.frames(spark, d), path)
    return se.read_frame_labels(spark, path)


@query("src2_vector_round_trip", v.with_views("SELECT t, (round(sum(x), 4) + 0.0) AS total, count(*) AS dims FROM dims GROUP BY t", "dims"))
def _(spark, d):
    body = ve.encode_vectors(v.frames(spark, d).select(F.lit("all").alias("stream_id"), "t", "vec"))
    path = stores.scratch(spark, "vectors")
    body.write.parquet(path)
    # The file bodies stand in a table, as Spark has no binary writer; read_vectors decodes the same bytes from files.
    rows = spark.read.parquet(path)

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for c in pdf["content"]:
                dim = int(np.frombuffer(c, "<i4", 1)[0])
                x = np.frombuffer(c, "<f4", offset=4).astype(float).reshape(-1, dim)
                yield pd.DataFrame({"t": np.arange(len(x)), "total": x.sum(1), "dims": dim})

    return rows.mapInPandas(run, "t long, total double, dims long").withColumn("total", F.round("total", 4))


@query("src3_text_vectors", v.with_views("SELECT t, d, (round(round(x, 5), 5) + 0.0) AS x FROM dims", "dims"))
def _(spark, d):
    path = stores.scratch(spark, "text-vectors")
    line = F.array_join(F.transform("vec", lambda x: F.format_string("%.5f", x)), " ")
    v.frames(spark, d).orderBy("t").coalesce(1).select(line).write.text(path)
    rows = ve.read_text_vectors(spark, path)
    return rows.select("t", F.posexplode("vec").alias("d", "x")).select("t", F.col("d").cast("long"), F.round("x", 5).alias("x"))


@query("snk9_posterior_lines", v.with_views("SELECT string_agg(printf('%.6f', p / total), ' ' ORDER BY model_id) AS value FROM (SELECT *, sum(p) OVER (PARTITION BY t) AS total FROM (SELECT t, model_id, exp((logp - max(logp) OVER (PARTITION BY t)) / 30) AS p FROM own)) GROUP BY t", "gmm", **OWN))
def _(spark, d):
    path = stores.scratch(spark, "posteriors")
    s = g.mixture_scores(v.frames(spark, d), label_models(spark, d), ["t"])
    ve.write_posteriors(g.posterior_matrix(s, ["t"]), path, list(range(10)))
    return spark.read.text(path)


def _arpa(spark, d):
    m = texts(spark, d).model
    none = F.lit(None).cast("string")
    return (m.uni.select(F.lit(1).alias("n"), "w1", none.alias("w2"), none.alias("w3"), "p", "bo")
            .unionByName(m.bi.select(F.lit(2).alias("n"), "w1", "w2", none.alias("w3"), "p", "bo"))
            .unionByName(m.tri.select(F.lit(3).alias("n"), "w1", "w2", "w3", "p", F.lit(0.0).alias("bo"))))


@query("src6_arpa_round_trip", v.with_views("SELECT 1 AS n, count(*) AS rows, round(sum(round(p, 6)), 1) + 0.0 AS total, round(sum(bo), 1) + 0.0 AS backoff FROM u UNION ALL SELECT 2, count(*), round(sum(round(p, 6)), 1) + 0.0, round(sum(bo), 1) + 0.0 FROM b UNION ALL SELECT 3, count(*), round(sum(round(p, 6)), 1) + 0.0, 0.0 FROM t", "words", **LM))
def _(spark, d):
    path = stores.scratch(spark, "arpa")
    la.write_arpa(_arpa(spark, d), path)
    return la.read_arpa(spark, path).groupBy("n").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("p"), 1).alias("total"), F.round(F.sum("bo"), 1).alias("backoff"))


@query("src7_lexicon_round_trip", v.with_views("SELECT word, 1 AS variant, len(word) AS phones FROM (SELECT DISTINCT word FROM words)", "words"))
def _(spark, d):
    path = stores.scratch(spark, "lexicon")
    lexicon(spark, d).orderBy("word_id").coalesce(1).select(F.concat_ws(" ", "word_id", F.array_join("phones", " "))).write.text(path)
    return la.read_lexicon(spark, path).select("word", "variant", F.size("phones").cast("long").alias("phones"))


@query("src8_phone_list", "SELECT r_regionkey::INT AS phone_id, left(r_name, 9) AS name, r_regionkey < 2 AS is_sil FROM region")
def _(spark, d):
    path = stores.scratch(spark, "phones")
    names = [r.r_name for r in v.table(spark, d, "region").orderBy("r_regionkey").collect()]
    spark.createDataFrame([("\n".join(["Number of phones: 5", "Number of SIL's: 2", *names]),)], "value string").coalesce(1).write.text(path)
    return la.read_phones(spark, path)


ALIGNED = "SELECT l_orderkey::VARCHAR AS utt, l_returnflag AS l, l_linestatus AS m, l_returnflag AS r, l_linenumber * 10 AS b1 FROM lineitem"


@query("src9_alignment_round_trip", "SELECT utt, l, m, r, count(*) AS n, sum(b1)::BIGINT AS b1, sum(b1 + 2)::BIGINT AS e3 FROM (" + ALIGNED + ") GROUP BY 1, 2, 3, 4")
def _(spark, d):
    li = v.table(spark, d, "lineitem")
    b = F.col("l_linenumber") * 10
    rows = li.select(F.col("l_orderkey").cast("string").alias("utt"), F.col("l_returnflag").alias("l"), F.col("l_linestatus").alias("m"), F.col("l_returnflag").alias("r"), b.alias("b1"), b.alias("e1"),
                     (b + 1).alias("b2"), (b + 1).alias("e2"), (b + 2).alias("b3"), (b + 2).alias("e3"))
    path = stores.scratch(spark, "alignment")
    se.in_order(la.alignment_lines(rows), "utt", "ord").write.text(path)
    return la.read_alignment(spark, path).groupBy("utt", "l", "m", "r").agg(F.count(F.lit(1)).alias("n"), F.sum("b1").alias("b1"), F.sum("e3").alias("e3"))


@query("src10_model_store", v.with_views("SELECT label AS model_id, d, round(mean, 6) + 0.0 AS mean, round(var, 6) + 0.0 AS var FROM gmm", "gmm"))
def _(spark, d):
    m = stores.round_trip(label_models(spark, d)).select("model_id", F.posexplode(F.arrays_zip("mean", "var")).alias("d", "p"))
    return m.select("model_id", F.col("d").cast("long"), F.round("p.mean", 6).alias("mean"), F.round("p.var", 6).alias("var"))


@query("snk10_tree_writer", v.with_views("SELECT n::INT AS depth, nxt AS following, right(prefix, 1) AS phone, count(*) AS nodes FROM (SELECT DISTINCT n, prefix, nxt, CASE WHEN n = len(word) THEN word END AS w FROM pre) GROUP BY 1, 2, 3", "words", **PRE))
def _(spark, d):
    nodes = build_trie(lexicon(spark, d)).select(F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), "phone", "depth", "word_id", "next")
    return stores.round_trip(nodes, "trie").groupBy("depth", F.col("next").alias("following"), "phone").agg(F.count(F.lit(1)).alias("nodes"))


@query("src11_ngram_store", v.with_views("SELECT n, count(*) AS rows, count(DISTINCT w1) AS firsts, round(sum(p), 2) + 0.0 AS total FROM (SELECT 1 AS n, w1, p FROM u UNION ALL SELECT 2, w1, p FROM b UNION ALL SELECT 3, w1, p FROM t) GROUP BY n", "words", **LM))
def _(spark, d):
    return stores.round_trip(_arpa(spark, d), "ngram").groupBy("n").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("w1").alias("firsts"), F.round(F.sum("p"), 2).alias("total"))


@query("src12_lattice_round_trip", v.with_views("SELECT utt::VARCHAR AS utt, src, dst, word, round(am, 4) + 0.0 AS am, round(lm, 4) + 0.0 AS lm, a AS first, z AS last FROM arcs JOIN ends USING (utt)", **ARC).replace("WITH", "WITH RECURSIVE", 1))
def _(spark, d):
    arcs, first, last = lattice(spark, d)
    ends = first.withColumnRenamed("node", "first").join(last.withColumnRenamed("node", "last"), "utt")
    path = stores.scratch(spark, "lattices")
    se.in_order(la.lattice_lines(arcs, ends), "utt", "sec", "a", "b").write.text(path)
    back, limits = la.read_lattices(spark, path)
    return back.join(limits, "utt").select("utt", "src", "dst", "word", F.round("am", 4).alias("am"), F.round("lm", 4).alias("lm"), "first", "last")


@query("snk5_lattice_lines", v.with_views("SELECT utt, printf('%d %d %s %.6f %.6f', src, dst, word, am, lm) AS value FROM arcs UNION ALL SELECT utt, unnest(['name ' || utt, 'nodes ' || (n + 1), 'initial ' || a, 'final ' || z, 'transitions']) FROM ends JOIN (SELECT utt, count(DISTINCT dst) AS n FROM arcs GROUP BY utt) USING (utt)", **ARC).replace("WITH", "WITH RECURSIVE", 1))
def _(spark, d):
    arcs, first, last = lattice(spark, d)
    return la.lattice_lines(arcs, first.withColumnRenamed("node", "first").join(last.withColumnRenamed("node", "last"), "utt")).select("utt", "value")


@query("snk4_alignment_lines", "SELECT l_orderkey AS utt, printf('#Phone# %s %s %s |%d|%d|%d|%d|%d|%d|', l_returnflag, l_linestatus, l_returnflag, l_linenumber, l_linenumber, l_linenumber + 1, l_linenumber + 1, l_linenumber + 2, l_linenumber + 2) AS value FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, printf('## %d ##', l_orderkey) FROM lineitem")
def _(spark, d):
    b = F.col("l_linenumber")
    rows = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("utt"), F.col("l_returnflag").alias("l"), F.col("l_linestatus").alias("m"), F.col("l_returnflag").alias("r"),
                                                b.alias("b1"), b.alias("e1"), (b + 1).alias("b2"), (b + 1).alias("e2"), (b + 2).alias("b3"), (b + 2).alias("e3"))
    return la.alignment_lines(rows).select("utt", "value")


@query("src13_trial_list", "SELECT c_custkey::VARCHAR AS spk, 'f' AS gender, n_name AS audio_label, '1' AS channel, 'a' AS audio, 's' AS segments FROM customer JOIN (SELECT n_nationkey, replace(n_name, ' ', '_') AS n_name FROM nation) ON c_nationkey = n_nationkey")
def _(spark, d):
    path = stores.scratch(spark, "trials")
    n = v.table(spark, d, "nation").select("n_nationkey", F.replace("n_name", F.lit(" "), F.lit("_")).alias("n_name"))
    v.table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.format_string("%d f %s 1 a s", "c_custkey", "n_name")).write.text(path)
    return la.read_trials(spark, path)


@query("src14_file_list", "SELECT url AS audio, page_id::VARCHAR AS meta, NULL::VARCHAR AS hyp FROM pages")
def _(spark, d):
    path = stores.scratch(spark, "files")
    v.table(spark, d, "pages").select(F.concat_ws(" ", "url", F.col("page_id").cast("string"))).write.text(path)
    return la.read_file_list(spark, path)


@query("src15_options", "SELECT 150::DOUBLE AS beam, true AS compat, true AS has_template")
def _(spark, d):
    o = config.load(["--beam", "150", "--compat"])
    return spark.createDataFrame([(o.beam, o.compat, len(config.template()) > 0)], "beam double, compat boolean, has_template boolean")


@query("snk3_hypothesis_lines", "SELECT printf('%s %.2f %.2f %.4f %.4f %.4f', translate(word, '<>', '[]'), b / 100.0, (b + 4) / 100.0, -1.5, -0.25, -1.75) AS value FROM (SELECT role || '<' || turn AS word, conv_id * 10 AS b FROM conversations)")
def _(spark, d):
    c = v.table(spark, d, "conversations")
    b = F.col("conv_id") * 10
    rows = c.select(F.col("conv_id").alias("utt"), F.col("turn").alias("ord"), F.concat("role", F.lit("<"), "turn").alias("word"), b.alias("first"), (b + 3).alias("last"), F.lit(-1.5).alias("am"), F.lit(-0.25).alias("lm"))
    return la.hypothesis_lines(rows).select("value")


@query("snk7_accumulator_store", v.with_views("SELECT label, d, count(*) AS n, (round(sum(x), 5) + 0.0) AS sx FROM dims GROUP BY 1, 2", "dims"))
def _(spark, d):
    acc = stores.round_trip(g.accumulate(v.frames(spark, d), ["label"]), "accumulators")
    return acc.select("label", F.col("d").cast("long"), "n", F.round("sx", 5).alias("sx"))


@query("set8_model_choice", v.with_views("SELECT label AS model_id, CASE WHEN label % 3 = 0 THEN 'b' ELSE 'a' END AS origin FROM gmm GROUP BY label", "gmm"))
def _(spark, d):
    m = label_models(spark, d).select("model_id")
    both = m.withColumn("origin", F.lit("a")).unionByName(m.withColumn("origin", F.lit("b")))
    choice = m.withColumn("origin", F.when(F.col("model_id") % 3 == 0, "b").otherwise("a"))
    return both.join(choice, ["model_id", "origin"])


@query("set10_combine_models", v.with_views("SELECT label AS model_id, row_number() OVER (ORDER BY label) AS position FROM gmm GROUP BY label", "gmm"))
def _(spark, d):
    m = label_models(spark, d).select("model_id")
    parts = m.where("model_id < 5").unionByName(m.where("model_id >= 5"))
    return parts.withColumn("position", F.row_number().over(Window.orderBy("model_id")))
