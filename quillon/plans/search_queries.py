"""Queries of pruning, tracebacks, lattices, N-best lists and errors, over views of orders, line items and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import search as se
from ..sources.numbering import dense_index
from . import views as v
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

TOKENS = {"tok": "SELECT l_suppkey AS t, l_partkey % 20 AS node, l_linenumber::BIGINT AS state, (l_quantity::BIGINT) % 5 AS hist, l_orderkey * 8 + l_linenumber AS path_id, -l_extendedprice / 500 AS ll FROM lineitem"}
COLS = "t, node, state, hist, path_id, (round(ll, 5) + 0.0) AS ll"


def tokens(spark, d):
    """Search tokens: a supplier is a frame, a part its node, an order line its path."""
    return v.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("t"), (F.col("l_partkey") % 20).alias("node"), F.col("l_linenumber").cast("long").alias("state"),
        (F.col("l_quantity").cast("long") % 5).alias("hist"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("path_id"), (-F.col("l_extendedprice") / 500).alias("ll"))


def _out(rows):
    return rows.select("t", "node", "state", "hist", "path_id", F.round("ll", 5).alias("ll"))


@query("topk1_beam", v.with_views(f"SELECT {COLS} FROM (SELECT *, max(ll) OVER (PARTITION BY t) AS best FROM tok) WHERE ll > best - 60", **TOKENS))
def _(spark, d):
    return _out(se.beam(tokens(spark, d), 60.0))


@query("topk2_state_beam", v.with_views(f"SELECT {COLS} FROM (SELECT *, max(ll) OVER (PARTITION BY t) AS best, max(ll) OVER (PARTITION BY t, node, state) AS own FROM tok) WHERE ll > greatest(best - 90, own - 20)", **TOKENS))
def _(spark, d):
    return _out(se.state_beam(tokens(spark, d), 90.0, 20.0))


@query("topk3_histogram_prune", v.with_views(f"""SELECT {COLS} FROM bins JOIN (SELECT t, coalesce(min(CASE WHEN run >= 120 THEN bin END), 100) AS cut FROM (SELECT t, bin, sum(n) OVER (PARTITION BY t ORDER BY bin) AS run FROM (SELECT t, bin, count(*) AS n FROM bins GROUP BY 1, 2)) GROUP BY t) USING (t) WHERE ll > best - cut * 1.28""",
    **TOKENS, bins="SELECT *, least(floor((best - ll) / 1.28), 100) AS bin FROM (SELECT *, max(ll) OVER (PARTITION BY t) AS best FROM tok)"))
def _(spark, d):
    return _out(se.histogram_prune(tokens(spark, d), 128.0, 120))


@query("topk4_word_end_beam", v.with_views(f"SELECT {COLS} FROM (SELECT *, max(ll) OVER (PARTITION BY t, hist = 0) AS best FROM tok) WHERE hist <> 0 OR ll > best - 25", **TOKENS))
def _(spark, d):
    return _out(se.word_end_beam(tokens(spark, d).withColumn("word_end", F.col("hist") == 0), 25.0))


@query("topk5_state_cap", v.with_views(f"SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY t, node, state ORDER BY ll DESC, path_id) AS r FROM tok) WHERE r <= 3", **TOKENS))
def _(spark, d):
    return _out(se.state_cap(tokens(spark, d), 3))


@query("topk6_recombine", v.with_views(f"SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY t, node, state, hist ORDER BY ll DESC, path_id) AS r FROM tok) WHERE r = 1", **TOKENS))
def _(spark, d):
    return _out(se.recombine(tokens(spark, d)))


@query("topk7_best_word_ends", v.with_views("SELECT t, word, (round(ll, 5) + 0.0) AS ll, rank FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY ll DESC, word) AS rank FROM (SELECT t, node AS word, max(ll) AS ll FROM tok GROUP BY 1, 2)) WHERE rank <= 9", **TOKENS))
def _(spark, d):
    return se.best_word_ends(tokens(spark, d).withColumnRenamed("node", "word"), 9).withColumn("ll", F.round("ll", 5))


@query("snk8_token_distribution", v.with_views("SELECT t, state AS depth, count(*) AS tokens FROM tok GROUP BY 1, 2", **TOKENS))
def _(spark, d):
    return se.depth_distribution(tokens(spark, d).withColumnRenamed("state", "depth"))


@query("sort1_word_ids", v.with_views("SELECT word, row_number() OVER (ORDER BY n DESC, word) AS word_id FROM (SELECT word, count(*) AS n FROM words GROUP BY word HAVING count(*) >= 5)", "words"))
def _(spark, d):
    w = v.words(spark, d).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    return dense_index(w, [F.desc("n"), F.col("word")], "word_id").select("word", (F.col("word_id") + 1).alias("word_id"))


LINKS = {"links": "SELECT o_custkey AS utt, o_orderkey AS path_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_id FROM orders"}


@query("dec8_traceback", ("SELECT utt, (row_number() OVER (PARTITION BY utt ORDER BY o_orderdate DESC, o_orderkey DESC) - 1)::INT AS back, o_orderkey AS path_id FROM (SELECT o_custkey AS utt, * FROM orders)"))
def _(spark, d):
    o = v.table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    links = o.select(F.col("o_custkey").alias("utt"), F.col("o_orderkey").alias("path_id"), F.lag("o_orderkey").over(w).alias("prev_id"), F.col("o_orderdate"))
    ends = links.groupBy("utt").agg(F.max_by("path_id", F.struct("o_orderdate", "path_id")).alias("path_id"))
    return se.traceback(links.select("utt", "path_id", "prev_id"), ends)


REFERENCE = {"ref": "SELECT o_custkey AS utt, (row_number() OVER w - 1)::INT AS ord, o_orderpriority AS word, lag(o_orderpriority) OVER w AS hist, -o_totalprice / 1000 AS am, -(o_orderkey % 9)::DOUBLE AS lm FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"}


def _reference(spark, d):
    """Each customer's orders as a path of words."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    links = v.table(spark, d, "orders").select(F.col("o_custkey").alias("utt"), F.col("o_orderkey").alias("path_id"), F.lag("o_orderkey").over(w).alias("prev_id"), F.lead("o_orderkey").over(w).alias("next_id"),
                                              F.col("o_orderpriority").alias("word"), F.row_number().over(w).alias("end"), (-F.col("o_totalprice") / 1000).alias("am"), (-(F.col("o_orderkey") % 9)).cast("double").alias("lm"))
    return se.reference_path(links.drop("next_id"), links.where("next_id is null").select("utt", "path_id"))


@query("dec18_reference_path", v.with_views("SELECT utt, ord, word, hist, (round(am, 6) + 0.0) AS am, lm FROM ref", **REFERENCE))
def _(spark, d):
    return _reference(spark, d)[0].select("utt", "ord", "word", "hist", F.round("am", 6).alias("am"), "lm")


@query("dec18_reference_totals", v.with_views("SELECT utt, count(*) AS words, (round(sum(am), 6) + 0.0) AS am, sum(lm) AS lm FROM ref GROUP BY utt", **REFERENCE))
def _(spark, d):
    return _reference(spark, d)[1].withColumn("am", F.round("am", 6))


EXIT = {**TOKENS, "kids": "SELECT node, unnest([2 * node + 1, 2 * node + 2]) AS child FROM (SELECT unnest(range(0, 20)) AS node)",
        "uni": "SELECT unnest(range(0, 40)) AS word, -0.05 * unnest(range(0, 40)) AS p, -0.1 * unnest(range(0, 40)) AS bo",
        "pair": "SELECT hist, word, -(hist + 1) * (word % 3 + 1) / 10.0 AS p FROM (SELECT unnest(range(0, 5)) AS hist), (SELECT unnest(range(10, 20)) AS word) WHERE (hist + word) % 2 = 0"}


@query("dec17_phone_exit", v.with_views("SELECT t, child AS node, 0::BIGINT AS state, hist, path_id, (round(ll - 1.7, 5) + 0.0) AS ll FROM tok JOIN kids USING (node) WHERE state = 3", **EXIT))
def _(spark, d):
    kids = spark.range(20).select(F.col("id").alias("node"), F.explode(F.array(2 * F.col("id") + 1, 2 * F.col("id") + 2)).alias("child"))
    return _out(se.phone_exits(tokens(spark, d), F.broadcast(kids), 3, -1.7))


@query("dec5_word_exit", v.with_views("SELECT t, path_id, tok.hist, w.word, (round(coalesce(pair.p, h.bo + w.p), 5) + 0.0) AS lm, (round(ll - 1.7 + 27.5 * coalesce(pair.p, h.bo + w.p) - 2, 4) + 0.0) AS ll FROM tok JOIN uni w ON w.word = tok.node AND node >= 10 LEFT JOIN pair ON pair.hist = tok.hist AND pair.word = w.word JOIN uni h ON h.word = tok.hist WHERE state = 3", **EXIT))
def _(spark, d):
    ids = spark.range(40).select(F.col("id").alias("word"), (-0.05 * F.col("id")).alias("p"), (-0.1 * F.col("id")).alias("bo"))
    pairs = spark.range(5).select(F.col("id").alias("hist")).join(spark.range(10, 20).select(F.col("id").alias("word"))).where("(hist + word) % 2 = 0").withColumn("p", -(F.col("hist") + 1) * (F.col("word") % 3 + 1) / 10.0)
    words = spark.range(10, 20).select(F.col("id").alias("node"), F.col("id").alias("word"))
    out = se.word_exits(tokens(spark, d), F.broadcast(words), F.broadcast(pairs), F.broadcast(ids), 3, -1.7, 27.5, 2.0)
    return out.select("t", "path_id", "hist", "word", F.round("lm", 5).alias("lm"), F.round("ll", 4).alias("ll"))


def _line_tokens(spark, d):
    """An order is an utterance, its lines are frames that hold a token on each of two nodes."""
    li = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("utt"), F.col("l_linenumber").cast("long").alias("t"), F.col("l_partkey").alias("path_id"), (-F.col("l_extendedprice") / 500).alias("ll"), "l_discount")
    other = li.select("utt", "t", (F.col("path_id") + 1_000_000).alias("path_id"), (F.col("ll") - F.col("l_discount") + 0.04).alias("ll"))
    return li.drop("l_discount").unionByName(other).withColumn("node", F.col("path_id") % 5)


FINAL = {"tk": "SELECT *, path_id % 5 AS node FROM (SELECT l_orderkey AS utt, l_linenumber::BIGINT AS t, l_partkey AS path_id, -l_extendedprice / 500 AS ll FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber::BIGINT, l_partkey + 1000000, -l_extendedprice / 500 - l_discount + 0.04 FROM lineitem)",
         "ends": "SELECT tk.* FROM tk JOIN (SELECT utt, max(t) AS t FROM tk GROUP BY utt) USING (utt, t)"}


@query("dec19_final_token", v.with_views("SELECT utt, t, node, path_id, (round(ll, 4) + 0.0) AS ll FROM (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY ll DESC, path_id) AS k FROM ends WHERE node <> utt % 5) WHERE k = 1", **FINAL))
def _(spark, d):
    tk = _line_tokens(spark, d)
    allowed = tk.select("utt", "node").where("node <> utt % 5")
    return se.final_tokens(tk, allowed).withColumn("ll", F.round("ll", 4))


ARC = {
    "line": "SELECT l_orderkey AS utt, l_linenumber::BIGINT AS n, min(l_partkey % 97) AS part, -min(l_quantity) AS am, -min(l_discount) AS lm FROM lineitem GROUP BY 1, 2",
    "arcs": "SELECT a.utt, a.n AS src, b.n AS dst, 'w' || b.part AS word, b.am * (b.n - a.n) AS am, b.lm AS lm, b.am * (b.n - a.n) / 27.5 + b.lm AS total FROM line a JOIN line b ON a.utt = b.utt AND b.n - a.n BETWEEN 1 AND 2",
    "ends": "SELECT utt, min(n) AS a, max(n) AS z FROM line GROUP BY utt",
    "paths": "SELECT utt, a AS node, [] :: VARCHAR[] AS words, 0.0::DOUBLE AS am, 0.0::DOUBLE AS lm FROM ends UNION ALL SELECT p.utt, dst, list_append(words, word), p.am + arcs.am, p.lm + arcs.lm FROM paths p JOIN arcs ON p.utt = arcs.utt AND p.node = src",
    "full_paths": "SELECT paths.* FROM paths JOIN ends ON paths.utt = ends.utt AND node = z AND len(words) > 0",
}


def lattice(spark, d):
    """Lattices of the orders: lines are nodes, arcs lead one or two lines on."""
    line = v.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("utt"), F.col("l_linenumber").cast("long").alias("n")).agg(
        F.min(F.col("l_partkey") % 97).alias("part"), (-F.min("l_quantity")).alias("am"), (-F.min("l_discount")).alias("lm"))
    b = line.select("utt", F.col("n").alias("dst"), "part", "am", "lm")
    arcs = line.select("utt", F.explode(F.array(F.struct(F.col("n").alias("src"), (F.col("n") + 1).alias("dst")), F.struct(F.col("n").alias("src"), (F.col("n") + 2).alias("dst")))).alias("x")).select("utt", "x.*")
    arcs = arcs.join(b, ["utt", "dst"]).select("utt", F.col("src").alias("prev_id"), F.col("dst").alias("path_id"), F.concat(F.lit("w"), "part").alias("word"),
                                              (F.col("am") * (F.col("dst") - F.col("src"))).alias("am"), "lm")
    ends = line.groupBy("utt").agg(F.min("n").alias("a"), F.max("n").alias("z"))
    return se.lattice_arcs(arcs), ends.select("utt", F.col("a").alias("node")), ends.select("utt", F.col("z").alias("node"))


@query("dec10_lattice_arcs", v.with_views("SELECT utt, src, dst, word, (round(total, 5) + 0.0) AS total FROM arcs", **ARC).replace("WITH", "WITH RECURSIVE", 1))
def _(spark, d):
    return lattice(spark, d)[0].select("utt", "src", "dst", "word", F.round("total", 5).alias("total"))


@query("dec19_lattice_contexts", v.with_views("SELECT arcs.utt, arcs.src, coalesce(p.word, '<s>') AS before, arcs.dst, arcs.word, (round(arcs.am, 5) + 0.0) AS am FROM arcs LEFT JOIN (SELECT DISTINCT utt, dst, word FROM arcs) p ON p.utt = arcs.utt AND p.dst = arcs.src JOIN ends ON ends.utt = arcs.utt WHERE p.word IS NOT NULL OR arcs.src = ends.a", **ARC).replace("WITH", "WITH RECURSIVE", 1))
def _(spark, d):
    arcs, first, _ = lattice(spark, d)
    return se.lattice_contexts(arcs, first).select("utt", "src", "before", "dst", "word", F.round("am", 5).alias("am"))


@query("dec11_dedup_arcs", "SELECT utt, src, dst, word, (round(max(total), 5) + 0.0) AS total FROM (SELECT l_orderkey AS utt, l_linenumber::BIGINT AS src, l_linenumber::BIGINT + 1 AS dst, l_returnflag AS word, -l_quantity / 27.5 - l_tax AS total FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber::BIGINT, l_linenumber::BIGINT + 1, l_returnflag, -l_discount * 40 / 27.5 - l_tax FROM lineitem) GROUP BY 1, 2, 3, 4")
def _(spark, d):
    li = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("utt"), F.col("l_linenumber").cast("long").alias("prev_id"), (F.col("l_linenumber").cast("long") + 1).alias("path_id"),
                                             F.col("l_returnflag").alias("word"), "l_quantity", "l_discount", (-F.col("l_tax")).alias("lm"))
    arcs = se.lattice_arcs(li.withColumn("am", -F.col("l_quantity"))).unionByName(se.lattice_arcs(li.withColumn("am", -F.col("l_discount") * 40)))
    return se.dedup_arcs(arcs).select("utt", "src", "dst", "word", F.round("total", 5).alias("total"))


@query("sort2_arc_order", v.with_views("SELECT utt, src, dst, row_number() OVER (PARTITION BY utt, src ORDER BY total DESC, dst, word) AS rank FROM arcs", **ARC).replace("WITH", "WITH RECURSIVE", 1))
def _(spark, d):
    return se.sorted_arcs(lattice(spark, d)[0]).select("utt", "src", "dst", "rank")


@query("dec12_path_count", v.with_views("SELECT utt, count(*) AS paths FROM full_paths GROUP BY utt", **ARC).replace("WITH", "WITH RECURSIVE", 1))
def _(spark, d):
    return se.count_paths(*lattice(spark, d))


@query("dec12_enumerate_paths", v.with_views("SELECT utt, array_to_string(words, ' ') AS words, (round(am, 4) + 0.0) AS am, (round(lm, 4) + 0.0) AS lm FROM full_paths", **ARC).replace("WITH", "WITH RECURSIVE", 1))
def _(spark, d):
    return se.paths(*lattice(spark, d)).select("utt", F.array_join("words", " ").alias("words"), F.round("am", 4).alias("am"), F.round("lm", 4).alias("lm"))


@query("dec12_rescore_grid", v.with_views("SELECT scale, count(*) AS lattices, (round(sum(total) + 1e-6, 2) + 0.0) AS total FROM (SELECT utt, scale, max(am + scale * lm) AS total FROM full_paths, (SELECT unnest(range(0, 21)) * 2.5::DOUBLE AS scale) GROUP BY 1, 2) GROUP BY scale", **ARC).replace("WITH", "WITH RECURSIVE", 1))
def _(spark, d):
    best = se.rescore(se.paths(*lattice(spark, d)), [2.5 * k for k in range(21)])
    return best.groupBy("scale").agg(F.count(F.lit(1)).alias("lattices"), F.round(F.sum("total") + 1e-6, 2).alias("total"))


@query("dec13_arc_posteriors", v.with_views("""SELECT arcs.utt, arcs.src, arcs.dst, arcs.word, round(coalesce(sum(share), 0), 5) + 0.0 AS posterior FROM arcs LEFT JOIN
(SELECT utt, unnest(nodes[:-2]) AS src, unnest(nodes[2:]) AS dst, exp(total) / sum(exp(total)) OVER (PARTITION BY utt) AS share FROM walked JOIN ends USING (utt) WHERE node = z AND len(nodes) > 1) p ON p.utt = arcs.utt AND p.src = arcs.src AND p.dst = arcs.dst GROUP BY 1, 2, 3, 4""",
    **ARC, walked="SELECT utt, a AS node, [a] AS nodes, 0.0::DOUBLE AS total FROM ends UNION ALL SELECT w.utt, dst, list_append(nodes, dst), w.total + arcs.total FROM walked w JOIN arcs ON w.utt = arcs.utt AND w.node = src").replace("WITH", "WITH RECURSIVE", 1))
def _(spark, d):
    return se.arc_posteriors(*lattice(spark, d)).withColumn("posterior", F.round("posterior", 5))


@query("dec14_nbest_rank", v.with_views("SELECT utt, hyp, words, rank, (round(score, 4) + 0.0) AS score FROM (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY score DESC, hyp) AS rank FROM (SELECT utt, words, min(hyp) AS hyp, arg_min(round(am + 20 * lm - 2 * len(string_split(words, ' ')), 6), hyp) AS score FROM hyp GROUP BY 1, 2)) WHERE rank <= 5",
    hyp="SELECT l_orderkey % 500 AS utt, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS hyp, l_returnflag || ' ' || l_linestatus || CASE WHEN l_linenumber > 3 THEN ' x' ELSE '' END AS words, -l_quantity AS am, -l_tax AS lm FROM lineitem"))
def _(spark, d):
    li = v.table(spark, d, "lineitem")
    words = F.concat("l_returnflag", F.lit(" "), "l_linestatus", F.when(F.col("l_linenumber") > 3, " x").otherwise(""))
    hyps = li.select((F.col("l_orderkey") % 500).alias("utt"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("hyp"), words.alias("words"), (-F.col("l_quantity")).alias("am"), (-F.col("l_tax")).alias("lm"))
    return se.nbest(hyps, 20.0, 2.0, most=5).select("utt", "hyp", "words", "rank", F.round("score", 4).alias("score"))


#: One step for each further time that a word stands in a document.
SEEN = {"w": "SELECT doc_id, word, pos, pos % 50 AS b, row_number() OVER (PARTITION BY doc_id, word ORDER BY pos) AS n FROM words",
        "met": "SELECT doc_id, word, n, pos, [{'o': pos, 'b': b}] AS kept, pos AS node FROM w WHERE n = 1 UNION ALL SELECT doc_id, word, n, pos, CASE WHEN hit IS NULL THEN list_append(kept, {'o': pos, 'b': b}) ELSE kept END, coalesce(hit, pos) FROM (SELECT w.*, kept, list_filter(kept, lambda x: abs(x.b - w.b) < 3)[1].o AS hit FROM met JOIN w ON w.doc_id = met.doc_id AND w.word = met.word AND w.n = met.n + 1)"}


@query("join9_match_lattice_nodes", v.with_views("SELECT doc_id::VARCHAR AS utt, pos AS ord, word, pos % 50 AS begin, pos % 50 + len(word) AS end, node FROM met".replace("AS begin", 'AS "begin"').replace("AS end", 'AS "end"'), "words", **SEEN).replace("WITH", "WITH RECURSIVE", 1))
def _(spark, d):
    w = v.words(spark, d)
    nodes = w.select(F.col("doc_id").alias("utt"), F.col("pos").alias("ord"), "word", (F.col("pos") % 50).alias("begin"), (F.col("pos") % 50 + F.length("word")).alias("end"))
    return se.match_nodes(nodes)


REFHYP = {
    "refw": "SELECT doc_id AS utt, pos AS ord, pos * 10 AS end_t, word, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS hist, -(len(word)::DOUBLE) AS am, -((pos % 7)::DOUBLE) AS lm, len(word) > 11 AS oov FROM words",
    "hypw": "SELECT utt, ord, end_t, CASE WHEN ord % 9 = 4 THEN word || 'x' ELSE word END AS word, hist, am - (ord % 3 - 1) AS am, lm + (ord % 5 - 2) AS lm FROM refw WHERE ord % 11 <> 6",
    "m": "SELECT DISTINCT r.utt, r.end_t, r.word, r.hist FROM refw r JOIN hypw h ON r.utt = h.utt AND r.end_t = h.end_t AND r.word = h.word AND r.hist = h.hist",
}


def ref_and_hyp(spark, d):
    """Documents as reference words, and a hypothesis with changed and lost words."""
    words = v.word_lists(spark, d).select("doc_id", "words", F.posexplode("words").alias("pos", "word"))
    ref = words.select(F.col("doc_id").alias("utt"), F.col("pos").cast("long").alias("ord"), (F.col("pos").cast("long") * 10).alias("end"), "word", F.when(F.col("pos") > 0, F.get("words", F.col("pos") - 1)).alias("hist"),
                       (-F.length("word").cast("double")).alias("am"), (-(F.col("pos") % 7).cast("double")).alias("lm"), (F.length("word") > 11).alias("oov"))
    hyp = ref.where("ord % 11 <> 6").select("utt", "ord", "end", F.when(F.col("ord") % 9 == 4, F.concat("word", F.lit("x"))).otherwise(F.col("word")).alias("word"), "hist",
                                            (F.col("am") - (F.col("ord") % 3 - 1)).alias("am"), (F.col("lm") + (F.col("ord") % 5 - 2)).alias("lm"))
    return ref, hyp


@query("join10_ref_hyp_match", v.with_views("SELECT utt, count(*) AS matched FROM m GROUP BY utt", "words", **REFHYP))
def _(spark, d):
    return se.align_words(*ref_and_hyp(spark, d)).groupBy("utt").agg(F.count(F.lit(1)).alias("matched"))


REGION = {
    "both_w": "SELECT r.utt, r.end_t, r.ord, r.am, r.lm, r.oov, 1 AS side, m.utt IS NOT NULL AS hit FROM refw r LEFT JOIN m ON r.utt = m.utt AND r.end_t = m.end_t AND r.word = m.word AND r.hist = m.hist UNION ALL SELECT h.utt, h.end_t, h.ord, h.am, h.lm, false, 0, m.utt IS NOT NULL FROM hypw h LEFT JOIN m ON h.utt = m.utt AND h.end_t = m.end_t AND h.word = m.word AND h.hist = m.hist",
    "numbered": "SELECT *, coalesce(sum(CASE WHEN hit AND side = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY utt ORDER BY end_t, side DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS region FROM both_w",
    "reg": "SELECT utt, region, sum(side)::BIGINT AS nr, sum(1 - side)::BIGINT AS nh, bool_or(oov) AS oov, sum(side * am) AS ar, sum((1 - side) * am) AS ah, sum(side * lm) AS lr, sum((1 - side) * lm) AS lh FROM numbered WHERE NOT hit GROUP BY 1, 2",
    "regions_w": "SELECT utt, region, least(nr, nh) AS sub, nr - least(nr, nh) AS del, nh - least(nr, nh) AS ins, CASE WHEN oov THEN 'OOV' WHEN ar + lr > ah + lh THEN 'SEARCH' WHEN ah > ar AND lh > lr THEN 'AM_LM' WHEN lh > lr THEN 'LM' ELSE 'AM' END AS blame FROM reg",
}


@query("dec15_error_regions", v.with_views("SELECT * FROM regions_w", "words", **REFHYP, **REGION))
def _(spark, d):
    return se.error_regions(*ref_and_hyp(spark, d))


@query("dec16_word_error_rate", v.with_views("SELECT blame, sum(sub)::BIGINT AS sub, sum(del)::BIGINT AS del, sum(ins)::BIGINT AS ins, (SELECT count(*) FROM refw) AS words, (round(100.0 * (sum(sub) + sum(del) + sum(ins)) / (SELECT count(*) FROM refw), 5) + 0.0)::DOUBLE AS wer FROM regions_w GROUP BY blame", "words", **REFHYP, **REGION))
def _(spark, d):
    ref, hyp = ref_and_hyp(spark, d)
    out = se.word_error_rate(se.error_regions(ref, hyp), ref.agg(F.count(F.lit(1)).alias("words")))
    return out.withColumn("wer", F.round("wer", 5))
