"""Search: tries, beams, recombination, traceback, lattices, N-best lists and error attribution."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stores import materialised

# -- lexicon -------------------------------------------------------------------------------------------


def build_trie(lexicon: DataFrame, share_next: bool = True) -> DataFrame:
    """DEC-1: nodes of the prefix tree of (word_id, phones): ``node, parent, phone, next, depth, word_id``.

    A node is named by its phones. With ``share_next`` words share a node only if their next phones agree too, as a node
    stands for a phone in its right context. Words that end at a node give it one row each.
    """
    rows = lexicon.select("word_id", "phones", F.posexplode("phones").alias("i", "phone"))
    name = lambda n: F.array_join(F.slice("phones", F.lit(1), n), " ")
    following = F.get("phones", F.col("i") + 1)
    tag = lambda base, after: F.concat_ws(">", base, after) if share_next else base
    node = tag(name(F.col("i") + 1), following)
    parent = F.when(F.col("i") > 0, tag(name(F.col("i")), F.col("phone")))
    return rows.select(node.alias("node"), parent.alias("parent"), "phone", (following if share_next else F.lit(None).cast("string")).alias("next"), (F.col("i") + 1).alias("depth"),
                       F.when(F.col("i") == F.size("phones") - 1, F.col("word_id")).alias("word_id")).distinct()


def look_ahead(lexicon: DataFrame, word_logp: DataFrame) -> DataFrame:
    """LM-11: for each prefix the best language score of the words below: ``prefix, bound``."""
    rows = lexicon.join(word_logp, "word_id")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("phones")), lambda n: F.array_join(F.slice("phones", F.lit(1), n), " "))
    return rows.select(F.explode(prefixes).alias("prefix"), "p").groupBy("prefix").agg(F.max("p").alias("bound"))


def context_matrix(lexicon: DataFrame) -> DataFrame:
    """DEC-2: phones that may meet where words meet: ``end_phone, start_phone, pairs``, with the number of word pairs that bring them together.

    End phones and start phones are counted first, so words are never paired.
    """
    ends = lexicon.where(F.size("phones") > 0).groupBy(F.element_at("phones", -1).alias("end_phone")).agg(F.count(F.lit(1)).alias("_e"))
    starts = lexicon.where(F.size("phones") > 0).groupBy(F.element_at("phones", 1).alias("start_phone")).agg(F.count(F.lit(1)).alias("_s"))
    # Both sides have one row for each phone.
    return ends.crossJoin(F.broadcast(starts)).select("end_phone", "start_phone", (F.col("_e") * F.col("_s")).alias("pairs"))


def missing_models(lexicon: DataFrame, models: DataFrame) -> DataFrame:
    """DEC-2: phones of the lexicon that ``models`` (phone) lacks, with the number of words that need them; no rows if all fit."""
    used = lexicon.select("word_id", F.explode(F.array_distinct("phones")).alias("phone")).groupBy("phone").agg(F.count(F.lit(1)).alias("words"))
    return used.join(models.select("phone").distinct(), "phone", "left_anti")


def initial_tokens(utterances: DataFrame, pairs: DataFrame, singles: DataFrame, start: str = "<s>") -> DataFrame:
    """DEC-20: one token for each utterance at the root with score 0 and a history: ``utt, node, state, h1, h2, ll``.

    ``utterances`` has (utt, w1, w2); null words stand for the start symbol alone. Of two given words the history is the longest
    suffix that the model has: ``pairs`` (w1, w2), ``singles`` (w1).
    """
    rows = utterances.join(pairs.select("w1", "w2", F.lit(True).alias("_two")).distinct(), ["w1", "w2"], "left")
    rows = rows.join(singles.select(F.col("w1").alias("w2"), F.lit(True).alias("_one")).distinct(), "w2", "left")
    given = F.col("w2").isNotNull()
    return rows.select("utt", F.lit("").alias("node"), F.lit(0).alias("state"), F.when(given & F.col("_two"), F.col("w1")).alias("h1"),
                       F.when(~given, F.lit(start)).when(F.col("_one") | F.col("_two"), F.col("w2")).alias("h2"), F.lit(0.0).alias("ll"))


def phone_exits(tokens: DataFrame, children: DataFrame, last_state: int, log_next: float) -> DataFrame:
    """DEC-17: tokens in the last state of a node enter the first state of its child nodes (node, child)."""
    return tokens.where(F.col("state") == last_state).join(children, "node").select(
        "t", F.col("child").alias("node"), F.lit(0).cast("long").alias("state"), "hist", "path_id", (F.col("ll") + log_next).alias("ll"))


def word_exits(tokens: DataFrame, words: DataFrame, pairs: DataFrame, singles: DataFrame, last_state: int, log_next: float, scale: float, penalty: float) -> DataFrame:
    """DEC-5, DEC-17: tokens that leave a word: a link record (t, path_id, hist, word) each, with the language score and the new total.

    ``words`` has (node, word), ``pairs`` (hist, word, p), ``singles`` (word, p, bo). The word becomes the next history.
    """
    out = tokens.where(F.col("state") == last_state).join(words, "node")
    out = out.join(pairs.select("hist", "word", F.col("p").alias("_p2")), ["hist", "word"], "left").join(singles.select("word", F.col("p").alias("_p1")), "word", "left")
    out = out.join(singles.select(F.col("word").alias("hist"), "bo"), "hist", "left")
    lm = F.coalesce("_p2", F.coalesce("bo", F.lit(0.0)) + F.col("_p1"))
    return out.select("t", "path_id", "hist", "word", lm.alias("lm"), (F.col("ll") + log_next + scale * lm - penalty).alias("ll"))


def final_tokens(tokens: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """DEC-19: the best token of each utterance's last frame, among ``allowed`` nodes (utt, node) if these are given; of equals the lowest path.

    An utterance without an allowed token has no row.
    """
    last = tokens.groupBy("utt").agg(F.max("t").alias("t"))
    rows = tokens.join(last, ["utt", "t"])
    if allowed is not None:
        rows = rows.join(allowed.select("utt", "node").distinct(), ["utt", "node"], "left_semi")
    best = F.max_by(F.struct("t", "node", "path_id", "ll"), F.struct("ll", (-F.col("path_id")).alias("p"))).alias("_b")
    return rows.groupBy("utt").agg(best).select("utt", "_b.*")


def lattice_contexts(arcs: DataFrame, first: DataFrame, start: str = "<s>") -> DataFrame:
    """DEC-19: arcs between nodes that remember the word that led to them: ``utt, src, before, dst, word, am, lm``.

    A node becomes one for each word that enters it, so a bigram score can be given to each arc; the first node's is ``start``.
    """
    entered = arcs.select("utt", F.col("dst").alias("src"), F.col("word").alias("before")).distinct()
    entered = entered.unionByName(first.select("utt", F.col("node").alias("src"), F.lit(start).alias("before")))
    return arcs.join(entered, ["utt", "src"]).select("utt", "src", "before", "dst", "word", "am", "lm")


# -- pruning -------------------------------------------------------------------------------------------
# Bests are aggregates that are joined back, so that a frame of many tokens is never one window.


def _with_best(tokens: DataFrame, keys: list[str], name: str) -> DataFrame:
    return tokens.join(tokens.groupBy(*keys).agg(F.max("ll").alias(name)), keys)


def beam(tokens: DataFrame, width: float) -> DataFrame:
    """TOPK-1: drops tokens at or below the frame's best less ``width``."""
    return _with_best(tokens, ["t"], "_best").where(F.col("ll") > F.col("_best") - width).drop("_best")


def state_beam(tokens: DataFrame, width: float, state_width: float) -> DataFrame:
    """TOPK-2: the stricter of the frame's and the state's beam."""
    rows = _with_best(_with_best(tokens, ["t"], "_best"), ["t", "node", "state"], "_own")
    return rows.where(F.col("ll") > F.greatest(F.col("_best") - width, F.col("_own") - state_width)).drop("_best", "_own")


def histogram_prune(tokens: DataFrame, width: float, limit: int, bins: int = 100) -> DataFrame:
    """TOPK-3: cuts each frame below the bin at which ``limit`` tokens are reached, at ``width`` at the latest."""
    step = width / bins
    rows = _with_best(tokens, ["t"], "_best")
    rows = rows.withColumn("_bin", F.least(F.floor((F.col("_best") - F.col("ll")) / step), F.lit(bins)))
    counts = rows.groupBy("t", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    run = F.sum("_n").over(Window.partitionBy("t").orderBy("_bin"))
    cut = counts.withColumn("_run", run).groupBy("t").agg(F.coalesce(F.min(F.when(F.col("_run") >= limit, F.col("_bin"))), F.lit(bins)).alias("_cut"))
    return rows.join(cut, "t").where(F.col("ll") > F.col("_best") - F.col("_cut") * step).drop("_best", "_bin", "_cut")


def word_end_beam(tokens: DataFrame, width: float) -> DataFrame:
    """TOPK-4: a beam among word ends (``word_end``) only; other tokens stay."""
    ends = beam(tokens.where("word_end"), width)
    return tokens.where("not word_end").unionByName(ends.select(tokens.columns))


def recombine(tokens: DataFrame) -> DataFrame:
    """TOPK-6: the best token of each state and history; of equals the one with the lowest path."""
    best = F.max_by(F.struct("path_id", "ll"), F.struct("ll", (-F.col("path_id")).alias("p"))).alias("_b")
    return tokens.groupBy("t", "node", "state", "hist").agg(best).select("t", "node", "state", "hist", "_b.path_id", "_b.ll")


def state_cap(tokens: DataFrame, k: int) -> DataFrame:
    """TOPK-5: at most k tokens of each state, the best first."""
    w = Window.partitionBy("t", "node", "state").orderBy(F.desc("ll"), "path_id")
    return tokens.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def best_word_ends(tokens: DataFrame, k: int) -> DataFrame:
    """TOPK-7: the k best words of each frame, one token for each."""
    one = tokens.groupBy("t", "word").agg(F.max("ll").alias("ll"))
    w = Window.partitionBy("t").orderBy(F.desc("ll"), "word")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def depth_distribution(tokens: DataFrame) -> DataFrame:
    """SNK-8: active tokens by frame and tree depth."""
    return tokens.groupBy("t", "depth").agg(F.count(F.lit(1)).alias("tokens"))


# -- traceback and lattices ----------------------------------------------------------------------------


def traceback(links: DataFrame, ends: DataFrame) -> DataFrame:
    """DEC-8: from each end (utt, path_id) back along (utt, path_id, prev_id): ``utt, back, path_id``, back from 0.

    Links are doubled: after k rounds a link leads 2**k steps back and all nodes up to there are known, so a path of n
    links takes about log2(n) rounds, however long it is. Each round is written. Links that form a circle are an error.
    """
    jump = materialised(links.where("prev_id is not null").select("utt", "path_id", "prev_id"), "jumps")
    most = jump.count()
    seen, step = materialised(ends.select("utt", F.lit(0).alias("back"), "path_id"), "seen"), 1
    while True:
        more = materialised(seen.join(jump, ["utt", "path_id"]).select("utt", (F.col("back") + step).alias("back"), F.col("prev_id").alias("path_id")), "further")
        if more.isEmpty():
            return seen
        if step > most:
            raise ValueError("the links form a circle")
        seen = materialised(seen.unionByName(more), "seen", seen, more)
        far = jump.select("utt", F.col("path_id").alias("prev_id"), F.col("prev_id").alias("_far"))
        jump = materialised(jump.join(far, ["utt", "prev_id"]).select("utt", "path_id", F.col("_far").alias("prev_id")), "jumps", jump)
        step *= 2


def reference_path(links: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DEC-18: the best path's words in order, as the reference of an error analysis, and totals of each utterance.

    ``links`` has (utt, path_id, prev_id, word, end, am, lm). Gives (utt, ord, word, hist, end, am, lm) and (utt, words, am, lm).
    """
    back = traceback(links, ends).join(links, ["utt", "path_id"])
    last = back.groupBy("utt").agg(F.max("back").alias("_n"))
    w = Window.partitionBy("utt").orderBy(F.desc("back"))
    ref = back.join(last, "utt").select("utt", (F.col("_n") - F.col("back")).alias("ord"), "word", F.lag("word").over(w).alias("hist"), "end", "am", "lm")
    return ref, ref.groupBy("utt").agg(F.count(F.lit(1)).alias("words"), F.sum("am").alias("am"), F.sum("lm").alias("lm"))


def lattice_arcs(word_links: DataFrame, lm_scale: float = 27.5) -> DataFrame:
    """DEC-10: arcs between word ends: acoustic part, language part and total am / scale + lm."""
    return word_links.select("utt", F.col("prev_id").alias("src"), F.col("path_id").alias("dst"), "word", "am", "lm", (F.col("am") / lm_scale + F.col("lm")).alias("total"))


def dedup_arcs(arcs: DataFrame) -> DataFrame:
    """DEC-11: of arcs between two nodes with one word, the best total."""
    keep = F.max_by(F.struct("am", "lm", "total"), F.struct("total", "am")).alias("_b")
    return arcs.groupBy("utt", "src", "dst", "word").agg(keep).select("utt", "src", "dst", "word", "_b.am", "_b.lm", "_b.total")


def sorted_arcs(arcs: DataFrame) -> DataFrame:
    """SORT-2: arcs that leave a node in order of their totals, best first, as ``rank``."""
    return arcs.withColumn("rank", F.row_number().over(Window.partitionBy("utt", "src").orderBy(F.desc("total"), "dst", "word")))


def _walk(arcs: DataFrame, start: DataFrame, step) -> list[DataFrame]:
    """Written tables of what ``step(here, arcs)`` reaches, round by round, until nothing is left; a circle of arcs is an error."""
    arcs = materialised(arcs, "arcs")
    most, rounds, here = arcs.count(), [], start
    while True:
        here = materialised(step(here, arcs), "reached")
        if here.isEmpty():
            return rounds
        if len(rounds) >= most:
            raise ValueError("the arcs form a circle")
        rounds.append(here)


def _united(rounds: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.limit(0)
    for r in rounds:
        out = out.unionByName(r)
    return out


def count_paths(arcs: DataFrame, first: DataFrame, last: DataFrame) -> DataFrame:
    """DEC-12: number of paths of each lattice from its first to its last node, by summed counts, without listing them."""
    start = first.select("utt", F.col("node").alias("src"), F.lit(1).cast("long").alias("n"))
    rounds = _walk(arcs.select("utt", "src", "dst"), start, lambda here, a: here.join(a, ["utt", "src"]).groupBy("utt", F.col("dst").alias("src")).agg(F.sum("n").alias("n")))
    ended = _united(rounds, start).join(last.select("utt", F.col("node").alias("src")), ["utt", "src"])
    return ended.groupBy("utt").agg(F.sum("n").alias("paths"))


def paths(arcs: DataFrame, first: DataFrame, last: DataFrame) -> DataFrame:
    """DEC-12, SNK-6: all paths: ``utt, words, am, lm``. There may be exponentially many; ``count_paths`` tells how many."""
    start = first.select("utt", F.col("node").alias("src"), F.array().cast("array<string>").alias("words"), F.lit(0.0).alias("am"), F.lit(0.0).alias("lm"))

    def step(here: DataFrame, a: DataFrame) -> DataFrame:
        return here.join(a, ["utt", "src"]).select("utt", F.col("dst").alias("src"), F.concat("words", F.array("_w")).alias("words"), (F.col("am") + F.col("_a")).alias("am"), (F.col("lm") + F.col("_l")).alias("lm"))

    rounds = _walk(arcs.select("utt", "src", "dst", F.col("word").alias("_w"), F.col("am").alias("_a"), F.col("lm").alias("_l")), start, step)
    return _united(rounds, start).join(last.select("utt", F.col("node").alias("src")), ["utt", "src"]).select("utt", "words", "am", "lm")


def rescore(all_paths: DataFrame, scales: list[float]) -> DataFrame:
    """DEC-12: the best path of each lattice under each language scale; of equals the first in word order."""
    rows = all_paths.withColumn("scale", F.explode(F.array(*[F.lit(float(s)) for s in scales])))
    rows = rows.withColumn("total", F.col("am") + F.col("scale") * F.col("lm"))
    w = Window.partitionBy("utt", "scale").orderBy(F.desc("total"), F.array_join("words", " "))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def lattice_shares(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, first: int, last: int) -> np.ndarray:
    """Share of each arc in all paths from first to last; nodes are numbered in topological order. Zeros if there is no path."""
    nodes = np.unique(np.concatenate([src, dst, [first, last]]))
    s, d = np.searchsorted(nodes, src), np.searchsorted(nodes, dst)
    a, z = np.searchsorted(nodes, [first, last])
    fwd, bwd = np.full(len(nodes), -np.inf), np.full(len(nodes), -np.inf)
    fwd[a], bwd[z] = 0.0, 0.0
    for k in np.argsort(s, kind="stable"):
        fwd[d[k]] = np.logaddexp(fwd[d[k]], fwd[s[k]] + weight[k])
    for k in np.argsort(-d, kind="stable"):
        bwd[s[k]] = np.logaddexp(bwd[s[k]], bwd[d[k]] + weight[k])
    return np.exp(fwd[s] + weight + bwd[d] - fwd[z]) if np.isfinite(fwd[z]) else np.zeros(len(s))


def arc_posteriors(arcs: DataFrame, first: DataFrame, last: DataFrame, scale: float = 1.0) -> DataFrame:
    """DEC-13: forward-backward shares of lattices' arcs: ``utt, src, dst, word, posterior``.

    A lattice is gathered into one row, and many go through Python at once.
    """
    kind = arcs.schema["utt"].dataType.simpleString()
    arc = F.struct(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "word", F.col("total").cast("double").alias("total"))
    whole = arcs.groupBy("utt").agg(F.array_sort(F.collect_list(arc)).alias("arcs"))
    ends = first.select("utt", F.col("node").cast("long").alias("a")).join(last.select("utt", F.col("node").cast("long").alias("z")), "utt")
    rows = whole.join(ends, "utt").select("utt", "a", "z", "arcs.src", "arcs.dst", "arcs.word", "arcs.total")

    def run(batches):
        for pdf in batches:
            pdf["posterior"] = [lattice_shares(np.asarray(s), np.asarray(d), np.asarray(w) * scale, a, z)
                                for s, d, w, a, z in zip(pdf["src"], pdf["dst"], pdf["total"], pdf["a"], pdf["z"], strict=True)]
            if len(pdf):
                yield pdf[["utt", "src", "dst", "word", "posterior"]].explode(["src", "dst", "word", "posterior"])

    return rows.mapInPandas(run, f"utt {kind}, src long, dst long, word string, posterior double")


def match_nodes(nodes: DataFrame, tolerance: int = 3) -> DataFrame:
    """JOIN-9: lattice nodes of one word whose begin and end differ by less than ``tolerance`` are one: the first seen.

    Order decides, so an utterance is one group: ``utt, ord, word, begin, end, node`` with the joined node's ord.
    """

    def run(pdf):
        pdf = pdf.sort_values("ord")
        kept, node = {}, []
        for o, w, b, e in zip(pdf["ord"].tolist(), pdf["word"].tolist(), pdf["begin"].tolist(), pdf["end"].tolist(), strict=True):
            own = kept.setdefault(w, [])
            hit = next((k for k, kb, ke in own if abs(kb - b) < tolerance and abs(ke - e) < tolerance), None)
            if hit is None:
                own.append((o, b, e))
                hit = o
            node.append(hit)
        return pdf.assign(node=node)[["utt", "ord", "word", "begin", "end", "node"]]

    rows = nodes.select(F.col("utt").cast("string"), F.col("ord").cast("long"), "word", F.col("begin").cast("long"), F.col("end").cast("long"))
    return rows.groupBy("utt").applyInPandas(run, "utt string, ord long, word string, begin long, end long, node long")


# -- N-best and errors ---------------------------------------------------------------------------------


def nbest(hyps: DataFrame, lm_scale: float = 27.5, penalty: float = 0.0, most: int | None = None) -> DataFrame:
    """DEC-14, LIMIT: distinct hypotheses (utt, hyp, words, am, lm) ranked by am + scale * lm - penalty * words.

    Of equal word strings the first in ``hyp`` stays.
    """
    once = hyps.groupBy("utt", "words").agg(F.min_by(F.struct("hyp", "am", "lm"), "hyp").alias("_b")).select("utt", "words", "_b.*")
    # Rounded, so that equal scores are equal in whatever order they were summed.
    score = F.round(F.col("am") + lm_scale * F.col("lm") - penalty * F.size(F.split("words", " ")), 6)
    out = once.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("utt").orderBy(F.desc("score"), "hyp")))
    return out if most is None else out.where(F.col("rank") <= most)


def align_words(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """JOIN-10: reference and hypothesis words that end together, with equal word and history."""
    keys = ["utt", "end", "word", "hist"]
    return ref.select(*keys, F.col("ord").alias("r_ord")).join(hyp.select(*keys, F.col("ord").alias("h_ord")), keys)


def error_regions(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """DEC-15: regions between matched words with their counts, scores and blame.

    A region's substitutions are the lesser of its two word counts; the rest are deletions or insertions. Blame: ``OOV`` if a
    reference word is unknown, ``SEARCH`` if the reference scores better in all, else ``AM_LM``, ``LM`` or ``AM`` by which of the
    hypothesis' scores are better.
    """
    sides = [rows.select("utt", "end", "word", "hist", "am", "lm", (F.col("oov") if side else F.lit(False)).alias("oov"), F.lit(side).alias("side"), "ord") for rows, side in ((ref, 1), (hyp, 0))]
    # Both sides are dealt out by utterance once; matches, regions and sums are all found there.
    both = sides[0].unionByName(sides[1]).repartition("utt")
    same = Window.partitionBy("utt", "end", "word", "hist")
    both = both.withColumn("_m", F.col("end").isNotNull() & F.col("word").isNotNull() & F.col("hist").isNotNull() & (F.min("side").over(same) < F.max("side").over(same)))
    w = Window.partitionBy("utt").orderBy("end", F.desc("side"), "ord").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("region", F.coalesce(F.sum(F.when(F.col("_m") & (F.col("side") == 1), 1).otherwise(0)).over(w), F.lit(0)))
    wrong = both.where("not _m").groupBy("utt", "region").agg(
        F.sum("side").alias("n_ref"), F.sum(1 - F.col("side")).alias("n_hyp"), F.max("oov").alias("oov"),
        *[F.sum(F.when(F.col("side") == s, F.col(c)).otherwise(0.0)).alias(f"{c}_{n}") for s, n in ((1, "ref"), (0, "hyp")) for c in ("am", "lm")])
    sub = F.least("n_ref", "n_hyp")
    am_worse, lm_worse = F.col("am_hyp") > F.col("am_ref"), F.col("lm_hyp") > F.col("lm_ref")
    blame = (F.when(F.col("oov"), "OOV").when(F.col("am_ref") + F.col("lm_ref") > F.col("am_hyp") + F.col("lm_hyp"), "SEARCH")
             .when(am_worse & lm_worse, "AM_LM").when(lm_worse, "LM").otherwise("AM"))
    return wrong.select("utt", "region", sub.alias("sub"), (F.col("n_ref") - sub).alias("del"), (F.col("n_hyp") - sub).alias("ins"), blame.alias("blame"))


def word_error_rate(regions: DataFrame, n_ref: DataFrame) -> DataFrame:
    """DEC-16: percent of errors by blame class over all reference words (n_ref: one row ``words``)."""
    sums = regions.groupBy("blame").agg(*[F.sum(c).alias(c) for c in ("sub", "del", "ins")])
    return sums.crossJoin(F.broadcast(n_ref)).withColumn("wer", 100.0 * (F.col("sub") + F.col("del") + F.col("ins")) / F.col("words"))
