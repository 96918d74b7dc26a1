"""Hidden Markov models: decoding, alignment and training. One utterance is one group; statistics meet in Spark sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def viterbi(obs: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Best state path of (frames, states) log scores; of equal predecessors the lowest state."""
    n, s = obs.shape
    back = np.zeros((n, s), dtype=np.int64)
    ll = start + obs[0]
    for t in range(1, n):
        step = ll[:, None] + trans
        back[t] = step.argmax(0)
        ll = step[back[t], np.arange(s)] + obs[t]
    path = np.empty(n, dtype=np.int64)
    path[-1] = ll.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path, float(ll.max())


def left_right(states: int, log_self: float, log_next: float) -> np.ndarray:
    """DEC-4: transitions of a chain that stays or moves on by one."""
    t = np.full((states, states), -np.inf)
    t[np.arange(states), np.arange(states)] = log_self
    t[np.arange(states - 1), np.arange(1, states)] = log_next
    return t


def segment_decode(scores: np.ndarray, min_frames: int, change: np.ndarray | float) -> np.ndarray:
    """DEC-9: label of each frame where every run has at least ``min_frames`` frames, by a ring of states for each label.

    ``scores`` is (frames, labels); a change of label a to b costs ``change[a, b]``. The last run may be cut by the end.
    """
    n, labels = scores.shape
    change = np.full((labels, labels), float(change)) if np.isscalar(change) else change
    ring = np.full((min_frames, labels), -np.inf)
    ring[0] = scores[0]
    came = np.zeros((n, labels), dtype=np.int64)   # label before an entry at t
    stay = np.zeros((n, labels), dtype=bool)       # the last ring state stayed in itself at t
    for t in range(1, n):
        out = ring[-1][:, None] + change
        np.fill_diagonal(out, -np.inf)
        came[t] = out.argmax(0)
        new = np.empty_like(ring)
        new[0] = out[came[t], np.arange(labels)]
        new[1:] = ring[:-1]
        if min_frames > 1:
            stay[t] = ring[-1] >= new[-1]
            new[-1] = np.maximum(new[-1], ring[-1])
        else:
            stay[t] = ring[-1] >= new[0]
            new[0] = np.maximum(new[0], ring[-1])
        ring = new + scores[t]
    pos, label = np.unravel_index(int(ring.argmax()), ring.shape)
    out = np.empty(n, dtype=np.int64)
    for t in range(n - 1, -1, -1):
        out[t] = label
        if pos == min_frames - 1 and stay[t][label]:
            continue
        if pos:
            pos -= 1
        elif t:
            label, pos = came[t][label], min_frames - 1
    return out


def decode_segments(scores: DataFrame, min_frames: int, change: float) -> DataFrame:
    """DEC-9 over (stream_id, t, label, logp): best segmentation of each stream."""

    def run(pdf):
        import pandas as pd

        table = pdf.pivot_table(index="t", columns="label", values="logp").sort_index()
        labels = table.columns.to_numpy()[segment_decode(table.to_numpy(), min_frames, change)]
        t = table.index.to_numpy()
        cut = np.flatnonzero(np.concatenate(([True], labels[1:] != labels[:-1])))
        ends = np.append(cut[1:] - 1, len(t) - 1)
        return pd.DataFrame({"stream_id": pdf["stream_id"].iloc[0], "first": t[cut], "last": t[ends], "label": labels[cut]})

    rows = scores.select(F.col("stream_id").cast("string"), F.col("t").cast("long"), F.col("label").cast("long"), "logp")
    return rows.groupBy("stream_id").applyInPandas(run, "stream_id string, first long, last long, label long")


def forced_alignment(scores: DataFrame, transcripts: DataFrame, log_self: float = -0.1, log_next: float = -2.0, states: int = 3) -> DataFrame:
    """DEC-6, SNK-4: aligns each utterance's phones, ``states`` states each, to its frames.

    ``scores`` is (utt, t, phone, state, logp), ``transcripts`` (utt, phones). Gives (utt, ord, phone, state, first, last, ll);
    an utterance with fewer frames than states has no rows.
    """
    rows = scores.join(transcripts, "utt").where(F.array_contains("phones", F.col("phone"))).select(F.col("utt").cast("string"), F.col("t").cast("long"), "phone", F.col("state").cast("long"), "logp", "phones")

    def run(pdf):
        import pandas as pd

        phones = list(pdf["phones"].iloc[0])
        table = pdf.pivot_table(index="t", columns=["phone", "state"], values="logp").sort_index()
        columns = [(p, s) for p in phones for s in range(states)]
        if len(table) < len(columns):
            # Typed, as pandas takes an empty list for floats, which Arrow casts to chunks of text that Spark does not take.
            return pd.DataFrame({k: np.empty(0, dtype=kind) for k, kind in (("utt", object), ("ord", np.int64), ("phone", object), ("state", np.int64), ("first", np.int64), ("last", np.int64), ("ll", np.float64))})
        obs = table[columns].to_numpy()
        start = np.full(len(columns), -np.inf)
        start[0] = 0.0
        # The path must end in the last state: other ends are closed.
        obs = obs.copy()
        obs[-1, :-1] = -np.inf
        path, ll = viterbi(obs, left_right(len(columns), log_self, log_next), start)
        t = table.index.to_numpy()
        cut = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
        ends = np.append(cut[1:] - 1, len(t) - 1)
        k = path[cut]
        return pd.DataFrame({"utt": pdf["utt"].iloc[0], "ord": k // states, "phone": [phones[i // states] for i in k], "state": k % states, "first": t[cut], "last": t[ends], "ll": ll})

    return rows.groupBy("utt").applyInPandas(run, "utt string, ord long, phone string, state long, first long, last long, ll double")


def forward_backward(obs: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """State shares of each frame, summed transition shares and log likelihood."""
    n, s = obs.shape
    f, b = np.empty((n, s)), np.zeros((n, s))
    f[0] = start + obs[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        for t in range(1, n):
            f[t] = np.logaddexp.reduce(f[t - 1][:, None] + trans, axis=0) + obs[t]
        for t in range(n - 2, -1, -1):
            b[t] = np.logaddexp.reduce(trans + (obs[t + 1] + b[t + 1])[None, :], axis=1)
        total = np.logaddexp.reduce(f[-1])
        gamma = np.exp(f + b - total)
        xi = np.zeros((s, s))
        for t in range(n - 1):
            xi += np.exp(f[t][:, None] + trans + (obs[t + 1] + b[t + 1])[None, :] - total)
    return gamma, xi, float(total)


def state_shares(scores: DataFrame, trans: np.ndarray, start: np.ndarray, best_path: bool = False) -> DataFrame:
    """PDF-16, PDF-17: each frame's state shares ``gamma`` by Baum-Welch, or of the best path alone: (utt, t, state, gamma, ll)."""
    rows = scores.select(F.col("utt").cast("string"), F.col("t").cast("long"), F.col("state").cast("long"), "logp")

    def run(pdf):
        import pandas as pd

        table = pdf.pivot_table(index="t", columns="state", values="logp").sort_index()
        obs = table.to_numpy()
        if best_path:
            path, ll = viterbi(obs, trans, start)
            gamma = np.eye(obs.shape[1])[path]
        else:
            gamma, _, ll = forward_backward(obs, trans, start)
        t = np.repeat(table.index.to_numpy(), obs.shape[1])
        return pd.DataFrame({"utt": pdf["utt"].iloc[0], "t": t, "state": np.tile(table.columns.to_numpy(), len(obs)), "gamma": gamma.ravel(), "ll": ll})

    return rows.groupBy("utt").applyInPandas(run, "utt string, t long, state long, gamma double, ll double")


def adapt_statistics(alignment: DataFrame, frames: DataFrame) -> DataFrame:
    """DEC-21: sums by phone and state over the frames of an alignment."""
    at = alignment.select("utt", "phone", "state", F.explode(F.sequence("first", "last")).alias("t"))
    rows = at.join(frames, ["utt", "t"]).select("phone", "state", F.posexplode("vec").alias("d", "x"))
    return rows.groupBy("phone", "state", "d").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))


def mllr_mean_transform(means: np.ndarray, variances: np.ndarray, w: np.ndarray, sx: np.ndarray, prior: np.ndarray | None = None, weight: float = 10.0) -> np.ndarray:
    """PDF-15: affine transform (dim, dim + 1) of means that fits the statistics, drawn to a parent's transform.

    Row by row the normal equations of sum w (x - W [1, mean])^2 / var, plus ``weight`` times the distance from ``prior``.
    """
    k, dim = means.shape
    ext = np.concatenate([np.ones((k, 1)), means], axis=1)
    prior = np.concatenate([np.zeros((dim, 1)), np.eye(dim)], axis=1) if prior is None else prior
    out = np.empty((dim, dim + 1))
    for d in range(dim):
        g = weight * np.eye(dim + 1) + (ext * (w / variances[:, d])[:, None]).T @ ext
        out[d] = np.linalg.solve(g, weight * prior[d] + ext.T @ (sx[:, d] / variances[:, d]))
    return out


def adapt_tree(stats: DataFrame, parents: dict[int, int | None], weight: float = 10.0) -> DataFrame:
    """PDF-15 over a regression tree: (node, mean, var, w, sx) rows belong to leaves; every node's transform uses all rows below it.

    Transforms come from the root down, each with its parent's as the prior; rows are adapted by their own leaf's.
    """
    def above(n):
        chain = []
        while n is not None:
            chain.append(n)
            n = parents[n]
        return chain[::-1]

    chains = {leaf: above(leaf) for leaf in parents}
    spark = stats.sparkSession
    chain_rows = spark.createDataFrame([(leaf, chain) for leaf, chain in chains.items()], "node long, chain array<long>")
    rows = stats.join(F.broadcast(chain_rows), "node").withColumn("root", F.col("chain")[0])

    def run(pdf):
        arr = lambda rows, c: np.stack(rows[c].to_numpy())
        done = {}
        for leaf in sorted(set(pdf["node"])):
            prior = None
            for n in chains[leaf]:
                if n not in done:
                    below = pdf[[n in c for c in pdf["chain"]]]
                    done[n] = mllr_mean_transform(arr(below, "mean"), arr(below, "var"), below["w"].to_numpy(), arr(below, "sx"), prior, weight)
                prior = done[n]
        new = [done[n] @ np.concatenate(([1.0], m)) for n, m in zip(pdf["node"], pdf["mean"], strict=True)]
        return pdf[["comp_id", "node"]].assign(mean=new)

    return rows.groupBy("root").applyInPandas(run, "comp_id long, node long, mean array<double>")
