"""Connected components of a graph.

Each task first replaces its edges by the trees that it sees, a few million edges at a time, which leaves fewer
edges than nodes. Trees are dealt together and contracted again while that helps; what fits one task's bound is
finished there. Larger graphs go on by alternating large-star and small-star steps, which hang neighbours below the
smallest node they can see, for about log(n) rounds. The driver sees two numbers a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .workers import lean


def local_trees(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) for all nodes but those smallest ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a):]
    low = np.arange(len(nodes))
    while True:
        x, y = low[u], low[v]
        apart = x != y
        if not apart.any():
            break
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        # The larger root hangs below the smaller; then every node is led to its root.
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = low[low]
            if (up == low).all():
                break
            low = up
    below = low != np.arange(len(nodes))
    return nodes[below], nodes[low[below]]


def contracted(edges: DataFrame, most: int) -> DataFrame:
    """Trees instead of each task's edges, ``most`` edges at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def trees() -> tuple[np.ndarray, np.ndarray]:
            return local_trees(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size > most:
                held = [trees()]
                size = len(held[0][0])
                if size > most // 2:  # little is gained by holding these
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], names=["a", "b"])
                    held, size = [], 0
        if held:
            a, b = trees()
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(lean(run), "a long, b long")


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The step's edges, and the written table that they are computed from."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written, so that the join deals both sides itself and can split a hub.
    low = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "lowest")
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), low


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most: int = 2_000_000, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node that an edge (a, b) between two nodes names; ``root`` is the component's smallest node.

    Loops and repeated edges don't matter; an empty graph has no rows. Nodes are long integers and not null. A task
    holds about twice ``most`` edges.
    """
    now = written(contracted(edges.where("a <> b"), most), "trees")
    size, before = now.count(), None
    while size > most and (before is None or size < 0.7 * before):
        now = written(contracted(now.repartition(-(-size // most)), most), "trees", now)
        size, before = now.count(), size
    if size <= most:
        now = written(contracted(now.coalesce(1), 2 * most), "trees", now)
    else:
        now = _settled(now, most_rounds)
    below = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return below.unionByName(below.select(F.col("root").alias("node"), "root").distinct())


def _settled(now: DataFrame, most_rounds: int) -> DataFrame:
    mark = None
    for _ in range(most_rounds):
        sums = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (sums.n, sums.x) == mark:
            return now
        mark = (sums.n, sums.x)
        large, low = _large_star(now)
        now = written(_small_star(large), "edges", now, low)
    raise RuntimeError("components did not settle")
