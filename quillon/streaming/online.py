"""The online segmenter: unbounded frames in arrival order become utterances that close after a run of silence.

``online_segments`` keeps one state for each stream: whether it listens, where the utterance began, the run of silent frames and the
frames' running mean and variance. ``session_segments`` is its event-time form with watermarks and session windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RUN = 20
#: What a frame does: it belongs to an utterance, ends one, starts one, or is silence between them.
CONTINUE, END, START, SILENCE = 0, 1, 2, 3
OUT = "stream_id string, first long, last long, frames long, mean double, var double"
STATE = "silent boolean, run long, first long, n long, s double, ss double"


class Listener:
    """State machine over frames (t, energy) of one stream; energy below 0 is silence."""

    def __init__(self, silent: bool = True, run: int = 0, first: int = -1, n: int = 0, s: float = 0.0, ss: float = 0.0, most: int = RUN):
        self.silent, self.run, self.first, self.n, self.s, self.ss, self.most = silent, run, first, n, s, ss, most

    def step(self, t: int, energy: float) -> int:
        if not self.silent:
            self.run = self.run + 1 if energy < 0 else 0
            if energy >= 0:
                self._count(energy)
            if self.run > self.most:
                self.silent = True
                return END
            return CONTINUE
        if energy > 0:
            self.run, self.silent, self.first = 0, False, t
            self.n, self.s, self.ss = 0, 0.0, 0.0
            self._count(energy)
            return START
        return SILENCE

    def _count(self, energy: float) -> None:
        self.n, self.s, self.ss = self.n + 1, self.s + energy, self.ss + energy * energy

    def segment(self, last: int) -> tuple:
        mean = self.s / self.n
        return self.first, last, self.n, mean, max(self.ss / self.n - mean * mean, 0.0)

    def state(self) -> tuple:
        return self.silent, self.run, self.first, self.n, self.s, self.ss


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, most: int) -> Iterator[pd.DataFrame]:
    ear = Listener(*state.get, most=most) if state.exists else Listener(most=most)
    rows = pd.concat(list(batches)).sort_values("t")
    out = []
    for t, e in zip(rows["t"].tolist(), rows["energy"].tolist(), strict=True):
        if ear.step(t, e) == END:
            out.append((str(key[0]), *ear.segment(t)))
    state.update(ear.state())
    yield pd.DataFrame(out, columns=["stream_id", "first", "last", "frames", "mean", "var"])


def online_segments(frames: DataFrame, run: int = RUN) -> DataFrame:
    """Closed utterances of a stream of (stream_id, t, energy); frames of a micro-batch are taken in the order of t."""
    rows = frames.select(F.col("stream_id").cast("string"), F.col("t").cast("long"), F.col("energy").cast("double"))
    return rows.groupBy("stream_id").applyInPandasWithState(lambda k, b, s: _advance(k, b, s, run), OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def batch_segments(frames: DataFrame, run: int = RUN) -> DataFrame:
    """The same utterances from a table."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ear, out = Listener(most=run), []
        pdf = pdf.sort_values("t")
        for t, e in zip(pdf["t"].tolist(), pdf["energy"].tolist(), strict=True):
            if ear.step(t, e) == END:
                out.append((pdf["stream_id"].iloc[0], *ear.segment(t)))
        return pd.DataFrame(out, columns=["stream_id", "first", "last", "frames", "mean", "var"])

    rows = frames.select(F.col("stream_id").cast("string"), F.col("t").cast("long"), F.col("energy").cast("double"))
    return rows.groupBy("stream_id").applyInPandas(one, OUT)


def _best_so_far(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, every: int) -> Iterator[pd.DataFrame]:
    n, labels, totals = state.get if state.exists else (0, [], [])
    sums, out = dict(zip(labels, totals, strict=True)), []
    rows = pd.concat(list(batches)).sort_values(["t", "label"])
    for t, part in rows.groupby("t", sort=True):
        for label, p in zip(part["label"].tolist(), part["logp"].tolist(), strict=True):
            sums[label] = sums.get(label, 0.0) + p
        n += 1
        if n % every == 0:
            best = min(sums, key=lambda x: (-sums[x], x))
            out.append((str(key[0]), int(t), n, best, sums[best]))
    state.update((n, list(sums), list(sums.values())))
    yield pd.DataFrame(out, columns=["stream_id", "at", "frames", "label", "ll"])


def partial_results(scores: DataFrame, every: int = 10) -> DataFrame:
    """The best label so far after every ``every`` frames of a stream of (stream_id, t, label, logp): ``stream_id, at, frames, label, ll``.

    A frame's scores come together; the state holds a sum for each label, and of equal labels the lowest is best.
    """
    rows = scores.select(F.col("stream_id").cast("string"), F.col("t").cast("long"), F.col("label").cast("long"), F.col("logp").cast("double"))
    return rows.groupBy("stream_id").applyInPandasWithState(
        lambda k, b, s: _best_so_far(k, b, s, every), "stream_id string, at long, frames long, label long, ll double",
        "n long, labels array<long>, totals array<double>", "append", GroupStateTimeout.NoTimeout)


def session_segments(events: DataFrame, gap: str, late: str | None = None, time: str = "ts", value: str = "value") -> DataFrame:
    """Sessions of (stream_id, time) that a gap closes; on a stream, ``late`` is the watermark beyond which rows are dropped."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy("stream_id", F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("frames"), F.avg(value).alias("mean")).select(
        "stream_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "frames", "mean")


def tumbling_means(events: DataFrame, width: str, slide: str | None = None, late: str | None = None, time: str = "ts", value: str = "value") -> DataFrame:
    """Counts and means in tumbling or sliding windows."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy("stream_id", F.window(time, width, slide or width).alias("w")).agg(F.count(F.lit(1)).alias("frames"), F.avg(value).alias("mean")).select(
        "stream_id", F.col("w.start").alias("begin"), "frames", "mean")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over everything there is into Parquet files and reads them."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
