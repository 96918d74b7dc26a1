"""Features from sampled sound: windows, spectra, mel banks, cepstra, deltas.

A window's features depend on its own samples only, so sound is cut into windows with Spark expressions and each Arrow batch of
windows goes through numpy at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.vectors import read_pcm

RATE, WINDOW, HOP, BINS, MELS = 16_000, 512, 160, 256, 24
MEL_LOW, MEL_HIGH, MEL_HIGH_NARROW = 94.0, 6438.0, 3800.0
WARP_START, WARP_STEP, WARPS = 0.80, 0.04, 11


@dataclass(frozen=True)
class FeatureOptions:
    cepstra: int = 12
    energy: bool = True
    zero_crossings: bool = False
    warp: float = 1.0
    root10: bool = False
    narrow: bool = False
    only_mel: bool = False


def warp_factor(step: int) -> float:
    """SIG-13: warp factor of a step 0..10; 5 is neutral."""
    return WARP_START + WARP_STEP * step


def mel_edges(warp: float = 1.0, narrow: bool = False) -> np.ndarray:
    """First FFT bin of each of the bank's 26 edges, for warped frequencies."""
    mel = lambda f: 2595.0 * np.log10(1.0 + f / 700.0)
    low, high = mel(MEL_LOW), mel(MEL_HIGH_NARROW if narrow else MEL_HIGH)
    step = (high - low) / (MELS + 1.0)
    at = mel(8000.0 * np.arange(BINS) / BINS * warp)
    edges, k = [], 0
    for i in range(BINS):
        if k < MELS + 2 and at[i] >= step * k + low:
            edges.append(i)
            k += 1
    return np.array(edges + [BINS - 1] * (MELS + 2 - len(edges)))


def mel_matrix(warp: float = 1.0, narrow: bool = False) -> np.ndarray:
    """SIG-8: triangular filters as a (bins, mels) matrix."""
    e = mel_edges(warp, narrow)
    out = np.zeros((BINS, MELS))
    for a in range(MELS):
        up, down = e[a + 1] - e[a], e[a + 2] - e[a + 1]
        for i in range(up):
            out[e[a] + i, a] += i / up
        for i in range(down + 1):
            if down:
                out[e[a + 1] + i, a] += (down - i) / down
    return out


def centred(samples: np.ndarray) -> np.ndarray:
    """SIG-1: windows (n, 512) less their means."""
    x = samples.astype(np.float64)
    return x - x.mean(1, keepdims=True)


def emphasised(x: np.ndarray) -> np.ndarray:
    """SIG-2: each sample less 0.97 of the one before it; the first stays."""
    y = x.copy()
    y[:, 1:] -= 0.97 * x[:, :-1]
    return y


def tapered(x: np.ndarray) -> np.ndarray:
    """SIG-3: a Hamming window."""
    return x * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(WINDOW) / (WINDOW - 1)))


def magnitudes(x: np.ndarray) -> np.ndarray:
    """SIG-6: the lower half of the spectrum, over the window's length."""
    return np.abs(np.fft.rfft(x, axis=1))[:, :BINS] / WINDOW


def compressed(mel: np.ndarray, root10: bool) -> np.ndarray:
    """SIG-9."""
    return mel ** 0.1 if root10 else np.log10(1.0 + mel)


def cosines(mel: np.ndarray, cepstra: int) -> np.ndarray:
    """SIG-10: cepstra of the compressed bank; SIG-11, a lifter of length 0, changes nothing."""
    i, j = np.arange(1, cepstra + 1)[:, None], np.arange(MELS)[None, :]
    return mel @ np.cos(np.pi * i / MELS * (j + 0.5)).T


def window_features(samples: np.ndarray, o: FeatureOptions = FeatureOptions()) -> np.ndarray:
    """SIG-1 to SIG-11 for windows (n, 512): cepstra, then log energy, then zero crossings and strong bins."""
    x = centred(samples)
    crossings = ((x[:, :-1] < 0) & (x[:, 1:] >= 0)).sum(1)
    y = tapered(emphasised(x))
    energy = np.log10(1.0 + (y * y).sum(1))
    spectrum = magnitudes(y)
    strong = (spectrum > spectrum.max(1, keepdims=True) / 2).sum(1)
    mel = spectrum @ mel_matrix(o.warp, o.narrow)
    if o.only_mel:
        return mel
    parts = [cosines(compressed(mel, o.root10), o.cepstra)]
    if o.energy:
        parts.append(energy[:, None])
    if o.zero_crossings:
        parts += [crossings[:, None], strong[:, None]]
    return np.concatenate(parts, axis=1)


def windows(pcm: DataFrame) -> DataFrame:
    """``stream_id, t, samples``: windows of 512 samples every 160 of (stream_id, pcm array<int>); what is too short for one is left out."""
    # Not a filter, as that would go below what deals sounds out and make each sound a second time there.
    starts = F.when(F.size("pcm") >= WINDOW, F.sequence(F.lit(0).cast("long"), F.floor((F.size("pcm") - WINDOW) / HOP)))
    rows = pcm.select("stream_id", "pcm", F.explode_outer(starts).alias("t")).where("t is not null")
    return rows.select("stream_id", "t", F.slice("pcm", (F.col("t") * HOP + 1).cast("int"), WINDOW).alias("samples"))


def per_window(pcm: DataFrame, compute: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``stream_id, t, vec``: what ``compute`` makes of each window, many windows at once."""
    rows = windows(pcm)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            # Windows are of one length, so the batch's samples are one matrix, and so is what comes of them.
            for lo in range(0, batch.num_rows, 1_000):
                part = batch.slice(lo, 1_000)
                vec = np.asarray(compute(part.column("samples").flatten().to_numpy().reshape(-1, WINDOW)), dtype=np.float64)
                ends = pa.array(np.arange(len(vec) + 1, dtype=np.int32) * vec.shape[1])
                yield pa.RecordBatch.from_arrays([part.column("stream_id"), part.column("t"), pa.ListArray.from_arrays(ends, pa.array(vec.ravel()))], ["stream_id", "t", "vec"])

    return rows.mapInArrow(run, f"stream_id {rows.schema['stream_id'].dataType.simpleString()}, t long, vec array<double>")


def extract(pcm: DataFrame, options: FeatureOptions = FeatureOptions()) -> DataFrame:
    """SIG-16: ``stream_id, t, vec`` for every window."""
    return per_window(pcm, lambda samples: window_features(samples, options))


def listed_pcm(spark: SparkSession, list_path: str) -> DataFrame:
    """SIG-16: the raw files that a list file names, one path at the start of each line."""
    named = [r.audio for r in spark.read.text(list_path).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+")[0].alias("audio")).toLocalIterator()]
    return read_pcm(spark, named) if named else read_pcm(spark, list_path).limit(0)


def initial_statistics(features: DataFrame, frames: int = 100) -> DataFrame:
    """SIG-16: mean and deviation of each dimension over a stream's first ``frames`` frames: ``stream_id, d, mean, dev``.

    They normalise an unbounded source until more is known.
    """
    rows = features.where(F.col("t") < frames).select("stream_id", F.posexplode("vec").alias("d", "x"))
    return rows.groupBy("stream_id", "d").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("dev"))


def deltas(frames: DataFrame, size: int | None = None) -> DataFrame:
    """SIG-15: appends slopes sum(i (x[t+i] - x[t-i])) / 5, i = 1, 2; edge frames copy the slope of the second frame inside.

    ``size`` limits the slopes to the last elements of the vector, which gives slopes of slopes on a second call.
    """
    w = Window.partitionBy("stream_id").orderBy("t")
    part = F.col("vec") if size is None else F.slice("vec", -size, size)
    diff = lambda a, b, k: F.zip_with(a, b, lambda x, y: (x - y) * k)
    rows = frames.withColumn("_v", part)
    raw = F.zip_with(diff(F.lead("_v", 1).over(w), F.lag("_v", 1).over(w), 1), diff(F.lead("_v", 2).over(w), F.lag("_v", 2).over(w), 2), lambda x, y: (x + y) / 5.0)
    rows = rows.withColumn("_d", raw)
    ahead, behind = Window.partitionBy("stream_id").orderBy("t").rowsBetween(0, 2), Window.partitionBy("stream_id").orderBy("t").rowsBetween(-2, 0)
    d = F.coalesce("_d", F.first("_d", ignorenulls=True).over(ahead), F.last("_d", ignorenulls=True).over(behind))
    return rows.select("stream_id", "t", F.concat("vec", d).alias("vec"))
