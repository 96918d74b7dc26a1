"""Operator 10: removal of repeated word passages by difference-cover anchors.

A window is ``window`` consecutive words of one document. Words covered by a window whose word sequence also
starts in a document with a smaller id are removed; all windows are judged on the input.

1. Anchors are hashes of ``window - period + 1`` words at the positions of a difference cover modulo
   ``period`` only. Whatever positions two equal windows stand at, some shift below the period
   puts both on a cover position, so they share that anchor.
2. An anchor counts when documents with different texts have it. A window is a candidate when an anchor
   that counts lies at one of its first ``period`` words.
3. Anchors extend: of each candidate's whole window, all words are digested to 128 bits (BLAKE2), and each digest gets the
   smallest id that has it. A candidate with a smaller id than its own document's is removed.
4. Documents whose whole text stands under a smaller id need none of this: with at least one window, all their
   words go.

Nothing emits pairs: anchors and windows are grouped by their hashes with partial aggregates, and rows meet
their groups in joins that adaptive execution splits. Anchors are 64-bit hashes that only choose candidates: a collision there
costs time and changes no result.

Defined results: null and empty texts have no words and keep the empty text; rows with equal ids don't take words from each
other; a null id is smaller and larger than none, so such rows keep all and take nothing; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .wordhash import rolling, text_slices, word_hashes, word_spans
from .workers import lean

WINDOW, PERIOD = 50, 31
#: A perfect difference set modulo 31.
COVER_31 = (1, 5, 11, 24, 25, 27)


def difference_cover(period: int) -> np.ndarray:
    """Residues whose differences take every value modulo the period; found greedily but for 31."""
    if period == 31:
        return np.array(COVER_31)
    chosen, seen = [0], {0}
    while len(seen) < period:
        def gain(x: int) -> int:
            return len({(x - y) % period for y in chosen} | {(y - x) % period for y in chosen}) - len(({(x - y) % period for y in chosen} | {(y - x) % period for y in chosen}) & seen)
        best = max(range(1, period), key=gain)
        seen |= {(best - y) % period for y in chosen} | {(y - best) % period for y in chosen}
        chosen.append(best)
    return np.array(sorted(chosen))


def cover_positions(n: int, period: int, cover: np.ndarray) -> np.ndarray:
    """Cover positions below n, ascending."""
    at = (np.arange(0, n + period, period)[:, None] + cover[None, :]).ravel()
    return at[at < n]


def _documents(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words)."""
    for lo, hi, data, offsets in text_slices(column):
        starts, ends, first = word_spans(data, offsets)
        h = word_hashes(data, starts, ends)
        for i in range(hi - lo):
            yield lo + i, h[int(first[i]): int(first[i + 1])]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), kind))


def words_digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def window_digests(words: list[bytes], starts: np.ndarray, window: int) -> np.ndarray:
    """128 bits of each window's words as two integers; one row for each start."""
    if not len(starts):
        return np.zeros((0, 2), dtype=np.int64)
    line = b" ".join(words)
    at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1))).tolist()
    raw = b"".join([hashlib.blake2b(line[at[s]: at[s + window] - 1], digest_size=16).digest() for s in starts.tolist()])
    return np.frombuffer(raw, dtype="<i8").reshape(-1, 2)


def _anchored(src: DataFrame, window: int, period: int, anchor_bits: int) -> DataFrame:
    """``doc_id, h, h2, n_words, sha, anchors`` of every document."""
    cover, size = difference_cover(period), window - period + 1
    kept = np.uint64((1 << anchor_bits) - 1)
    schema = T.StructType([src.schema["doc_id"], T.StructField("h", T.LongType()), T.StructField("h2", T.LongType()),
                           T.StructField("n_words", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("anchors", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                texts = b.column(3)
                counts, anchors = [], []
                for _, h in _documents(texts):
                    counts.append(len(h))
                    if len(h) < window:
                        anchors.append(np.zeros(0, np.int64))
                    else:
                        anchors.append((rolling(h, size)[cover_positions(len(h) - size + 1, period, cover)] & kept).view(np.int64))
                sha = [words_digest((t or "").encode().split()) for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(counts, pa.int64()), pa.array(sha), _lists(anchors, pa.int64())], names=schema.names)

    return src.select("doc_id", "h", "h2", "text").mapInArrow(lean(run), schema)


def _candidates(found: DataFrame, window: int, period: int) -> DataFrame:
    """``doc_id, h, text, starts, d1, d2`` of the windows that hold a counting anchor; ``found`` has the anchors' numbers ``ks``."""
    cover, size = difference_cover(period), window - period + 1
    schema = T.StructType([found.schema["doc_id"], T.StructField("h", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("starts", T.ArrayType(T.IntegerType())), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("d1", "d2")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                starts, digests = [], []
                for text, ks in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    words = text.encode().split()
                    n = len(words)
                    at = cover_positions(n - size + 1, period, cover)[np.unique(ks)]
                    # Windows that start up to period - 1 words before the anchor.
                    mark = np.zeros(n + 2, dtype=np.int64)
                    np.add.at(mark, np.maximum(at - period + 1, 0), 1)
                    np.add.at(mark, at + 1, -1)
                    s = np.flatnonzero(np.cumsum(mark)[: n - window + 1] > 0)
                    starts.append(s.astype(np.int32))
                    digests.append(window_digests(words, s, window))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _lists(starts, pa.int32()),
                                                  *[_lists([d[:, x] for d in digests], pa.int64()) for x in (0, 1)]], names=schema.names)

    return found.select("doc_id", "h", "text", "ks").mapInArrow(lean(run), schema)


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of the positions."""
    mark = np.zeros(n + window + 1, dtype=np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, np.asarray(starts) + window, -1)
    return np.cumsum(mark)[:n] > 0


def _cut(rows: DataFrame, window: int) -> DataFrame:
    """``doc_id, h, n_removed, kept_text, kept_sha256`` of documents with removed windows ``gone``."""
    schema = T.StructType([rows.schema["doc_id"], T.StructField("h", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                n, kept, sha = [], [], []
                for text, gone in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    words = text.encode().split()
                    out = covered(np.array(gone), len(words), window)
                    left = [w for w, o in zip(words, out.tolist(), strict=True) if not o]
                    n.append(int(out.sum()))
                    kept.append(b" ".join(left).decode())
                    sha.append(words_digest(left))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(kept, pa.string()), pa.array(sha)], names=schema.names)

    return rows.select("doc_id", "h", "text", "gone").mapInArrow(lean(run), schema)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD,
                   anchor_bits: int = 64) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` for every document.

    ``kept_text`` has the kept words joined by one blank where words were removed, and is null elsewhere. Fewer
    ``anchor_bits`` make more candidates; tests use that to force collisions.
    """
    if not 0 < period < window:
        raise ValueError("the period must be smaller than the window")
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), F.xxhash64(text, F.lit(1)).alias("h2"), text.alias("text"))
    base = written(_anchored(src, window, period, anchor_bits), "anchors")
    # Equal texts: all but the smallest id go whole, and only that row's windows are looked at.
    copies = base.where("n_words >= %d and doc_id is not null" % window).groupBy("h", "h2").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = written(copies.select(F.col("h").alias("ch"), F.col("h2").alias("ch2"), "low"), "copies")
    marked = base.join(copies, (F.col("h") == F.col("ch")) & (F.col("h2") == F.col("ch2")), "left")
    single = marked.where("doc_id is not null and (low is null or low = doc_id)")
    shared = base.where("doc_id is not null").select(F.explode("anchors").alias("anchor"), "h").groupBy("anchor").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    shared = written(shared.where("lo <> hi").select("anchor"), "shared-anchors")
    at = single.select("doc_id", "h", F.posexplode("anchors").alias("k", "anchor")).join(shared.hint("shuffle_hash"), "anchor", "left_semi")
    at = written(at.groupBy("doc_id", "h").agg(F.collect_set("k").alias("ks")), "anchor-numbers", shared)
    found = src.select("doc_id", "h", "text").join(at.select(F.col("doc_id").alias("d2"), F.col("h").alias("g2"), "ks").hint("shuffle_hash"),
                                                   (F.col("doc_id") == F.col("d2")) & (F.col("h") == F.col("g2")))
    pending = written(_candidates(found, window, period), "candidates", at)
    wins = pending.select("doc_id", "h", F.explode(F.arrays_zip("starts", "d1", "d2")).alias("w")).select("doc_id", "h", F.col("w.starts").alias("s"), "w.d1", "w.d2")
    first = wins.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("d1", "d2", "first")
    # Written, so that the join deals both sides itself and can split a hot window.
    first = written(first, "first-windows")
    gone = wins.join(first.hint("shuffle_hash"), ["d1", "d2"]).where("first < doc_id")
    gone = written(gone.groupBy("doc_id", "h").agg(F.collect_set("s").alias("gone")), "removed-windows", first)
    cut = pending.select("doc_id", "h", "text").join(gone.select(F.col("doc_id").alias("d2"), F.col("h").alias("g2"), "gone").hint("shuffle_hash"),
                                                     (F.col("doc_id") == F.col("d2")) & (F.col("h") == F.col("g2")))
    # A repeated row has its windows once.
    cut = written(_cut(cut.dropDuplicates(["doc_id", "h"]) if _repeats(base) else cut, window).select(
        F.col("doc_id").alias("d2"), F.col("h").alias("g2"), "n_removed", "kept_text", "kept_sha256"), "kept-words", pending, gone)
    out = marked.select("doc_id", "h", "n_words", "sha", (F.col("low") < F.col("doc_id")).alias("copy"))
    out = out.join(cut, (F.col("doc_id") == F.col("d2")) & (F.col("h") == F.col("g2")), "left")
    all_gone, none = F.coalesce("copy", F.lit(False)), F.lit("")
    return out.select(
        "doc_id", "n_words", F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.sha2(none, 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(all_gone, none).otherwise(F.col("kept_text")).alias("kept_text"))


def _repeats(base: DataFrame) -> bool:
    """Whether a row repeats the id and text of another."""
    return not base.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
