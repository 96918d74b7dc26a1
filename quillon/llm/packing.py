"""Operator 4: packing token sequences by the sum-of-squares rule.

Every document is encoded, ended with ``end_id`` and cut into full windows plus one remainder. A
remainder goes online to the fill level that makes the sum of squared counts of partially filled
windows smallest; the counts stand in an array by level. Windows that are still open when a task
ends, or when more than ``max_open`` are open, are topped up: pieces cut from the emptiest windows
fill the fullest, until one window is left. The last window of a task is written as sequences whose
lengths are powers of two, which need no padding.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed
separately; an empty table gives no rows; other columns are ignored; ids may be null.
Each task packs its own rows, so nothing is shuffled and a lost task is simply run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .wordbpe import default_tokenizer, encoder, gathered_rows, with_end
from .workers import lean

CAPACITY = 2048


class SquaresPacker:
    """Online packer of one task. ``add`` and ``close`` return finished sequences.

    A sequence is a list of pieces (key, start, ids as bytes, document's token count).
    """

    def __init__(self, capacity: int = CAPACITY, max_open: int = 2048):
        self.capacity, self.max_open = capacity, max_open
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.at: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.open = 0

    def level_for(self, size: int) -> int:
        """Fill level (0: a new window) where an item of this size adds least; ties go to the fullest."""
        cap, n = self.capacity, self.count
        room = cap - size
        if room <= 0:
            return 0
        grown = 2 * n[size: cap + 1] + 1          # level h becomes h + size
        grown[-1] = 0                             # a full window is no longer partial
        change = grown.copy()
        change[1:] += 1 - 2 * n[1: room + 1]
        usable = n[: room + 1] > 0
        usable[0] = True
        change[~usable] = np.iinfo(np.int64).max
        return room - int(np.argmin(change[::-1]))

    def _put(self, window: list, level: int) -> None:
        self.at[level].append(window)
        self.count[level] += 1
        self.open += 1

    def add(self, key, ids: bytes) -> list[list]:
        cap, total = self.capacity, len(ids) // 4
        whole = total - total % cap
        done = [[(key, i, ids[4 * i: 4 * (i + cap)], total)] for i in range(0, whole, cap)]
        size = total - whole
        if size:
            level = self.level_for(size)
            window: list = []
            if level:
                window = self.at[level].pop()
                self.count[level] -= 1
                self.open -= 1
            window.append((key, whole, ids[4 * whole:], total))
            if level + size == cap:
                done.append(window)
            else:
                self._put(window, level + size)
        if self.open > self.max_open:
            done += self._top_up()
        return done

    def _top_up(self) -> list[list]:
        """Fills the fullest windows with cuts from the emptiest; at most one stays open."""
        cap, done = self.capacity, []
        levels = [(h, w) for h in range(1, cap) for w in self.at[h]]
        lo, hi = 0, len(levels) - 1
        self.at = [[] for _ in range(cap + 1)]
        self.count[:] = 0
        self.open = 0
        while lo < hi:
            fill, window = levels[hi]
            have, donor = levels[lo]
            need = cap - fill
            while need and donor:
                key, start, ids, total = donor.pop()
                n = len(ids) // 4
                take = min(n, need)
                window.append((key, start + n - take, ids[4 * (n - take):], total))
                if take < n:
                    donor.append((key, start, ids[: 4 * (n - take)], total))
                need -= take
                have -= take
            if need:
                levels[hi] = (cap - need, window)
                lo += 1
            else:
                done.append(window)
                hi -= 1
                if donor:
                    levels[lo] = (have, donor)
                else:
                    lo += 1
        if lo == hi and levels[lo][1]:
            self._put(levels[lo][1], levels[lo][0])
        return done

    def close(self) -> list[list]:
        done = self._top_up()
        last = next((w[0] for w in self.at if w), [])
        fill = sum(len(p[2]) for p in last) // 4
        for bit in reversed(range(fill.bit_length())):
            size, part = 1 << bit, []
            if not fill & size:
                continue
            while size:
                key, start, ids, total = last.pop(0)
                take = min(size, len(ids) // 4)
                part.append((key, start, ids[: 4 * take], total))
                if 4 * take < len(ids):
                    last.insert(0, (key, start + take, ids[4 * take:], total))
                size -= take
            done.append(part)
        self.at = [[] for _ in range(self.capacity + 1)]
        self.count[:] = 0
        self.open = 0
        return done


def _schema(id_type: T.DataType, with_ids: bool) -> T.StructType:
    s = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType())])
    return s.add("ids", T.ArrayType(T.IntegerType())) if with_ids else s


def pack(docs: DataFrame, tokenizer_path: str | None = None, *, capacity: int = CAPACITY, end_id: int = 1,
         id_col: str = "doc_id", text_col: str = "text", max_open: int = 2048, with_ids: bool = True,
         slice_chars: int = 3 << 20) -> DataFrame:
    """Packs the documents; one row for each piece, with its token ids unless ``with_ids`` is off.

    ``sequence_id`` is the task's number times 2**32 plus a running number, so it is unique and has gaps. Distinct words are encoded
    once in about ``slice_chars`` characters: more take less time and more memory, about 15 bytes each.
    """
    path = tokenizer_path or default_tokenizer()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, packer = encoder(path), SquaresPacker(capacity, max_open)
        number = TaskContext.get().partitionId() << 32
        kind = None
        rows: list[tuple] = []

        def emit(done: list[list]) -> None:
            nonlocal number
            for window in done:
                offset = 0
                for key, start, ids, total in window:
                    n = len(ids) // 4
                    row = (key, start, n, zlib.crc32(ids), total, number, offset)
                    rows.append((*row, np.frombuffer(ids, dtype="<i4")) if with_ids else row)
                    offset += n
                number += 1

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = [kind, *[pa.int64()] * 6] + [pa.list_(pa.int32())] * with_ids
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for table, texts in gathered_rows(batches, 1, slice_chars, enc.plain):
            kind, keys = table.column(0).type, table.column(0).to_pylist()
            for lo, hi, ids, n in enc.encode_rows(texts):
                ids, n = with_end(ids, n, end_id)
                raw, at = ids.astype("<u4").tobytes(), 0
                for key, size in zip(keys[lo:hi], n.tolist(), strict=True):
                    emit(packer.add(key, raw[4 * at: 4 * (at + size)]))
                    at += size
                    if len(rows) >= 1000:
                        yield batch()
        emit(packer.close())
        if rows:
            yield batch()

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(lean(run, "encoder"), _schema(src.schema[0].dataType, with_ids))
