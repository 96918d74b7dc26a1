"""Encoding of whole texts with a tokenizers file whose pre-tokens never hold white space."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .workers import claim, trim

MARK = "\x01"


class ChunkEncoder:
    """Encodes the distinct blank-separated chunks of many texts once and puts the texts' ids together from them.

    The tokenizer drops white space and no token spans it, so the ids of a text are the ids of its
    chunks in order. Only blank, newline, tab and carriage return separate chunks; any other white
    space stays inside a chunk and is left to the tokenizer. Texts of Latin-1 letters are lower-cased
    first, as the tokenizer does itself, unless they may hold a special token. Full stops and commas
    after a word of letters are pre-tokens of their own, so they are split off.

    Chunks are told apart and texts put together by whole columns. Nothing is remembered from one call to the next, as texts
    hold ever new words; memory is bounded by what a call is given.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        suffix = json.loads(self.tok.to_str())["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), dtype=bool)
        if suffix:
            self.ends[[i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        mark = self.tok.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def plain(self, text: str | None) -> str:
        """The text in chunks with one blank between them, in lower case where that is sure to change no id; null is the empty text."""
        if not text:
            return ""
        if "<|" not in text:
            try:
                text.isascii() or text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ")

    def _each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each chunk, and all ids in a row; one call for each chunk."""
        ids = [x.ids for x in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.array([len(x) for x in ids], dtype=np.int64), np.array([i for x in ids for i in x], dtype=np.uint32)

    def _together(self, chunks: list[str], letters: bool, many: int = 1000) -> tuple[np.ndarray, np.ndarray]:
        """The same for many chunks in one text, whose ids are cut apart again.

        A word of letters alone is one pre-token, whose last token ends a word. Other chunks are set apart by a mark with an id of its own.
        Where the numbers don't agree (folding may give a word further pre-tokens, a chunk may hold the mark), each chunk is encoded by itself.
        """
        sizes, flats = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for lo in range(0, len(chunks), many):
            part = chunks[lo: lo + many]
            if not letters and self.mark is None:
                size, flat = self._each(part)
            else:
                text = (" " if letters else f" {MARK} ").join(part)
                flat = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
                if letters:
                    cuts = np.flatnonzero(self.ends[flat]) + 1
                    size = np.diff(cuts, prepend=0)
                    good = len(cuts) == len(part) and cuts[-1] == len(flat)
                else:
                    cuts = np.flatnonzero(flat == self.mark)
                    size = np.diff(np.concatenate(([-1], cuts, [len(flat)]))) - 1
                    good = len(size) == len(part)
                    flat = flat[flat != self.mark]
                if not good:
                    size, flat = self._each(part)
            sizes.append(size)
            flats.append(flat)
        return np.concatenate(sizes), np.concatenate(flats)

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each distinct chunk, and all ids in a row."""
        base = pc.utf8_rtrim(chunks, characters=".,")
        letters = pc.utf8_is_alpha(base).to_numpy(zero_copy_only=False)
        words = base.filter(pa.array(letters)).dictionary_encode()
        other = chunks.filter(pa.array(~letters))
        # A chunk is two parts: a word and what was trimmed, or all of it and nothing.
        trimmed = (pc.utf8_length(chunks).to_numpy() - pc.utf8_length(base).to_numpy()) * letters
        tails, second = {"": 0}, np.zeros(len(chunks), dtype=np.int64)
        at = np.flatnonzero(trimmed)
        for i, c, k in zip(at.tolist(), chunks.take(pa.array(at)).to_pylist(), trimmed[at].tolist(), strict=True):
            second[i] = tails.setdefault(c[-k:], len(tails))
        parts = [self._together(words.dictionary.to_pylist(), True), self._together(other.to_pylist(), False), self._each(list(tails))]
        size, flat = (np.concatenate([p[x] for p in parts]) for x in (0, 1))
        n_words, n_other = len(words.dictionary), len(other)
        first = np.empty(len(chunks), dtype=np.int64)
        first[letters] = words.indices.to_numpy()
        first[~letters] = n_words + np.arange(n_other)
        both = np.stack([first, n_words + n_other + second], axis=1).ravel()
        return size[both].reshape(-1, 2).sum(1), _gathered(flat, size, both)

    def encode_rows(self, texts: pa.LargeStringArray, most_words: int = 200_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids of these ``plain`` texts in a row, number of each text's ids).

        Chunks are told apart over all texts; ids are put together for about ``most_words`` chunks at a time.
        """
        lists = pc.split_pattern(texts, pattern=" ")
        words = lists.flatten().dictionary_encode()
        size, flat = self._chunk_ids(words.dictionary)
        at, ends = words.indices.to_numpy(), lists.offsets.to_numpy()
        for lo, hi in slices(np.diff(ends).tolist(), most_words):
            some = at[ends[lo]: ends[hi]]
            total = np.concatenate(([0], np.cumsum(size[some])))
            yield lo, hi, _gathered(flat, size, some), np.diff(total[ends[lo: hi + 1] - ends[lo]])

    def encode(self, text: str | None) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        return b"".join(ids.astype("<u4").tobytes() for _, _, ids, _ in self.encode_rows(pa.array([self.plain(text)], pa.large_string())))


def _gathered(flat: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs number ``at`` of runs of ``size`` elements that stand in a row."""
    n = size[at]
    take = np.repeat((np.cumsum(size) - size)[at] - (np.cumsum(n) - n), n)
    take += np.arange(len(take))
    return flat[take]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with one more at each text's end, and the numbers of these."""
    counts = counts + 1
    out = np.empty(len(ids) + len(counts), dtype=np.uint32)
    body = np.ones(len(out), dtype=bool)
    body[np.cumsum(counts) - 1] = False
    out[body] = ids
    out[~body] = end_id
    return out, counts


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum up to about ``most``, or of one row."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def gathered_rows(batches: Iterator[pa.RecordBatch], text_column: int, most_chars: int = 3 << 20,
                  clean: Callable[[str | None], str] = lambda t: t or "") -> Iterator[tuple[pa.Table, pa.LargeStringArray]]:
    """Batches put together until their texts have about ``most_chars`` characters: the other columns, and the texts, made ``clean``.

    Texts are held once, and what a slice has used is given back before the next one.
    """
    held: list[pa.Table] = []
    texts: list[str] = []
    chars = 0
    for whole in batches:
        rest = pa.Table.from_batches([whole]).remove_column(text_column)
        column = list(map(clean, whole.column(text_column).to_pylist()))
        for lo, hi in slices(list(map(len, column)), most_chars):
            held.append(rest.slice(lo, hi - lo))
            texts += column[lo:hi]
            chars += sum(map(len, column[lo:hi]))
            if chars >= most_chars:
                column[:hi] = [None] * hi
                found, texts, chars = pa.array(texts, pa.large_string()), [], 0
                yield pa.concat_tables(held), found
                held, found = [], None
                trim()
    if held:
        found, texts = pa.array(texts, pa.large_string()), []
        yield pa.concat_tables(held), found


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process and file."""
    claim("encoder", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
