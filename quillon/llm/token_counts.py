"""Operator 3: token counts by dynamic programming over a trie of pre-tokens.

Words between white space, each after the mark ``▁``, are the pre-tokens. They are segmented by a unigram
model: of all ways to write a pre-token as vocabulary pieces, the one with the largest sum of log
probabilities counts. Distinct pre-tokens are inserted in a trie. A node stands for a prefix and keeps its best
forward score and the number of pieces that reach it, computed once however many pre-tokens share
it; what a pre-token's last node keeps is its token count, which is stored by pre-token.

The vocabulary is that of a public sentencepiece file, in the order of its ids. The file's model merges
pairs and has no probabilities, and tokenizers are not trained here, so a piece's log probability is that of
its rank by Zipf's law. A character without a piece costs one token for each of its UTF-8 bytes, as with byte fallback,
and ``unknown_score`` once.

Defined results: null and empty texts have no pre-tokens and no tokens; rows that repeat are counted
separately; an empty table gives no rows; other columns are ignored.
Trie and stored counts are bounded: both are emptied at ``max_nodes`` nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .wordbpe import gathered_rows
from .workers import claim, lean

MARK = "▁"


def zipf_vocabulary(model_file: str) -> dict[str, float]:
    """Log probabilities of a sentencepiece file's ordinary pieces, by rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / (k + 2) for k in range(len(pieces))))
    return {p: -math.log(k + 2) - total for k, p in enumerate(pieces)}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CountingTrie:
    """Forward scores by prefix. Nodes are numbers; an edge is found by (node, character)."""

    def __init__(self, vocabulary: dict[str, float], max_nodes: int = 600_000):
        self.vocabulary, self.max_nodes = vocabulary, max_nodes
        self.unknown_score = min(vocabulary.values(), default=0.0) - 10
        # All ends of pieces, with the score of those that are pieces: beyond an unknown end no piece can begin.
        self.ends: dict[str, float | None] = {p[i:]: None for p in vocabulary for i in range(len(p))}
        self.ends.update(vocabulary)
        self._empty()

    def _empty(self) -> None:
        self.edge: dict[tuple[int, str], int] = {}
        self.score, self.pieces = [0.0], [0]
        self.counts: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of a pre-token, inserting it if it is new."""
        known = self.counts.get(word)
        if known is not None:
            return known
        if len(self.score) + len(word) > self.max_nodes:
            self._empty()
        edge, score, pieces, node, path = self.edge, self.score, self.pieces, 0, [0]
        vocabulary, ends = self.vocabulary, self.ends
        for i, c in enumerate(word):
            child = edge.get((node, c))
            if child is None:
                end, best, n = i + 1, None, 0
                # Pieces that end here, the shortest first; a tie goes to the earlier start.
                for lo in range(i, -1, -1):
                    p = ends.get(word[lo:end], False)
                    if p is None:
                        continue
                    if p is False:
                        break
                    s = score[path[lo]] + p
                    if best is None or s >= best:
                        best, n = s, pieces[path[lo]] + 1
                if c not in vocabulary:
                    s = score[node] + self.unknown_score
                    if best is None or s > best:
                        best, n = s, pieces[node] + len(c.encode())
                child = edge[node, c] = len(score)
                score.append(best)
                pieces.append(n)
            node = child
            path.append(node)
        self.counts[word] = pieces[node]
        return pieces[node]


_TRIES: dict[str, CountingTrie] = {}


def _trie(path: str) -> CountingTrie:
    claim("trie", _TRIES.clear)
    if path not in _TRIES:
        _TRIES[path] = CountingTrie(zipf_vocabulary(path))
    return _TRIES[path]


def token_counts(docs: DataFrame, model_file: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_pretokens, n_tokens`` for every document."""
    path = model_file or default_model()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(path)
        for table, texts in gathered_rows(batches, 1, 12 << 20):
            lists = pc.utf8_split_whitespace(texts)
            words = lists.flatten().dictionary_encode()
            distinct = words.dictionary.to_pylist()
            # Each distinct word of some million characters goes to the trie once, in sorted order along shared prefixes.
            tokens = np.zeros(len(distinct), dtype=np.int64)
            for i in sorted(range(len(distinct)), key=distinct.__getitem__):
                tokens[i] = trie.count(MARK + distinct[i]) if distinct[i] else 0
            at, ends = words.indices.to_numpy(), lists.offsets.to_numpy()
            real = np.array([w != "" for w in distinct], dtype=np.int64)  # white space at a text's ends leaves empty words
            sums = [np.diff(np.concatenate(([0], np.cumsum(x[at])))[ends]) for x in (real, tokens)]
            yield pa.RecordBatch.from_arrays([table.column(0).combine_chunks(), *map(pa.array, sums)], names=schema.names)

    return src.mapInArrow(lean(run, "trie"), schema)
