"""Token-passing recognition over a pronunciation trie with a back-off bigram model, one utterance for each group.

Covers the decoder's start state, the step of each frame (stay or move on in a state chain, enter the next node, leave a word with its
language score), recombination by state and history, the beams, the choice of the final token and the traceback.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Search:
    """Decoder settings; ``grammar`` limits which word may follow which (null: any)."""

    states: int = 3
    log_self: float = -0.2
    log_next: float = -1.7
    lm_scale: float = 27.5
    word_penalty: float = 0.0
    beam: float = 200.0
    state_beam: float = 75.0
    end_beam: float = 50.0
    limit: int = 35_000
    start: str = "<s>"
    grammar: frozenset | None = None
    must_end: frozenset = field(default_factory=frozenset)


class Lexicon:
    """Trie of pronunciations as arrays: each node's phone, children by node, and the words that end there."""

    def __init__(self, words: list[tuple[str, tuple[str, ...]]]):
        self.phone: list[str | None] = [None]
        self.children: list[dict[str, int]] = [{}]
        self.words: list[list[str]] = [[]]
        for word, phones in sorted(words):
            node = 0
            for p in phones:
                if p not in self.children[node]:
                    self.children[node][p] = len(self.phone)
                    self.phone.append(p)
                    self.children.append({})
                    self.words.append([])
                node = self.children[node][p]
            self.words[node].append(word)


class Bigram:
    """Natural-log scores from base-10 tables."""

    def __init__(self, uni: dict[str, tuple[float, float]], bi: dict[tuple[str, str], float]):
        self.uni, self.bi = uni, bi

    def __call__(self, before: str, word: str) -> float:
        p = self.bi.get((before, word))
        if p is None:
            p = self.uni.get(before, (0.0, 0.0))[1] + self.uni.get(word, (-99.0, 0.0))[0]
        return p * np.log(10)


def decode(score, frames: int, lexicon: Lexicon, lm: Bigram, o: Search) -> list[tuple[str, int, int, float, float]]:
    """Best words as (word, first, last, am, lm); ``score(t, phone, state)`` is a log density. Empty if nothing reaches the end.

    A token is (total, am, lm, link); a link is (word, end, am, lm, previous link), shared by all that follow it.
    """
    # Entering a tree: tokens that wait to enter its first nodes, by history.
    waiting = {o.start: (0.0, 0.0, 0.0, None)}
    active: dict[tuple[int, int, str], tuple] = {}
    last = o.states - 1
    for t in range(frames):
        new: dict[tuple[int, int, str], tuple] = {}

        def offer(key: tuple[int, int, str], token: tuple, new=new) -> None:
            old = new.get(key)
            if old is None or token[0] > old[0]:
                new[key] = token

        for (node, state, hist), (total, am, lms, link) in active.items():
            offer((node, state, hist), (total + o.log_self, am + o.log_self, lms, link))
            if state < last:
                offer((node, state + 1, hist), (total + o.log_next, am + o.log_next, lms, link))
            else:
                for child in lexicon.children[node].values():
                    offer((child, 0, hist), (total + o.log_next, am + o.log_next, lms, link))
        for hist, token in waiting.items():
            for child in lexicon.children[0].values():
                offer((child, 0, hist), token)
        active = {k: (x[0] + (s := score(t, lexicon.phone[k[0]], k[1])), x[1] + s, x[2], x[3]) for k, x in new.items()}
        active = _pruned(active, o)
        waiting = _exits(active, t, lexicon, lm, o, last)
    ends = [x for h, x in waiting.items() if not o.must_end or h in o.must_end]
    if not ends:
        return []
    # Traceback from the best final token.
    link, out = max(ends, key=lambda x: x[0])[3], []
    while link is not None:
        word, end, am, lms, before = link
        first = before[1] + 1 if before else 0
        out.append((word, first, end, am - (before[2] if before else 0.0), lms - (before[3] if before else 0.0)))
        link = before
    return out[::-1]


def _pruned(active: dict, o: Search) -> dict:
    """The frame's beam, each node's state beam and the limit on all tokens."""
    if not active:
        return active
    best = max(x[0] for x in active.values())
    own: dict[tuple[int, int], float] = {}
    for (node, state, _), x in active.items():
        own[node, state] = max(own.get((node, state), -np.inf), x[0])
    kept = {k: x for k, x in active.items() if x[0] > max(best - o.beam, own[k[0], k[1]] - o.state_beam)}
    if len(kept) > o.limit:
        kept = dict(sorted(kept.items(), key=lambda kv: (-kv[1][0], kv[0]))[: o.limit])
    return kept


def _exits(active: dict, t: int, lexicon: Lexicon, lm: Bigram, o: Search, last: int) -> dict:
    """Tokens that leave a word at frame t, the best for each new history."""
    found: dict[str, tuple] = {}
    for (node, state, hist), (total, am, lms, link) in active.items():
        if state != last:
            continue
        for word in lexicon.words[node]:
            if o.grammar is not None and (hist, word) not in o.grammar:
                continue
            gain = o.lm_scale * lm(hist, word) - o.word_penalty
            token = (total + o.log_next + gain, am + o.log_next, lms + gain)
            if word not in found or token[0] > found[word][0]:
                found[word] = (*token, (word, t, token[1], token[2], link))
    if not found:
        return found
    best = max(x[0] for x in found.values())
    return {h: x for h, x in found.items() if x[0] > best - o.end_beam}


def recognise(scores: DataFrame, lexicon: list[tuple[str, tuple[str, ...]]], lm: Bigram, options: Search = Search()) -> DataFrame:
    """``utt, ord, word, first, last, am, lm`` of each utterance of (utt, t, phone, state, logp).

    The lexicon and the model go to each task; they are dictionaries of words, not data that grows with the utterances.
    """
    tree = Lexicon(lexicon)

    def run(pdf):
        import pandas as pd

        table = pdf.pivot_table(index="t", columns=["phone", "state"], values="logp").sort_index()
        at = {c: i for i, c in enumerate(table.columns)}
        values = table.to_numpy()
        words = decode(lambda t, p, s: values[t, at[p, s]] if (p, s) in at else -1000.0, len(values), tree, lm, options)
        t0 = int(table.index[0])
        rows = [(pdf["utt"].iloc[0], i, w, t0 + a, t0 + b, am, lms) for i, (w, a, b, am, lms) in enumerate(words)]
        return pd.DataFrame(rows, columns=["utt", "ord", "word", "first", "last", "am", "lm"])

    rows = scores.select(F.col("utt").cast("string"), F.col("t").cast("long"), "phone", F.col("state").cast("long"), F.col("logp").cast("double"))
    return rows.groupBy("utt").applyInPandas(run, "utt string, ord long, word string, first long, last long, am double, lm double")
