"""Substring dedup with suffix automata of reference shards.

The units are words; a window is 35 of them, and one that occurs anywhere else is
removed. Where different contexts share an anchor (see anchors.py), they form the
reference shard of that anchor: a suffix automaton is built of them in the shard's task
and the contexts are streamed through it for matching statistics. The automata go with
the shuffle key and are not broadcast, since all reference shards together grow with
the corpus and each context can only match those of its own anchor.

Cases: a null text has no words; texts shorter than a window lose nothing; a document
given twice repeats itself and loses every window; a null id counts like any other; an
empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from driftwise.llm.anchors import Rule, covered, marked
from driftwise.llm.common import text_column

WINDOW = 35
GRAM = 8


class SuffixAutomaton:
    """A suffix automaton of several sequences, with the occurrences of every state."""

    def __init__(self, sequences: list[list]):
        self.next: list[dict] = [{}]
        self.link, self.length, self.times = [-1], [0], [0]
        for sequence in sequences:
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)
                self.times[last] += 1
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for state in order:
            self.times[self.link[state]] += self.times[state]

    def _clone(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        self.times.append(0)
        return len(self.length) - 1

    def _redirect(self, state: int, symbol, old: int, new: int) -> None:
        while state >= 0 and self.next[state].get(symbol) == old:
            self.next[state][symbol] = new
            state = self.link[state]

    def _split(self, state: int, symbol) -> int:
        """The state reached by the symbol, with just one symbol more than this state's longest."""
        to = self.next[state][symbol]
        if self.length[to] == self.length[state] + 1:
            return to
        copy = self._clone(to, self.length[state] + 1)
        self.link[to] = copy
        self._redirect(state, symbol, to, copy)
        return copy

    def _extend(self, last: int, symbol) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol)
        new = len(self.length)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        self.times.append(0)
        state = last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, symbol)
        return new

    def stream(self, sequence: list, window: int) -> np.ndarray:
        """Occurrences of the window that starts at each place, 0 where there is none."""
        times = np.zeros(max(0, len(sequence) - window + 1), np.int64)
        state = held = 0
        for end, symbol in enumerate(sequence):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                held = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                held += 1
            while held >= window and self.length[self.link[state]] >= window:
                state = self.link[state]
                held = self.length[state]
            if held >= window:
                times[end - window + 1] = self.times[state]
        return times


def _decide(window: int):
    def run(parts: list, owners: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        automaton = SuffixAutomaton(parts)
        found = [automaton.stream(p, window) for p in parts]
        return [(np.zeros(len(t), np.int64), t) for t in found]

    return run


def _hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8").split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def rule(window: int = WINDOW, gram: int = GRAM) -> Rule:
    return Rule(
        window, gram, False, _hashes,
        lambda text, at, many: F.slice(_words(text), at.cast("int") + 1, many.cast("int")),
        lambda part, j: F.slice(part, j.cast("int") + 1, window),
        _decide(window))


def _trimmed(window: int):
    @pandas_udf("n_words long, n_removed long, kept string")
    def of(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, runs in zip(texts, spans, strict=True):
            words = text.encode("utf-8").split()
            gone = covered(runs, window, len(words))
            removed = int(gone.sum())
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if removed else words
            rows.append((len(words), removed, b" ".join(kept).decode("utf-8")))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    return of


def dedup_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs beside n_words, n_removed and kept, the words left, joined by single spaces.

    Columns of docs that have these names give way to them.
    """
    frame = marked(docs, rule(window, gram))
    own = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    out = _trimmed(window)(text_column(frame), F.col("__dw_spans"))
    return frame.select(*[F.col(f"`{c}`") for c in own], out.alias("__dw")).select(*[F.col(f"`{c}`") for c in own], "__dw.*")
