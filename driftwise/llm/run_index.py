"""Suffix-array dedup with a run-length index.

The texts are bytes; a window is 50 of them. Where different contexts share an anchor
(see anchors.py), each shard builds a run-compressed Burrows-Wheeler transform of its
contexts: run heads and starts, counts per byte, text positions sampled at both ends
of every run, and per run the smallest document among the suffixes that agree with it
on a whole window. Contexts are streamed backwards through it for matching statistics;
wherever the match is as long as a window, the row's run names the earliest document.

Cases: a null text is an empty one; texts shorter than a window lose nothing; a null
id sorts first; rows of equal id are one document, which is not earlier than itself;
an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from driftwise.llm.anchors import BASE, Rule, covered, marked, mix
from driftwise.llm.common import text_column

WINDOW = 50
GRAM = 16
#: A byte that UTF-8 never uses; it parts the texts.
PART = 0xFF
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys, equal keys alike."""
    order = np.argsort(keys)
    step = np.zeros(len(keys), np.int64)
    step[1:] = np.diff(keys[order]) != 0
    ranks = np.empty(len(keys), np.uint64)
    ranks[order] = np.cumsum(step)
    return ranks


class RunIndex:
    """A run-length Burrows-Wheeler index of texts, each with an owner (a document id)."""

    def __init__(self, texts: list[bytes], owners: np.ndarray, depth: int):
        joined = np.frombuffer(bytes([PART]).join([b"", *texts, b""]), np.uint8)
        self.text, self.depth, n = joined, depth, len(joined)
        owner = np.repeat(np.append(owners, owners.max(initial=0)), [len(t) + 1 for t in texts] + [1])
        order, window = self._sorted(n)
        bwt = joined[order - 1]
        new = np.ones(n, bool)
        new[1:] = (bwt[1:] != bwt[:-1]) | (np.diff(window) != 0)
        self.start = np.flatnonzero(new)
        self.char = bwt[self.start]
        size = np.diff(np.append(self.start, n))
        self.first_at, self.last_at = order[self.start], order[self.start + size - 1]
        group = np.flatnonzero(np.diff(window, prepend=-1))
        of_run = np.searchsorted(group, self.start, "right") - 1
        self.earliest = np.minimum.reduceat(owner[order], group)[of_run]
        self.times = np.diff(np.append(group, n))[of_run]
        by_char = np.argsort(self.char, kind="stable")
        before = np.empty(len(size), np.int64)
        before[by_char] = np.cumsum(size[by_char]) - size[by_char]
        self.jump = before - self.start
        self.size, self.by_char = size, by_char
        self.place = self.char[by_char].astype(np.int64) * len(size) + by_char

    def _sorted(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order, and for each of its rows a number for the first ``depth`` bytes."""
        padded = np.concatenate([self.text, np.zeros(8, np.uint8)])
        held = min(8, self.depth)
        keys = np.zeros(n, np.uint64)
        for i in range(held):
            keys = keys << np.uint64(8) | padded[i:n + i]

        def joined(ranks: np.ndarray, step: int) -> np.ndarray:
            after = np.zeros(n, np.uint64)
            after[:n - step] = ranks[step:] + np.uint64(1)
            return _dense(ranks << np.uint64(32) | after) if step < n else ranks

        ranks, window = _dense(keys), None
        while True:
            if window is None and 2 * held >= self.depth:
                window = joined(ranks, self.depth - held) if self.depth > held else ranks
            if window is not None and int(ranks.max()) == n - 1:
                break
            ranks = joined(ranks, held)
            held *= 2
            if held >= 2 * n:
                break
        order = np.argsort(ranks)
        return order, window[order].astype(np.int64)

    def _agree(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes two text positions share, up to a limit each."""
        same, going, n = np.zeros(len(a), np.int64), most > 0, len(self.text)
        while going.any():
            at = np.flatnonzero(going)
            x, y = a[at] + same[at], b[at] + same[at]
            fits = (x < n) & (y < n)
            fits[fits] = self.text[x[fits]] == self.text[y[fits]]
            same[at[fits]] += 1
            going[at] = fits & (same[at] < most[at])
        return same

    def _neighbours(self, run: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last run of a character before, and the first one after, a run; -1 for none."""
        key = char.astype(np.int64) * len(self.size) + run
        after = np.searchsorted(self.place, key)

        def runs(at: np.ndarray) -> np.ndarray:
            inside = (at >= 0) & (at < len(self.place))
            got = np.full(len(at), -1)
            got[inside] = self.by_char[at[inside]]
            got[inside] = np.where(self.char[got[inside]] == char[inside], got[inside], -1)
            return got

        return runs(after - 1), runs(after)

    def matching(self, queries: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per query and byte: the length of the longest match from there, and a row it starts at.

        All queries go backwards in step. A row keeps its match while the byte before
        it is the one wanted; otherwise the nearer run of that byte takes over, nearer
        meaning by the bytes its sampled position shares with the match.
        """
        sizes = np.array([len(q) for q in queries], np.int64)
        ends = np.cumsum(sizes)
        flat = np.frombuffer(b"".join(queries), np.uint8)
        length, rows = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        row, at, held = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.first_at[0]), np.zeros(len(sizes), np.int64)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            live = np.flatnonzero(sizes >= step)
            char = flat[ends[live] - step]
            run = np.searchsorted(self.start, row[live], "right") - 1
            lost = np.flatnonzero(self.char[run] != char)
            if len(lost):
                who = live[lost]
                low, high = self._neighbours(run[lost], char[lost])
                last, first = self.last_at[low], self.first_at[high]
                limit = held[who]
                a = np.where(low >= 0, self._agree(at[who], last, np.where(low >= 0, limit, 0)), -1)
                b = np.where(high >= 0, self._agree(at[who], first, np.where(high >= 0, limit, 0)), -1)
                up = a >= b
                pick = np.where(up, low, high)
                none = pick < 0
                run[lost] = np.where(none, run[lost], pick)
                row[who] = np.where(up, self.start[pick] + self.size[pick] - 1, self.start[pick])
                at[who] = np.where(up, last, first)
                held[who] = np.maximum(a, b)
                dead = who[none]
                held[dead], row[dead], at[dead] = -1, 0, self.first_at[0]
                moved = np.ones(len(live), bool)
                moved[lost[none]] = False
            else:
                moved = slice(None)
            go, by = live[moved], run[moved]
            row[go] += self.jump[by]
            at[go] -= 1
            held[live] += 1
            length[ends[live] - step], rows[ends[live] - step] = held[live], row[live]
        cuts = ends[:-1]
        return np.split(length, cuts), np.split(rows, cuts)

    def windows(self, queries: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query: (earliest owner, occurrences) of the window at each start; none counts 0."""
        out = []
        never = np.iinfo(np.int64).max
        for length, rows in zip(*self.matching(queries), strict=True):
            many = max(0, len(length) - self.depth + 1)
            run = np.searchsorted(self.start, rows[:many], "right") - 1
            hit = length[:many] >= self.depth
            out.append((np.where(hit, self.earliest[run], never), np.where(hit, self.times[run], 0)))
        return out


def _decide(window: int):
    def run(parts: list, owners: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return RunIndex(parts, owners, window).windows(parts)

    return run


def rule(window: int = WINDOW, gram: int = GRAM) -> Rule:
    return Rule(
        window, gram, True,
        lambda text: BYTES[np.frombuffer(text.encode("utf-8"), np.uint8)],
        lambda text, at, many: F.substring(text.cast("binary"), at.cast("int") + 1, many.cast("int")),
        lambda part, j: F.substring(part, j.cast("int") + 1, F.lit(window)),
        _decide(window))


def _trimmed(window: int):
    @pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    def of(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, runs in zip(texts, spans, strict=True):
            raw = np.frombuffer(text.encode("utf-8"), np.uint8)
            gone = covered(runs, window, len(raw))
            kept = raw[~gone].tobytes()
            removed = int(gone.sum())
            begins = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            rows.append((len(raw), removed, begins, hashlib.sha256(kept).hexdigest(), kept))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return of


def dedup_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs beside n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes: cuts may part a character).

    Columns of docs that have these names give way to them.
    """
    frame = marked(docs, rule(window, gram))
    own = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")]
    out = _trimmed(window)(text_column(frame), F.col("__dw_spans"))
    return frame.select(*[F.col(f"`{c}`") for c in own], out.alias("__dw")).select(*[F.col(f"`{c}`") for c in own], "__dw.*")
