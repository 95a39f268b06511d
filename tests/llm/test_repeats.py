"""Repeated bytes and words against brute force, and the two indexes against plain search."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from driftwise.llm import anchors, automata, run_index
from tests.llm.conftest import prose

LOW = -(2**63)


def bytes_brute(rows, window):
    first = {}
    for i, t in rows:
        raw, key = (t or "").encode(), LOW if i is None else i
        for p in range(len(raw) - window + 1):
            w = raw[p:p + window]
            first[w] = min(first.get(w, key), key)
    out = []
    for i, t in rows:
        raw, key = (t or "").encode(), LOW if i is None else i
        gone = [False] * len(raw)
        for p in range(len(raw) - window + 1):
            if first[raw[p:p + window]] < key:
                gone[p:p + window] = [True] * window
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def words_brute(rows, window):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    times = Counter(tuple(w[p:p + window]) for _, w in texts for p in range(len(w) - window + 1))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if times[tuple(w[p:p + window])] > 1:
                gone[p:p + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return Counter(out)


@pytest.mark.parametrize("crowd", [2000, 1])
@pytest.mark.parametrize("seed,window,gram", [(1, 50, 16), (2, 12, 4)])
def test_bytes_as_brute_force(frame, monkeypatch, seed, window, gram, crowd):
    monkeypatch.setattr(anchors, "CROWD", crowd)
    rows = prose(seed)
    got = run_index.dedup_bytes(frame(rows), window, gram).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == bytes_brute(rows, window)


@pytest.mark.parametrize("crowd", [2000, 1])
@pytest.mark.parametrize("seed,window,gram", [(3, 35, 8), (4, 6, 2)])
def test_words_as_brute_force(frame, monkeypatch, seed, window, gram, crowd):
    monkeypatch.setattr(anchors, "CROWD", crowd)
    rows = prose(seed)
    got = automata.dedup_words(frame(rows), window, gram).select("doc_id", "n_words", "n_removed", "kept")
    assert Counter(tuple(r) for r in got.collect()) == words_brute(rows, window)


def test_long_texts_are_cut_without_losing_windows(frame, monkeypatch):
    monkeypatch.setattr(anchors, "CHUNK", 120)
    rows = prose(5, 20)
    got = run_index.dedup_bytes(frame(rows), 20, 6).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == bytes_brute(rows, 20)


def test_different_surroundings_of_one_passage_stay_apart(frame):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join([*(word() for _ in range(20)), passage, *(word() for _ in range(20))])) for i in range(3000)]
    got = run_index.dedup_bytes(frame(rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == bytes_brute(rows, 50)
    got = automata.dedup_words(frame(rows)).select("doc_id", "n_words", "n_removed", "kept")
    assert Counter(tuple(r) for r in got.collect()) == words_brute(rows, 35)


def test_empty_table(frame):
    assert run_index.dedup_bytes(frame([])).count() == 0
    assert automata.dedup_words(frame([])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_run_index_matching_statistics(seed):
    r = random.Random(seed)
    texts = [bytes(r.choice(b"ab") if r.random() < 0.9 else r.choice(b"cd") for _ in range(r.randint(1, 60))) for _ in range(25)]
    owners = np.array([r.randint(0, 9) for _ in texts])
    queries = texts[:5] + [bytes(r.choice(b"abcde") for _ in range(40)) for _ in range(5)] + [b"", b"zzz"]
    index = run_index.RunIndex(texts, owners, 9)
    lengths, _ = index.matching(queries)
    for query, length in zip(queries, lengths):
        for p in range(len(query)):
            best = max(k for k in range(len(query) - p + 1) if k == 0 or any(query[p:p + k] in t for t in texts))
            assert length[p] == best
    for query, (earliest, times) in zip(queries, index.windows(queries)):
        for p in range(len(query) - 8):
            places = [o for t, o in zip(texts, owners) for k in range(len(t) - 8) if t[k:k + 9] == query[p:p + 9]]
            assert times[p] == len(places)
            assert not places or earliest[p] == min(places)


def test_run_index_is_small_for_repetitive_texts():
    r = random.Random(1)
    text = bytes(r.choice(b"abcdefgh") for _ in range(400))
    index = run_index.RunIndex([text + b"!%d" % i for i in range(40)], np.arange(40), 10)
    assert len(index.start) < len(index.text) / 8


@pytest.mark.parametrize("seed", range(4))
def test_automaton_counts_windows(seed):
    r = random.Random(seed)
    texts = [[r.choice("abc") for _ in range(r.randint(0, 40))] for _ in range(12)]
    automaton = automata.SuffixAutomaton(texts)
    for query in [*texts, list("abcabcxabcabc")]:
        got = automaton.stream(query, 4)
        for p in range(len(query) - 3):
            assert got[p] == sum(t[k:k + 4] == query[p:p + 4] for t in texts for k in range(len(t) - 3))
