"""Secret scans: three fixed shapes, and two character Markov models held against each other.

The models are chains over ASCII characters (all others are one): one of random strings,
trained from the values that the fixed shapes find, and one of ordinary identifiers,
trained from all other text. Counts are merged per batch and summed by Spark; there are
at most 2 x 128 x 128 of them. A token of 20 or more characters, with a digit and outside
every fixed span, is a secret too if the log-likelihood ratio passes the threshold.

Cases: a null text is an empty one; without any labelled value the random model is
uniform over token characters; repeated rows are scanned each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from driftwise.llm.common import saved, text_column

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
DIGIT = re.compile(r"[0-9]")
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
#: Log-likelihood ratio, in nats, from which a token counts as random.
THRESHOLD = 12.0
#: Steps that the smoothing counts for, per character before them.
PRIOR = 20.0
STATES = 128
TOKEN_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed shapes, leftmost and non-overlapping per kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def states(text: str) -> np.ndarray:
    """Characters as states; all non-ASCII ones are the last."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), STATES - 1).astype(np.int64)


def pairs(text: str) -> np.ndarray:
    chain = states(text)
    return chain[:-1] * STATES + chain[1:]


def values(text: str, spans: list[tuple[int, int, str]]) -> list[str]:
    """The random parts of fixed spans: what is assigned, and keys whole."""
    return [ASSIGN.match(text[a:b])[2] if kind == "assign" else text[a:b] for a, b, kind in spans]


def pair_counts(docs: DataFrame) -> DataFrame:
    """(random, pair, n) over every text: labelled values, and all else."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = STATES * STATES
        for batch in batches:
            total = np.zeros((2, size), np.int64)
            for text in batch.column("text"):
                text = text.as_py()
                every = np.bincount(pairs(text), minlength=size) if len(text) > 1 else np.zeros(size, np.int64)
                for value in values(text, base_spans(text)):
                    part = np.bincount(pairs(value), minlength=size)
                    total[1] += part
                    every = every - part
                total[0] += np.maximum(every, 0)
            kind, pair = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind.astype(np.int64)), pa.array(pair), pa.array(total[kind, pair])], names=["random", "pair", "n"])

    parts = docs.select(text_column(docs).alias("text")).mapInArrow(count, "random long, pair long, n long")
    return parts.groupBy("random", "pair").agg(F.sum("n").alias("n"))


def ratio_table(random: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """log P_random - log P_ordinary of every step between states.

    Steps are smoothed towards how often a character comes at all: in ordinary text as
    counted, in random strings alike for all token characters.
    """
    even = np.full(STATES, 1e-3)
    even[[ord(c) for c in TOKEN_CHARACTERS]] = 1.0

    def logs(counts: np.ndarray, single: np.ndarray) -> np.ndarray:
        table = counts.reshape(STATES, STATES) + PRIOR * single / single.sum()
        return np.log(table / table.sum(1, keepdims=True))

    return (logs(random, even) - logs(ordinary, ordinary.reshape(STATES, STATES).sum(0) + 0.5)).reshape(-1)


def random_spans(text: str, taken: list[tuple[int, int, str]], ratio: np.ndarray, threshold: float = THRESHOLD):
    out = []
    for m in TOKEN.finditer(text):
        if DIGIT.search(m[0]) and not any(a < m.end() and m.start() < b for a, b, _ in taken):
            if float(ratio[pairs(m[0])].sum()) > threshold:
                out.append((m.start(), m.end(), "random"))
    return out


def _told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every row's doc_id with its spans and their digest."""
    counts = saved(pair_counts(docs), "pairs").toPandas()
    both = np.zeros((2, STATES * STATES))
    both[counts["random"].to_numpy(), counts["pair"].to_numpy()] = counts["n"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(ratio_table(both[1], both[0]))

    @pandas_udf("n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base = base_spans(text)
            every = sorted(base + random_spans(text, base, shared.value, threshold), key=lambda s: (s[0], KINDS.index(s[2])))
            kinds = [s[2] for s in every]
            rows.append((*[kinds.count(k) for k in KINDS], hashlib.sha256(_told(base).encode()).hexdigest(), _told(every)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), found(text_column(docs)).alias("found")).select("doc_id", "found.*")
