import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # Names that the operators use themselves.
    T.StructField("id", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("spans", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("h", T.LongType()), T.StructField("at", T.StringType()),
    T.StructField("fp", T.StringType()), T.StructField("words", T.StringType()), T.StructField("slice", T.StringType()),
    T.StructField("starts", T.StringType()), T.StructField("n_lines", T.StringType()), T.StructField("n_removed", T.StringType()),
    T.StructField("n_spans", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("n_hit", T.StringType()),
    T.StructField("items", T.StringType()), T.StructField("bits", T.StringType()), T.StructField("root", T.StringType()),
])


#: Values of the last columns, which no operator may change.
OWN = ("e", "f", "g", "h", "i", "j", "k", "l", "m")


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table of (doc_id, text) pairs, with further columns of clashing names."""

    def make(rows, parts=3):
        full = [(i, t, "en", "src", None if t is None else len(t), "x", "y", "z", 1, 2, "a", "b", "c", "d", *OWN) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


def prose(seed, documents=60, words=160):
    """Texts with copies, near copies, shared passages, repeated lines, nulls, empties and ties."""
    r = random.Random(seed)
    bank = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(400)]

    def some(n):
        out = []
        for i in range(n):
            out.append(r.choice(bank).capitalize() if i % 9 == 0 else r.choice(bank))
            out.append(r.choice([" ", " ", " ", " ", ". ", "\n", "  ", "\t"]))
        return "".join(out)

    shared = [some(60) for _ in range(4)]
    rows = []
    for i in range(documents):
        kind = r.random()
        earlier = [t for _, t in rows if t]
        if kind < 0.1 and earlier:
            text = r.choice(earlier)
        elif kind < 0.3 and earlier:
            w = r.choice(earlier).split(" ")
            w[r.randrange(len(w))] = r.choice(bank)
            text = " ".join(w)
        elif kind < 0.5:
            text = some(r.randint(1, words)) + r.choice(shared) + some(r.randint(0, 40))
        else:
            text = some(r.randint(0, words))
        rows.append((i * 3 - 20, text))
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (None, shared[0]), (1004, "a " * 300),
             (1005, "z" * 900), (5000, some(3000)), rows[5], rows[5], (rows[7][0], rows[9][1])]
    r.shuffle(rows)
    return rows
