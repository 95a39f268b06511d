"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves.

Paragraphs are lines, leaves are eight words of a paragraph, and a section closes after
a blank paragraph or one whose hash falls in a quarter of the hashes, so that an insertion
moves no later section. Every node hashes its children. Equal roots mean equal texts;
where roots differ, the first differing branch of sections, paragraphs and leaves tells
where. The likeness of two trees is the share of nodes they have in common, counted with
repeats: 1 only for equal roots.

Cases: a null text is an empty one, which has a tree of one empty leaf; rows of equal id
are ordered by text, largest first; a null id comes last; a single document is its own
next one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import ID, id_cuts, keyed, slice_of, tasks, text_column

LEAF_WORDS = 8
#: A paragraph closes its section if the first byte of its hash is below this.
CLOSING = 64
ROWS = 500


def _node(kind: bytes, data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16, person=kind).digest()


class Tree:
    """sections -> paragraphs -> leaves, each a (hash, children) pair but for the leaves."""

    def __init__(self, text: str):
        self.sections: list[tuple[bytes, list]] = []
        held: list[tuple[bytes, list]] = []
        for paragraph in text.split("\n"):
            words = paragraph.split(" ")
            leaves = [_node(b"leaf", " ".join(words[i:i + LEAF_WORDS]).encode("utf-8"))
                      for i in range(0, len(words), LEAF_WORDS)]
            mark = _node(b"paragraph", b"".join(leaves))
            held.append((mark, leaves))
            if not paragraph.strip() or mark[0] < CLOSING:
                self._close(held)
                held = []
        if held:
            self._close(held)
        self.root = _node(b"root", b"".join(mark for mark, _ in self.sections))

    def _close(self, paragraphs: list) -> None:
        self.sections.append((_node(b"section", b"".join(m for m, _ in paragraphs)), paragraphs))

    def nodes(self) -> Counter:
        found = Counter([self.root])
        for mark, paragraphs in self.sections:
            found[mark] += 1
            for inner, leaves in paragraphs:
                found[inner] += 1
                found.update(leaves)
        return found


def likeness(a: Tree, nodes_a: Counter, b: Tree, nodes_b: Counter) -> float:
    if a.root == b.root:
        return 1.0
    common = sum(min(n, nodes_b[k]) for k, n in nodes_a.items() if k in nodes_b)
    return 2 * common / (nodes_a.total() + nodes_b.total())


def first_edit(a: Tree, b: Tree) -> str | None:
    """section.paragraph.leaf of the first branch that differs; none for equal roots."""
    if a.root == b.root:
        return None

    def differing(x: list, y: list) -> int:
        return next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))

    path, x, y = [], a.sections, b.sections
    for deeper in (True, True, False):
        at = differing(x, y)
        path.append(str(at))
        if not deeper or at >= min(len(x), len(y)):
            break
        x, y = x[at][1], y[at][1]
    return ".".join(path)


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, edit_at string")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RESULT.split(", ")]
    schema = pa.schema([(n, {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[c.split()[1]])
                        for n, c in zip(names, RESULT.split(", "), strict=True)])
    before, out = None, []
    for batch in batches:
        for doc, text, ahead in zip(*[batch.column(c) for c in ("doc_id", "text", "ahead")], strict=True):
            text = text.as_py()
            tree = Tree(text)
            nodes = tree.nodes()
            if before:
                doc_before, text_before, own, own_nodes = before
                n = len(text_before)
                half = n // 2
                edited = text_before[:n - half] + text[:half]
                new = Tree(edited)
                out.append((doc_before, n, hashlib.sha256(edited.encode("utf-8")).hexdigest(), own.root.hex(),
                            new.root.hex(), likeness(own, own_nodes, new, new.nodes()),
                            likeness(own, own_nodes, tree, nodes), first_edit(own, new)))
            before = None if ahead.as_py() else (doc.as_py(), text, tree, nodes)
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def compared(docs: DataFrame) -> DataFrame:
    """Every document against its edited text and the next one, in descending order of id.

    Texts are shuffled once, into ranges of ids. Each range also gets the first text of
    the range below it (of the topmost for the lowest), found among one id per range.
    """
    n = tasks(docs.sparkSession)
    frame = keyed(docs).select(ID, "doc_id", text_column(docs).alias("text"))
    cuts = id_cuts(frame, ID, n)
    sliced = frame.withColumn("slice", slice_of(F.col(ID), cuts))
    # One id per range, at most as many as there are tasks.
    heads = sliced.groupBy("slice").agg(F.max(ID).alias("head")).orderBy("slice").collect()
    below = [(row.slice, heads[i - 1].head) for i, row in enumerate(heads)]
    ahead = docs.sparkSession.createDataFrame(below, "slice int, head long")
    first = frame.join(F.broadcast(ahead), F.col(ID) == F.col("head")).groupBy("slice", ID).agg(F.max("text").alias("text"))
    rows = sliced.select("slice", ID, F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(False).alias("ahead")).unionByName(
        first.select("slice", ID, F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("ahead")))
    ordered = rows.repartitionById(n, F.col("slice")).sortWithinPartitions(
        "ahead", F.col(ID).desc(), F.col("text").desc())
    return ordered.select("doc_id", "text", "ahead").mapInArrow(_compared, RESULT)
