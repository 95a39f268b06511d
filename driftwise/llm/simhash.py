"""SimHash near-duplicates found by covering locality-sensitive hashing.

A covering of radius r gives every bit position a non-zero vector of r + 1 bits.
Table v (a non-zero vector too) keeps the positions whose vector has odd overlap
with v. The vectors of r or fewer differing positions span at most r dimensions,
so some v is orthogonal to all of them: its table drops every differing bit, and
the pair collides there. No pair within the radius can be missed.

Cases: a null text is an empty one; a text without words has fingerprint zero and
is linked like any other; repeated rows and equal texts share a fingerprint and so
a component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from driftwise.llm.common import HASH, ID, keyed, saved, text_column, texts
from driftwise.llm.components import components

SEED = 42
BITS = 64
ROWS = 1 << 15


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each shingle of ASCII-lowered words; of all words if they are fewer."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    spans = zip((ends - sizes)[:len(words) - width + 1].tolist(), ends[width - 1:].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)


def fold_bits(hashes: np.ndarray) -> int:
    """The signed 64-bit word whose bits are those set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), ROWS):
        part = hashes[at:at + ROWS]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(width: int, distinct: bool = False):
    """A column function from text to fingerprint; distinct counts each shingle once."""

    @pandas_udf("long")
    def of(batch: pd.Series) -> pd.Series:
        def one(text: str) -> int:
            hashes = shingle_hashes(text, width)
            return fold_bits(np.unique(hashes) if distinct else hashes)

        return pd.Series([one(t) for t in batch], dtype="int64")

    return of


def covering_masks(radius: int) -> list[int]:
    """The masks of a covering, as signed 64-bit words.

    From radius 6 on the odd vectors 1, 3, 5 ... serve as position vectors, and each
    mask but one keeps exactly half of the bits; below, all non-zero vectors in turn.
    """
    top = 1 << (radius + 1)
    vectors = [2 * i + 1 for i in range(BITS)] if top >= 2 * BITS else [i % (top - 1) + 1 for i in range(BITS)]
    masks = []
    for v in range(1, top):
        mask = sum(1 << i for i, p in enumerate(vectors) if (p & v).bit_count() & 1)
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return masks


def table_keys(prints: DataFrame, radius: int, *carried: str) -> DataFrame:
    """One row per fingerprint and table: the table's number and the bits it keeps."""
    keys = F.array(*[
        F.struct(F.lit(t).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for t, m in enumerate(covering_masks(radius))])
    return prints.select("fp", *carried, F.explode(keys).alias("k")).select("fp", *carried, "k.t", "k.key")


def shared_keys(keys: DataFrame) -> DataFrame:
    """The (t, key) that more than one fingerprint has, counted on the map side first."""
    return keys.groupBy("t", "key").agg(F.count("*").alias("members")).filter("members > 1")


def _flipped(fp: Column, free: Column) -> Column:
    """A fingerprint and its neighbours at one bit, among the free bits."""
    near = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit(free, i) == 1),
        lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return F.concat(F.array(fp), near)


def links_within_two(prints: DataFrame) -> DataFrame:
    """Links (a, b) of ids whose fingerprints differ in at most two bits; every component is kept whole.

    The covering finds the fingerprints that share a table's key with another one and
    the bits in which they may differ. Two fingerprints are within two bits exactly if
    some word lies within one bit of both, so each candidate is sent to itself and to
    its neighbours at one free bit, and those that meet at a word are linked to the
    smallest. At most 65 distinct fingerprints can meet at a word, so a group of any
    number of near copies costs work in proportion to its size, never its square.
    """
    keys = table_keys(prints, 2, "id")
    shared = shared_keys(keys).drop("members")
    free = [~m for m in covering_masks(2)]
    dropped = F.element_at(F.array(*[F.lit(m) for m in free]), F.col("t").cast("int") + 1)
    candidates = keys.join(shared, ["t", "key"]).groupBy("fp", "id").agg(F.bit_or(dropped).alias("free"))
    met = candidates.select("id", F.explode(_flipped(F.col("fp"), F.col("free"))).alias("word"))
    groups = met.groupBy("word").agg(F.collect_set("id").alias("ids")).filter(F.size("ids") > 1)
    return groups.select(F.explode("ids").alias("a"), F.array_min("ids").alias("b")).filter("a <> b")


def near_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; links are at two or fewer differing bits."""
    frame = texts(docs)
    prints = saved(frame.select("doc_id", fingerprint(width)("text").alias("fp")), "prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    # Fingerprints are the nodes, so that one which only rows without an id have still links others.
    roots = components(links_within_two(distinct.select("fp", F.col("fp").alias("id"))))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: The first pass compares all fingerprints of a table's key up to this many; above, neighbours in sorted orders.
CROWD = 128
#: Orders in which a larger group is sorted, each a rotation of the fingerprint's bits.
ROTATIONS = (0, 21, 42)
#: Links that a text may offer in one table's group in the first pass, to the nearest texts of smaller id.
NEAREST = 2
#: Pairs of a text that the first pass compares, of those that it tries.
LIKELIEST = 3
#: Texts of about this many outsiders of a group stand in one array in the second pass.
CHUNK = 512
#: Bits of the parity marks of a text's set of shingles.
MARKS = 1024
#: A shingle of so many texts of a batch may be common; and the most common ones that are kept as such, 2 MB.
HEAVY, COMMON = 3, 1 << 18
#: Texts whose keys are broadcast to fetch them, 32 MB.
BROADCAST_ROWS = 1 << 21


def jaccard(width: int):
    """A column function from two texts to the likeness of their sets of shingles."""

    @pandas_udf("double")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(a: str, b: str) -> float:
            x, y = (np.unique(shingle_hashes(t, width)) for t in (a, b))
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0

        return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")

    return of


def heavy(width: int):
    """(s, n): the shingles that several texts of one batch have, and how many texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), width)) for t in batch.column(0)]
            every, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            many = n >= HEAVY
            yield pa.RecordBatch.from_pydict({"s": pa.array(every[many].view(np.int64)), "n": pa.array(n[many].astype(np.int64))})

    return run


def common_shingles(own: DataFrame, width: int) -> np.ndarray:
    """Shingles that many texts have, the most common ``COMMON`` of them at most, sorted."""
    found = own.select("text").mapInArrow(heavy(width), "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    listed = found.orderBy(F.desc("n"), "s").limit(COMMON).select("s").toPandas()["s"]
    return np.sort(listed.to_numpy(np.int64).view(np.uint64))


def marks(width: int):
    """A column function from text to the size of its set of shingles and, per bit, whether an odd number fall there."""

    @pandas_udf("n long, marks array<long>")
    def of(batch: pd.Series) -> pd.DataFrame:
        sets = [np.unique(shingle_hashes(t, width)) for t in batch]
        odd = [np.bincount((h % MARKS).astype(np.int64), minlength=MARKS) & 1 for h in sets]
        return pd.DataFrame({"n": pd.Series([len(h) for h in sets], dtype="int64"),
                             "marks": [np.packbits(o.astype(np.uint8)).view(np.int64) for o in odd]})

    return of


def first_shingles(width: int, similarity: float, common: np.ndarray):
    """A column function from text to the first shingles of its set, for ``rare_keys``; zero stands for an empty set."""

    @pandas_udf("array<long>")
    def of(batch: pd.Series) -> pd.Series:
        def first(text: str) -> np.ndarray:
            h = np.unique(shingle_hashes(text, width))
            if not len(h):
                return np.zeros(1, np.int64)
            known = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h if len(common) else np.zeros(len(h), bool)
            return np.concatenate([h[~known], h[known]])[:int(len(h) * (1 - similarity) + 1e-6) + 1].view(np.int64)

        return pd.Series([first(t) for t in batch])

    return of


def bits_apart(x: Column, y: Column) -> Column:
    """In how many bits the marks of two sets differ."""
    return F.aggregate(
        F.zip_with(x["marks"], y["marks"], lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)


def may_be_alike(x: Column, y: Column, similarity: float) -> Column:
    """False only for sets that cannot be that alike.

    The smaller of two sets of likeness s has at least s times the other's shingles. Marks differ
    in no more bits than the sets differ in shingles, and sets of likeness s differ in at most
    (1 - s) / (1 + s) of the sum of their sizes.
    """
    sized = F.least(x["n"], y["n"]) + F.lit(1e-6) >= F.greatest(x["n"], y["n"]) * F.lit(similarity)
    return sized & (bits_apart(x, y) <= (x["n"] + y["n"]) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6))


def crowded_keys(distinct: DataFrame, radius: int) -> DataFrame:
    """(t, key, members, fp, id) of the fingerprints that share a table's key with another one."""
    keys = table_keys(distinct, radius, "id")
    return keys.join(shared_keys(keys), ["t", "key"]).select("t", "key", "members", "fp", "id")


def rare_keys(firsts: DataFrame, sets: DataFrame) -> DataFrame:
    """(t, key, members, fp, id): texts at the first shingles of their sets, where alike ones always meet.

    Two sets that are alike share at least ``similarity`` of the shingles of either one. So
    under any one order of shingles they share one of the first (1 - similarity) n + 1 of
    each set of n. The order is that of the hashes, with the common shingles behind the
    others; which ones count as common decides the work only. Keys are counted before they
    are joined, so a key that many texts have is split.
    """
    keys = firsts.select("id", F.explode("first").alias("key"))
    met = keys.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    return keys.join(met, "key").join(sets.select("id", "fp"), "id").select(
        F.lit(-1).cast("short").alias("t"), "key", "members", "fp", "id")


def first_pairs(shared: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b), a < b, within the radius, that are likely to hold the groups together.

    In a small group each member is compared with all others and tried with the nearest
    of smaller id. In a group of many, it is tried with its neighbours in several sorted
    orders and with the group's smallest id. So a group's pairs follow its size, never
    the square. What they leave apart is settled by ``open_pairs``.
    """
    groups = shared.filter(F.col("members") <= CROWD).groupBy("t", "key").agg(
        F.collect_list(F.struct("fp", "id")).alias("m"))

    def nearest(x: Column) -> Column:
        near = F.transform("m", lambda y: F.struct(
            F.bit_count(x["fp"].bitwiseXOR(y["fp"])).alias("bits"), y["id"].alias("a"), x["id"].alias("b")))
        return F.slice(F.array_sort(F.filter(near, lambda p: (p["a"] < p["b"]) & (p["bits"] <= radius))), 1, NEAREST)

    small = groups.select(F.explode(F.flatten(F.transform("m", nearest))).alias("p")).select("p.a", "p.b")
    many = shared.filter(F.col("members") > CROWD)
    turned = many.withColumn("turn", F.explode(F.array(*[F.lit(r) for r in ROTATIONS]))).withColumn(
        "order", F.expr("shiftleft(fp, turn) | shiftrightunsigned(fp, 64 - turn)"))
    following = turned.withColumn(
        "next", F.expr("lead(struct(fp, id)) over (partition by t, key, turn order by order, id)"))
    first = many.groupBy("t", "key").agg(F.min(F.struct("id", "fp")).alias("first"))
    tries = following.filter("next is not null").select(
        "fp", "id", F.col("next.fp").alias("fp2"), F.col("next.id").alias("id2")).unionByName(
        many.join(first, ["t", "key"]).select("fp", "id", F.col("first.fp").alias("fp2"), F.col("first.id").alias("id2")))
    large = tries.filter((F.col("id") != F.col("id2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius)).select(
        F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))
    return small.unionByName(large).distinct()


def open_pairs(shared: DataFrame, roots: DataFrame, sets: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Pairs (a, b) within the radius in different components, all but those whose marks rule them out.

    Only keys that hold several components matter. There, the members outside the largest
    component stand in arrays of about ``CHUNK``, and every member of the key meets each
    array; so a key costs its members times its outsiders, of which a group of copies
    has few. No key is ever in one task or one array, and pairs that cannot be alike
    are ruled out inside the arrays, before any row is made. A text has one key per table
    at most, so its keys are listed while its marks are fetched, once per text.
    """
    named = shared.join(roots, F.col("id") == F.col("node"), "left").select(
        "t", "key", "fp", "id", F.coalesce("root", "id").alias("root"))
    parts = named.groupBy("t", "key", "root").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("t", "key").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("outside")).filter("outside > 0")
    places = named.join(mixed, ["t", "key"]).groupBy("id", "fp", "root").agg(
        F.collect_list(F.struct("t", "key", "main", "outside")).alias("places"))
    members = places.join(sets, "id").select(
        F.struct("id", "fp", "root", "n", "marks").alias("x"), F.inline("places"))
    piles = members.filter("x.root <> main").groupBy(
        "t", "key", F.expr(f"pmod(xxhash64(x.id), ceil(outside / {CHUNK}))").alias("pile")).agg(
        F.collect_list("x").alias("others")).drop("pile")
    x = F.col("x")

    def wanted(y: Column) -> Column:
        new = (y["root"] != x["root"]) & ((x["root"] == F.col("main")) | (y["id"] < x["id"]))
        near = F.bit_count(y["fp"].bitwiseXOR(x["fp"])) <= radius
        return new & near & may_be_alike(x, y, similarity)

    met = members.join(piles, ["t", "key"]).select(
        "x.id", F.explode(F.transform(F.filter("others", wanted), lambda y: y["id"])).alias("other"))
    return met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def alike_pairs(pairs: DataFrame, distinct: DataFrame, own: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of distinct texts whose sets of shingles are alike enough; own has the texts."""
    wanted = saved(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(distinct, "id").select(
        F.col("doc").alias(ID), F.col("id").alias(HASH)), "wanted")
    if wanted.count() <= BROADCAST_ROWS:  # two numbers a row; else the texts are shuffled to them
        wanted = F.broadcast(wanted)
    fetched = saved(own.join(wanted, [ID, HASH]).groupBy(HASH).agg(F.max("text").alias("text")), "texts")
    left, right = fetched.toDF("a", "left"), fetched.toDF("b", "right")
    told = pairs.join(left, "a").join(right, "b").withColumn("alike", jaccard(width)("left", "right"))
    return told.filter(F.col("alike") >= similarity).select("a", "b")


def first_of_groups(docs: DataFrame, radius: int = 6, width: int = 5, similarity: float = 0.8, beyond: bool = False) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies, with its columns.

    Equal texts are merged first, and a text's hash names it from then on. Links are the
    pairs whose sets of ``width``-word shingles
    are alike enough, and groups are the links' components. Fingerprints of the distinct
    words of each text are brought together by a covering of the radius; with ``beyond``,
    texts also meet at rare shingles, as alike ones always do, however far their
    fingerprints are apart. A first pass tries few of the pairs that meet; a second tries
    every one that it left in two components, so the groups are those that all pairs
    within the radius, or with ``beyond`` all pairs there are, would give.
    Words serve for finding since a changed word costs one of them but ``width`` shingles.
    """
    own = keyed(docs).select(ID, HASH, text_column(docs).alias("text"))
    prints = saved(own.select(ID, HASH, fingerprint(1, distinct=True)("text").alias("fp"), marks(width)("text").alias("m")), "prints")
    distinct = prints.groupBy(HASH).agg(
        F.min(ID).alias("doc"), F.min("fp").alias("fp"), F.min_by("m", ID).alias("m"))
    sets = saved(distinct.select(F.col(HASH).alias("id"), "doc", "fp", "m.n", "m.marks"), "sets")
    shared = saved(crowded_keys(sets.select("fp", "id"), radius), "keys")
    tried, places, reach = first_pairs(shared, radius), shared, radius
    if beyond:
        first = first_shingles(width, similarity, common_shingles(own, width))("text").alias("first")
        firsts = own.select(ID, F.col(HASH).alias("id"), first).join(
            sets.select(F.col("doc").alias(ID), "id"), [ID, "id"], "left_semi").dropDuplicates([ID, "id"]).select("id", "first")
        places, reach = saved(rare_keys(firsts, sets), "rare"), BITS
        tried = tried.unionByName(first_pairs(places, BITS)).distinct()
    sides = sets.select("id", F.struct("n", "marks").alias("m"))
    x, y = F.col("x"), F.col("y")
    near = F.collect_list(F.struct((bits_apart(x, y) / (x["n"] + y["n"] + 1)).alias("apart"), F.col("a").alias("a")))
    # Of the first pass's pairs, each text is compared with the likeliest few only; the second pass sees to the rest.
    likely = saved(tried.join(sides.toDF("a", "x"), "a").join(sides.toDF("b", "y"), "b").filter(
        may_be_alike(x, y, similarity)).groupBy("b").agg(F.slice(F.array_sort(near), 1, LIKELIEST).alias("best")).select(
        F.explode("best.a").alias("a"), "b"), "pairs")
    found = saved(alike_pairs(likely, sets, own, width, similarity), "alike")
    rest = open_pairs(places, components(found), sets.select("id", "n", "marks"), reach, similarity)
    rest = saved(rest.join(likely, ["a", "b"], "left_anti"), "pairs")
    more = saved(alike_pairs(rest, sets, own, width, similarity), "alike")
    roots = components(found.unionByName(more))
    grouped = sets.select("id", "doc").join(roots, F.col("id") == F.col("node"), "left")
    kept = grouped.groupBy(F.coalesce("root", "id")).agg(F.min(F.struct("doc", "id")).alias("f")).select(
        F.col("f.doc").alias(ID), F.col("f.id").alias(HASH))
    first = keyed(docs).join(kept, [ID, HASH], "left_semi")
    return first.dropDuplicates([ID, HASH]).select(*[F.col(f"`{c}`") for c in docs.columns])
