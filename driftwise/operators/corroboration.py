"""Searching the record: weights, ranked matches, citations and readings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import DataType

from driftwise.functions import text as words
from driftwise.session import written

WORD = r"(?U)\b\w\w+\b"


def sentence_rows(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sentence with its 0-based span.

    A piece runs through the white space that ends it, so a running sum of piece
    lengths gives exact offsets even where sentences repeat.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"(?s).+?(?:(?<=[.!?])\s+|\z)"), F.lit(0))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    laid = frame.select(key, F.posexplode_outer(pieces).alias("pos", "piece"))
    quote = words.bare(F.col("piece"))
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0))
    return (
        laid.withColumn("start", start.cast("int"))
        .withColumn("quote", F.coalesce(quote, F.lit("")))
        .withColumn("end", F.col("start") + F.length("quote"))
        .select(key, F.coalesce("pos", F.lit(0)).alias("pos"), "start", "end", "quote")
    )


def term_counts(frame: DataFrame, keys: Sequence[str], text: str,
                stop_words: Sequence[str]) -> DataFrame:
    """How often each kept word occurs per key."""
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))
    return (
        frame.select(*keys, F.explode(tokens).alias("token"))
        .filter(~F.col("token").isin(*stop_words))
        .groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("tf"))
    )


def batched_counts(documents: DataFrame, text: str, stop_words: Sequence[str]) -> DataFrame:
    """(doc_id, ts, token, tf) as of ``term_counts``, with a ``batch`` in which all rows of a document lie.

    A document with one row is counted and kept where it lies, so its words do not move; only
    documents with several rows are brought together. To be kept as a stage, since batches of the
    former are named by place.
    """
    many = written(documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
                   .select(F.col("doc_id").alias("_many"), F.lit(True).alias("_again")), "repeated-documents")
    letters = F.coalesce(F.sum(F.length(text)), F.lit(0))
    alone, again = documents, None
    if not many.isEmpty():
        told = documents.join(many, F.col("doc_id").eqNullSafe(F.col("_many")), "left")
        alone, again = told.filter("_again is null"), told.filter("_again")
    held = documents.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(BATCH_LETTERS) / F.greatest(F.lit(1), letters)))).scalar()
    row = F.col("_place").bitwiseAND((1 << 33) - 1)
    said = F.array_join(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0)), " ")
    placed = alone.select("doc_id", "ts", said.alias("said"), F.monotonically_increasing_id().alias("_place"))
    placed = placed.select("doc_id", "ts", "said", (F.col("_place") - row + F.floor(row / held)).cast("long").alias("batch"))
    kinds = dict(documents.dtypes)
    dropped = pa.array(stop_words, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _tallies(batch, dropped)

    counts = placed.mapInArrow(run, f"doc_id {kinds['doc_id']}, ts {kinds['ts']}, token string, tf long, batch long")
    if again is None:
        return counts
    groups = again.agg(F.floor(letters / F.lit(BATCH_LETTERS)) + 1).scalar()
    return counts.unionByName(term_counts(again, ("doc_id", "ts"), text, stop_words).withColumn(
        "batch", -1 - F.pmod(F.xxhash64("doc_id"), groups)))


def _tallies(batch: pa.RecordBatch, dropped: pa.Array) -> Iterator[pa.RecordBatch]:
    """How often each word but the dropped ones occurs in each row, some rows at a time; words are parted by single spaces."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["said"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TALLY_BYTES, "right")))
        rows, at = batch.slice(at, end - at), end
        lists = pc.split_pattern(rows["said"], " ")
        words_ = lists.flatten().dictionary_encode()
        n = len(words_.dictionary)
        if not n:
            continue
        key, tf = np.unique(pc.list_parent_indices(lists).to_numpy() * np.int64(n) + words_.indices.to_numpy(), return_counts=True)
        wanted = pc.and_(pc.invert(pc.is_in(words_.dictionary, value_set=dropped)), pc.not_equal(words_.dictionary, "")).to_numpy(zero_copy_only=False)
        kept = wanted[key % n]
        key, tf = key[kept], tf[kept]
        row = pa.array(key // n)
        yield pa.RecordBatch.from_arrays(
            [rows["doc_id"].take(row), rows["ts"].take(row), words_.dictionary.take(pa.array(key % n)), pa.array(tf, pa.int64()), rows["batch"].take(row)],
            ["doc_id", "ts", "token", "tf", "batch"])


def inverse_frequency(counts: DataFrame, documents: DataFrame) -> DataFrame:
    """Smoothed idf of every word of the corpus."""
    total = documents.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.groupBy("token").agg(F.count(F.lit(1)).alias("df")).select(
        "token", (F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))


def weighted(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """Sublinear tf times idf; words outside the corpus fall away."""
    return counts.join(idf, "token").withColumn("w", (1.0 + F.log("tf")) * F.col("idf"))


#: Days that share a cell of time in the postings.
SPAN_DAYS = 90
#: Queries that are held by every task while vectors stream by.
HELD = 4096
#: Documents and queries, over all cells of time, for which one group of a cell is made.
SHARD_DOCUMENTS, SHARD_QUERIES = 20_000, 100_000
#: Letters of text, or else words of documents, that share a batch; the latter are also what a task holds to pack them.
BATCH_LETTERS, BATCH_ROWS = 8_000_000, 1_000_000
#: Bytes of text whose words are counted at once, and rows that go back to Spark at once.
TALLY_BYTES, ROWS_SENT = 4_000_000, 100_000
#: Different words of all searches up to which postings of other words are left behind before they move.
WORDS_HELD = 8192


def _span(ts: Column) -> Column:
    return F.floor(F.datediff(ts, F.lit("1970-01-01").cast("date")) / F.lit(SPAN_DAYS)).cast("int")


def _bag(rows: pa.Table) -> bytes:
    """Rows packed: each word once, and its number in the rows."""
    rows = rows.combine_chunks()
    rows = rows.set_column(rows.schema.get_field_index("token"), "token", rows["token"].combine_chunks().dictionary_encode())
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(rows)
    return out.getvalue().to_pybytes()


def _opened(bag: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(bag.as_py()).read_all().combine_chunks()


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(batch, bag): a task's rows, packed by batch.

    Rows are held until they are many. Then batches of which none has just come are taken for
    whole, as they are where each lies in one place; only if that frees nothing are all packed.
    """
    held: dict[int, list[pa.Table]] = {}

    def packed(names: list[int]) -> pa.RecordBatch:
        bags = [_bag(pa.concat_tables(held.pop(name))) for name in names]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(bags, pa.binary())], ["batch", "bag"])

    n = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        of, table = table["batch"].to_numpy(), table.drop_columns("batch")
        order = np.argsort(of, kind="stable")
        here, starts = np.unique(of[order], return_index=True)
        here, ends = here.tolist(), [*starts[1:], len(of)]
        if len(here) > 1:
            table = table.take(pa.array(order))
        for name, start, end in zip(here, starts, ends):
            held.setdefault(name, []).append(table.slice(start, end - start))
        n += batch.num_rows
        if n >= BATCH_ROWS:
            yield packed([name for name in held if name not in here] or list(held))
            n = sum(t.num_rows for tables in held.values() for t in tables)
    if held:
        yield packed(list(held))


def _bag_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(batch, token): the words of each bag."""
    for batch in batches:
        for name, bag in zip(batch["batch"], batch["bag"]):
            token = _opened(bag)["token"].combine_chunks().dictionary
            yield pa.RecordBatch.from_arrays([pa.repeat(name, len(token)), token], ["batch", "token"])


def _weighed(known: pa.Table, bags: pa.Table) -> pa.Table:
    """The rows of a batch with the idf of their words, the length of their document and all its times."""
    pieces = []
    for bag in bags["bag"]:
        rows = _opened(bag)
        token = rows["token"].combine_chunks()
        at = pc.index_in(token.dictionary, value_set=known["token"].combine_chunks())
        idf = known["idf"].combine_chunks().take(at).take(token.indices)
        rows = rows.set_column(rows.schema.get_field_index("token"), "token", token.dictionary.take(token.indices))
        pieces.append(rows.append_column("idf", idf).filter(pc.is_valid(idf)))
    rows = pa.concat_tables(pieces).combine_chunks()
    ids = rows["doc_id"].combine_chunks().dictionary_encode()
    names, ids = ids.dictionary, ids.indices.to_numpy()
    w = (1.0 + np.log(rows["tf"].to_numpy())) * rows["idf"].to_numpy()
    size = np.sqrt(np.bincount(ids, w * w, len(names)))
    # Each pair of a document and a time once, in the documents' order.
    dated = pa.table({"id": pa.array(ids), "ts": rows["ts"]}).group_by(["id", "ts"], use_threads=False).aggregate([])
    once = np.bincount(dated["id"].to_numpy(), minlength=len(names)) == 1
    dated = dated.filter(pc.is_valid(dated["ts"])).sort_by([("id", "ascending"), ("ts", "ascending")])
    starts = np.searchsorted(dated["id"].to_numpy(), np.arange(len(names) + 1))
    times = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), dated["ts"].combine_chunks())
    told = pa.table([rows["doc_id"], rows["ts"], rows["token"], rows["tf"], rows["idf"], pa.array(size[ids]), times.take(pa.array(ids, mask=once[ids]))],
                    names=["doc_id", "ts", "token", "tf", "idf", "size", "times"])
    return pa.Table.from_batches(told.to_batches(ROWS_SENT), told.schema)


def postings(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(doc_id, ts, span, token, tf, idf, size, times): the words of documents, with what ``unit_weight`` needs.

    ``size`` is the length of the document's weights and ``times`` are all times under which it is
    filed, null where ``ts`` is the only one. Documents lie in batches, a column of the counts or else dealt by hash. A batch asks for
    the idf of its words once each; answers and its rows, packed, meet in one task, so no
    row moves by its word and none a second time by its document.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(counts.dtypes)
    if "batch" not in counts.columns:
        counts = counts.withColumn("batch", F.pmod(F.xxhash64("doc_id"), _groups(counts, BATCH_ROWS)))
    rows = counts.filter("doc_id is not null").select("doc_id", "ts", "token", F.col("tf").cast("int").alias("tf"), F.col("batch").cast("long").alias("batch"))
    bags = rows.mapInArrow(_bags, "batch long, bag binary").repartition(parts, "batch")
    asks = bags.mapInArrow(_bag_words, "batch long, token string")
    answers = asks.join(idf, "token").select("batch", "token", "idf").repartition(parts, "batch")
    shape = f"doc_id {kinds['doc_id']}, ts {kinds['ts']}, token string, tf int, idf double, size double, times array<{kinds['ts']}>"
    arrow = to_arrow_schema(DataType.fromDDL(shape))

    def run(known: pa.Table, bags: pa.Table) -> pa.Table:
        return (_weighed(known, bags) if bags.num_rows and known.num_rows else arrow.empty_table()).cast(arrow)

    told = answers.groupBy("batch").cogroup(bags.groupBy("batch")).applyInArrow(run, shape)
    return told.withColumn("span", _span(F.col("ts")))


def unit_weight() -> Column:
    """The weight of a posting where its document's weights have length 1."""
    return (1.0 + F.log("tf")) * F.col("idf") / F.col("size")


def _order(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their codes, and where each of the n codes starts and the last one ends."""
    return np.argsort(codes, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=n))])


def _micros(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy()


def _compare(said: pa.Table, listed: pa.Table, k: int | None, min_score: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each question with a match: its first row in ``said``, the rows in ``listed`` that name the documents, and scores.

    A question's words are ordered by the most they could add in this group: their weight times the
    largest of any posting. The words whose sums together stay below the score cannot lift a
    document to it, so only documents with another word are looked at.
    """
    known = pc.unique(listed["token"])
    code = pc.index_in(said["token"], value_set=known).to_numpy(zero_copy_only=False)
    used = np.flatnonzero(~np.isnan(code.astype(float)))
    if not len(used):
        return
    code = code[used].astype(np.int64)
    asked = pc.index_in(listed["token"], value_set=known.take(pa.array(np.unique(code)))).to_numpy(zero_copy_only=False).astype(float)
    rows = np.flatnonzero(~np.isnan(asked))
    token, weight = asked[rows].astype(np.int64), listed["w"].to_numpy()[rows]
    code = np.searchsorted(np.unique(code), code)
    ids = listed["doc_id"].take(pa.array(rows)).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    at = _micros(listed["at"])[rows]
    # An entry is a document at one of its times; entries are numbered by time.
    by_time = np.lexsort((ids, at))
    new = np.ones(len(rows), bool)
    new[1:] = (np.diff(at[by_time]) != 0) | (np.diff(ids[by_time]) != 0)
    first, entry = by_time[new], np.empty(len(rows), np.int64)
    entry[by_time] = np.cumsum(new) - 1
    when, named = at[first], ids[first]
    once = len(np.unique(named)) == len(named)
    by_entry = np.argsort(entry, kind="stable")
    order, starts = _order(token[by_entry], int(code.max()) + 1)
    order = by_entry[order]
    entry, weight = entry[order], weight[order]
    tops = np.maximum.reduceat(weight, starts[:-1])
    texts = said["token"].take(pa.array(used)).to_pylist()
    question = said["question"].to_numpy()[used]
    lows, highs, own = _micros(said["lo"])[used], _micros(said["hi"])[used], said["w"].to_numpy()[used]
    by_question, bounds = _order(question, int(question.max()) + 1)
    for here in np.split(by_question, bounds[1:-1]):
        if not len(here):
            continue
        a, b = np.searchsorted(when, lows[here[0]]), np.searchsorted(when, highs[here[0]], "right")
        if a >= b:
            continue
        most = own[here] * tops[code[here]]
        rank = sorted(range(len(here)), key=lambda i: (most[i], texts[here[i]]))
        needed = np.empty(len(here), bool)
        needed[rank] = np.cumsum(most[rank]) >= min_score - 1e-9
        if not needed.any():
            continue
        met, added, wanted = [], [], np.zeros(b - a, bool)
        for i, need in zip(here, needed):
            lo, hi = starts[code[i]], starts[code[i] + 1]
            lo, hi = lo + np.searchsorted(entry[lo:hi], (a, b))
            met.append(entry[lo:hi] - a)
            added.append(weight[lo:hi] * own[i])
            if need:
                wanted[met[-1]] = True
        if not wanted.any():
            continue
        score = np.bincount(np.concatenate(met), np.concatenate(added), b - a)
        found = np.flatnonzero(wanted if k is None else wanted & (score >= min_score))
        if not once:
            found = found[np.unique(named[found + a], return_index=True)[1]]
        if k is not None and len(found) > k:
            # Equal scores can be many; only as many ids are fetched as are needed to choose among them.
            told = np.round(score[found], 9)
            near = np.flatnonzero(told >= np.partition(told, -k)[-k])
            found = found[near]
            names = listed["doc_id"].take(pa.array(rows[first[found + a]])).to_pylist()
            found = found[_best(score[found], names, k)]
        yield used[here[0]], rows[first[found + a]], score[found]


def meet(asked: DataFrame, listed: DataFrame, min_score: float, k: int | None = None,
         shards: Column | None = None, blocks: Column | None = None) -> DataFrame:
    """(query_id, doc_id, score) of the pairs that can reach the score; with ``k``, of each group's k best that do.

    Queries and documents meet in groups of a cell of time, in which documents are dealt to
    ``shards`` and queries to ``blocks``, so that no group grows with the tables. A group is
    compared in the task that holds it: no pair of a query and a document is a row that moves.
    """
    shards, blocks = (F.lit(1) if n is None else n for n in (shards, blocks))
    named = asked.select("token").distinct().limit(WORDS_HELD + 1).toArrow()
    if named.num_rows <= WORDS_HELD:
        # A posting of another word adds to no score; lengths are those of all words.
        listed = listed.join(listed.sparkSession.createDataFrame(named), "token", "left_semi")
    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = ("span", "shard", "block")

    def dealt(key: str, n: Column) -> Column:
        return F.pmod(F.xxhash64(key), n).cast("int")

    def each(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))

    # A query is all its words, in each of its windows.
    held = asked.select("query_id", "lo", "hi").distinct().groupBy("query_id").agg(
        F.collect_list(F.struct(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("lo", "hi")])).alias("windows"))
    said = asked.select("query_id", "token", "w").join(held, "query_id").select(
        "query_id", "token", "w", F.explode("windows").alias("v")).select("query_id", "token", "w", "v.lo", "v.hi").filter("lo <= hi")
    left = (
        said.withColumn("span", F.explode(F.sequence(_span(F.col("lo")), _span(F.col("hi")))))
        .withColumn("shard", each(shards)).withColumn("block", dealt("query_id", blocks))
        .repartition(parts, *group)
    )
    right = (
        listed.select("doc_id", "token", unit_weight().alias("w"), F.explode(F.coalesce("times", F.array("ts"))).alias("at"))
        .filter("at is not null").withColumn("at", F.col("at").cast("timestamp_ntz"))
        .withColumns({"span": _span(F.col("at")), "shard": dealt("doc_id", shards)}).withColumn("block", each(blocks))
        .repartition(parts, *group)
    )
    kinds = [(name, to_arrow_type(frame.schema[name].dataType)) for frame, name in ((asked, "query_id"), (listed, "doc_id"))]

    def run(said: pa.Table, listed: pa.Table) -> pa.Table:
        pairs = []
        if said.num_rows and listed.num_rows:
            windows = zip(said["query_id"].to_pylist(), _micros(said["lo"]).tolist(), _micros(said["hi"]).tolist())
            numbers: dict = {}
            said = said.append_column("question", pa.array([numbers.setdefault(v, len(numbers)) for v in windows], pa.int64()))
            pairs = list(_compare(said, listed, k, min_score))
        query = np.concatenate([np.full(len(d), q) for q, d, _ in pairs] or [np.zeros(0)]).astype(np.int64)
        document = np.concatenate([d for _, d, _ in pairs] or [np.zeros(0)]).astype(np.int64)
        score = np.concatenate([s for *_, s in pairs] or [np.zeros(0)])
        return pa.table([said["query_id"].take(pa.array(query)).cast(kinds[0][1]), listed["doc_id"].take(pa.array(document)).cast(kinds[1][1]),
                         pa.array(score)], names=["query_id", "doc_id", "score"])

    told = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(
        run, f"query_id {asked.schema['query_id'].dataType.simpleString()}, "
             f"doc_id {listed.schema['doc_id'].dataType.simpleString()}, score double")
    return told.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def candidates(asked: DataFrame, listed: DataFrame, min_score: float) -> DataFrame:
    """(query_id, doc_id) of every pair that can reach the score, and of few others.

    A word that most documents have adds little and makes no pair by itself.
    """
    return meet(asked, listed, min_score).select("query_id", "doc_id")


def _groups(frame: DataFrame, held: int) -> Column:
    """How many groups of that many rows the frame is dealt to."""
    return frame.agg(F.floor(F.count(F.lit(1)) / F.lit(held)) + 1).scalar()


def ranked_matches(queries: DataFrame, documents: DataFrame, stop_words: Sequence[str], k: int,
                   min_score: float, counts: DataFrame | None = None, idf: DataFrame | None = None,
                   listed: DataFrame | None = None) -> DataFrame:
    """Top documents per query by cosine of tf-idf, inside each query's window.

    ``queries`` carries query_id, query and the window lo and hi; ``documents``
    carries doc_id, ts and text. Cells of time are matched by equality, and of each group of a
    cell only a query's k best documents move on. ``counts``, ``idf`` and ``listed`` (postings) may be
    handed in where a caller keeps them, so the texts are split and weighed only once.
    """
    if counts is None:
        counts = term_counts(documents, ("doc_id", "ts"), "text", stop_words)
    if idf is None:
        idf = inverse_frequency(counts, documents)
    if listed is None:
        listed = postings(counts, idf)
    said = weighted(term_counts(queries, ("query_id", "lo", "hi"), "query", stop_words), idf)
    size = said.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    asked = written(said.join(size, "query_id").select("query_id", "lo", "hi", "token", (F.col("w") / F.col("size")).alias("w")), "asked")
    scored = meet(asked, listed, min_score, k, _groups(documents, SHARD_DOCUMENTS), _groups(queries, SHARD_QUERIES))
    # Scores are compared to nine places, so the order of summing cannot swap ranks.
    place = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    return (
        scored.filter(F.col("score") >= min_score)
        .withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "doc_id", "score")
    )


def best_sentences(matches: DataFrame, queries: DataFrame, documents: DataFrame,
                   stop_words: Sequence[str], counts: DataFrame | None = None,
                   idf: DataFrame | None = None) -> DataFrame:
    """The sentence of each matched document nearest to the query; ``counts`` and ``idf`` may be handed in."""
    if counts is None:
        counts = term_counts(documents, ("doc_id",), "text", stop_words)
    if idf is None:
        idf = inverse_frequency(counts, documents)
    hit = documents.join(matches.select("doc_id").distinct(), "doc_id", "left_semi")
    lines = sentence_rows(hit)
    said = weighted(term_counts(lines, ("doc_id", "start"), "quote", stop_words), idf)
    asked = weighted(term_counts(queries, ("query_id",), "query", stop_words), idf)
    norm = said.groupBy("doc_id", "start").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    shared = (
        matches.select("query_id", "doc_id").join(said, "doc_id").alias("s")
        .join(asked.select("query_id", "token", F.col("w").alias("qw")), ["query_id", "token"])
        .groupBy("query_id", "doc_id", "start").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
        .join(norm, ["doc_id", "start"])
        .withColumn("score", F.round(F.col("dot") / F.col("norm"), 9))
    )
    best = shared.groupBy("query_id", "doc_id").agg(
        F.max_by("start", F.struct(F.col("score"), -F.col("start"))).alias("start"))
    return best.join(lines, ["doc_id", "start"]).select("query_id", "doc_id", "start", "end", "quote")


def unit(vector: Column) -> Column:
    doubles = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(doubles, lambda x: x / norm)


def _best(score: np.ndarray, ids: list, k: int) -> list[int]:
    """Places of the k best scores, to nine places; of equal ones the smallest ids."""
    told = np.round(score, 9)
    if len(told) <= k:
        return list(range(len(told)))
    cut = np.partition(told, -k)[-k]
    sure = np.flatnonzero(told > cut).tolist()
    return sure + sorted(np.flatnonzero(told == cut).tolist(), key=lambda i: ids[i])[:k - len(sure)]


def heaps(asked: list, vectors: DataFrame, k: int, min_score: float, query_type: DataType) -> DataFrame:
    """(query_id, vec_id, score): of each task's vectors, the k nearest to each query, and no other pair."""
    names, wanted = [r.query_id for r in asked], np.array([r.v for r in asked], float)
    vec_type, query_kind = vectors.schema["vec_id"].dataType.simpleString(), to_arrow_type(query_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, np.ndarray]] = [([], np.zeros(0)) for _ in names]
        id_kind = None
        for batch in batches if names else ():
            id_kind, ids = batch.schema.field(0).type, batch.column(0).to_pylist()
            rows = [i for i, v in enumerate(batch.column(1).to_pylist()) if v is not None]
            if not rows:
                continue
            mine = np.array([batch.column(1)[i].as_py() for i in rows], float)
            ids = [ids[i] for i in rows]
            scores = wanted @ mine.T
            for q, (old, kept) in enumerate(held):
                near = np.flatnonzero(scores[q] >= min_score)
                every, score = old + [ids[i] for i in near], np.concatenate([kept, scores[q, near]])
                best = _best(score, every, k)
                held[q] = [every[i] for i in best], score[best]
        if id_kind is not None:
            yield pa.RecordBatch.from_arrays([
                pa.array([names[q] for q, (ids, _) in enumerate(held) for _ in ids], query_kind),
                pa.array([i for ids, _ in held for i in ids], id_kind),
                pa.array(np.concatenate([s for _, s in held]))], ["query_id", "vec_id", "score"])

    return vectors.select("vec_id", unit(F.col("vector")).alias("v")).mapInArrow(
        run, f"query_id {query_type.simpleString()}, vec_id {vec_type}, score double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, min_score: float = 0.0,
            blocks: int = 1) -> DataFrame:
    """Exact cosine top-k of each query vector.

    Up to ``HELD`` queries are held by every task, which hands on its k nearest per query.
    More of them travel in ``blocks`` rows of vectors and each document row meets each
    block once, so a caller with many queries raises ``blocks`` to keep one row
    small. At most k rows per query leave any task.
    """
    units = queries.select("query_id", unit(F.col("vector")).alias("v"))
    asked = units.limit(HELD + 1).collect()
    if len(asked) <= HELD:
        scored = heaps(asked, vectors, k, min_score, queries.schema["query_id"].dataType)
    else:
        packed = units.groupBy(F.pmod(F.hash("query_id"), F.lit(blocks)).alias("block")).agg(
            F.collect_list(F.struct("query_id", "v")).alias("asked"))
        rows = vectors.select("vec_id", unit(F.col("vector")).alias("dv"),
                              F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        met = rows.join(packed, "block").select("vec_id", "dv", F.explode("asked").alias("q"))
        dot = F.aggregate(F.zip_with("dv", "q.v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        scored = met.select(F.col("q.query_id").alias("query_id"), "vec_id", dot.alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "vec_id")
    return (
        scored.filter(F.col("score") >= min_score)
        .withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    )


def readings(documents: DataFrame, scope_terms: dict[str, dict[str, str]],
             issue_terms: Sequence[tuple[str, tuple[str, ...]]] = words.ISSUE_TERMS) -> DataFrame:
    """What each document reports: issue, the sentence that says so, and scope."""
    text, place = F.col("text"), F.col("place")
    head = F.substr(text, F.lit(1), place - 1)
    rest = F.substr(text, place)
    start = F.length(F.regexp_extract(head, r"(?s)^(.*[.!?]\s+)", 1))
    stop = F.length(F.regexp_extract(rest, r"(?s)^(.*?[.!?])(?=\s)", 1))
    end = F.when(stop > 0, place - 1 + stop).otherwise(F.length(text))
    return (
        documents.withColumn("lowered", F.lower(text)).withColumn("issue", words.issue_of(text, issue_terms))
        .withColumn("place", words.issue_place(F.col("lowered"), F.col("issue"), issue_terms))
        .withColumn("start", start).withColumn("end", end)
        .select("doc_id", "issue", "start", "end",
                F.substr(text, F.col("start") + 1, F.col("end") - F.col("start")).alias("quote"),
                F.when(F.col("issue") == words.RESIDUAL_ISSUE, 0.3).otherwise(0.7).alias("confidence"),
                *[words.longest_term(text, t).alias(d) for d, t in scope_terms.items()])
    )


def expected_issues(issue: Column, related: dict[str, tuple[str, ...]] = words.RELATED_ISSUES,
                    issue_terms: Sequence[tuple[str, tuple[str, ...]]] = words.ISSUE_TERMS) -> Column:
    """Issues that would support a note on this subject. An unrecognised subject
    expects every named issue, never the residual one."""
    named = F.array(*[F.lit(i) for i, _ in issue_terms])
    chain = [F.when(issue == subject, F.array(*[F.lit(i) for i in near]))
             for subject, near in related.items() if near]
    return F.coalesce(*chain, named)


def support(matches: DataFrame, subjects: DataFrame, read: DataFrame) -> DataFrame:
    """Supporting, unrelated and flagged matches per candidate.

    ``matches`` has query_id and doc_id, ``subjects`` query_id and expected,
    ``read`` doc_id, issue and flags. A candidate with no match counts zero.
    """
    judged = matches.join(read, "doc_id").join(subjects, "query_id").select(
        "query_id", F.array_contains("expected", F.col("issue")).alias("backs"),
        (F.size("flags") > 0).alias("flagged"))
    counted = judged.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("searched"), F.count_if("backs").alias("supporting"),
        F.count_if(~F.col("backs")).alias("unrelated"), F.count_if("flagged").alias("flagged"))
    return subjects.select("query_id").join(counted, "query_id", "left").na.fill(0)


def citations(quotes: DataFrame, documents: DataFrame) -> DataFrame:
    """Where each quote stands verbatim in each document, first place only.

    A quote's inner words must appear whole, so its longest inner word pair is
    matched to documents by equality and only those pairs are searched. Quotes
    too short to have an inner pair are compared directly.
    """
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("ws") - 3),
        lambda i: F.concat_ws(" ", F.get("ws", i), F.get("ws", i + 1)))
    split = quotes.withColumn("ws", F.split("quote", r"\s+"))
    long_ = split.filter(F.size("ws") >= 4).withColumn("pairs", pairs)
    longest = F.array_max(F.transform("pairs", lambda p: F.struct(F.length(p), p.alias("p"))))
    anchored = long_.select("item_id", "quote", longest["p"].alias("anchor"))
    ws = F.split("text", r"\s+")
    doc_pairs = documents.select("doc_id", "text", ws.alias("ws")).filter(F.size("ws") >= 2).select(
        "doc_id", F.explode(F.array_distinct(F.transform(
            F.slice("ws", 1, F.size("ws") - 1),
            lambda w, i: F.concat_ws(" ", w, F.get("ws", i + 1))))).alias("anchor"))
    candidates = doc_pairs.join(anchored, "anchor").select("doc_id", "item_id", "quote")
    found = candidates.join(documents.select("doc_id", "text"), "doc_id")
    short = split.filter(F.size("ws") < 4).select("item_id", "quote")
    direct = documents.select("doc_id", "text").join(
        short, F.contains(F.col("text"), F.col("quote"))).select("doc_id", "item_id", "quote", "text")
    at = F.expr("instr(text, quote)")
    return found.select("doc_id", "item_id", "quote", "text").unionByName(direct) \
        .filter(at > 0).select("item_id", "doc_id", (at - 1).alias("start"),
                               (at - 1 + F.length("quote")).alias("end"))


def extraction_score(items: DataFrame) -> DataFrame:
    """Share of labelled texts read right, per set.

    With an expectation: one expected issue was read and no other event issue.
    Without one: no event issue was read, so there was no false alarm.
    """
    named = F.array(*[F.lit(i) for i in words.EVENT_ISSUES])
    event = F.array_intersect("read", named)
    right = F.when(
        F.size("expect") > 0,
        F.arrays_overlap("read", "expect") & (F.size(F.array_except(event, F.col("expect"))) == 0)
    ).otherwise(F.size(event) == 0)
    return items.groupBy("set").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(right).alias("right"),
        F.round(F.lit(100.0) * F.count_if(right) / F.count(F.lit(1)), 1).alias("pct"))
