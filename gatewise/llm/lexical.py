"""Operator 11: ranked lexical search in which documents that look alike to all items are scored once.

Of a document only the items' terms count, and a number ``m`` that stands for its length. Documents with the same term
counts and the same ``m`` are a class: it is scored once, and its members take its place in the ranking by id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gatewise.llm.common import ascii_lower
from gatewise.session import staged

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
VOCABULARY_LIMIT = 500_000  # item terms sent to the tasks; more are met by a join
POSTING_LIMIT = 2_000_000  # pairs (item, term) sent to the tasks; more are met by a join
LAST = (1 << 63) - 1  # in place of a NULL id
OPEN_BYTES = 64 << 20  # chosen classes that are broadcast to find their members; more are met by a join
CELLS = 4_000_000  # scores that a task holds at a time


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct ``(item_id, term)``. Rows that share an item id are one item."""
    terms = F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0))))
    return items.select("item_id", terms.alias("term")).distinct()


def _vector(numbers: dict[int, int]) -> bytes:
    """Term numbers in order and their counts as 32-bit integers (counts of 2^31 and more do not fit a text)."""
    return np.array(sorted(numbers.items()), "<i4").tobytes()


def _bags(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    numbers = {term.encode("utf-8", "surrogatepass"): number for term, number in terms.items()}
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = re.compile(rb"[0-9a-z\x80-\xff]+").findall
        for batch in batches:
            lengths, vectors = [], []
            for text in batch.column(1):
                found = words((text.as_py() or b"").lower())
                lengths.append(len(found))
                vectors.append(_vector({numbers[word]: n for word, n in Counter(filter(numbers.__contains__, found)).items()}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(vectors, pa.binary())], names=["doc_id", "n", "bag"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n bigint, bag binary")


def _joined_bags(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The same for a vocabulary of any size: the documents' terms meet it in a join."""
    rows = staged(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")))
    words = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0))
    counts = rows.select("row", F.explode(words).alias("term")).groupBy("row", "term").agg(F.count("*").alias("tf"))
    known = counts.join(terms, "term").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("number", F.col("tf").cast("int").alias("tf")))).alias("pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [_vector({p["number"]: p["tf"] for p in pairs or []}) for pairs in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.binary())], names=["doc_id", "n", "bag"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = rows.select("doc_id", "row", F.size(words).cast("long").alias("n")).join(known, "row", "left").select("doc_id", "n", "pairs")
    return whole.mapInArrow(run, f"doc_id {kind}, n bigint, bag binary")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        joined = np.concatenate([np.frombuffer(bag, "<i4")[::2] for bag in batch.column(0).to_pylist()] or [np.empty(0, "<i4")])
        numbers, n = np.unique(joined, return_counts=True)
        counts.update(dict(zip(numbers.tolist(), n.tolist())))
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["number", "df"])


def _best_classes(classes: DataFrame, postings: list[tuple[int, list[int]]], weights: dict[int, int], items: int, k: int) -> DataFrame:
    """Each task's best ``k`` classes of every item. ``postings``: for each term number the places of the items that hold it."""
    by_term = {number: np.array(places, np.int64) for number, places in postings}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(items, k)
        size = max(16, CELLS // max(items, 1))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                piece = batch.slice(at, size)
                bags = [np.frombuffer(bag, "<i4") for bag in piece.column(2).to_pylist()]
                owner = np.repeat(np.arange(len(bags)), [len(b) // 2 for b in bags])
                pairs = np.concatenate(bags).reshape(-1, 2).astype(np.int64)
                m = np.array(piece.column(1).to_pylist(), np.int64)
                scores = np.zeros((len(bags), items), np.int64)
                order = np.argsort(pairs[:, 0], kind="stable")
                owner, pairs = owner[order], pairs[order]
                numbers, starts = np.unique(pairs[:, 0], return_index=True)
                gains = 1_000_000_000 * pairs[:, 1] // (1000 * pairs[:, 1] + 20 * m[owner])
                for number, lo, hi in zip(numbers.tolist(), starts, [*starts[1:], len(pairs)]):
                    scores[owner[lo:hi, None], by_term[number]] += weights[number] * gains[lo:hi, None]
                best.add(scores, piece.column(3).to_numpy(), piece.column(0).to_numpy())
        yield from best.rows()

    return classes.select("row", "m", "bag", "first").mapInArrow(run, "place bigint, score bigint, row bigint, first bigint")


class _Best:
    """The best ``k`` classes of every item so far: highest score, then smallest first member."""

    def __init__(self, items: int, k: int):
        self.k, self.kept = k, [[] for _ in range(items)]
        self.least = np.zeros(items, np.int64)  # scores at or below it need no look

    def add(self, scores: np.ndarray, first: np.ndarray, rows: np.ndarray) -> None:
        for place in np.flatnonzero((scores >= np.maximum(self.least, 1)).any(axis=0)).tolist():
            column = scores[:, place]
            found = np.flatnonzero(column >= max(self.least[place], 1))
            if len(found) > self.k:
                found = found[np.lexsort((first[found], -column[found]))[: self.k]]
            more = [(-int(column[i]), int(first[i]), int(rows[i])) for i in found]
            self.kept[place] = sorted(self.kept[place] + more)[: self.k]
            if len(self.kept[place]) == self.k:
                self.least[place] = -self.kept[place][-1][0]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for place, kept in enumerate(self.kept):
            if kept:
                score, first, row = (np.array(c, np.int64) for c in zip(*kept))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), place)), pa.array(-score), pa.array(row), pa.array(first)], names=["place", "score", "row", "first"])


def _joined_classes(classes: DataFrame, postings: DataFrame) -> DataFrame:
    """Scores of all classes for items of any number: class terms meet the postings in a join; partial sums are made before the shuffle."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [np.frombuffer(bag, "<i4").reshape(-1, 2) for bag in batch.column(2).to_pylist()]
            owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
            pairs = np.concatenate(bags) if bags else np.empty((0, 2), "<i4")
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(pairs[:, 0], pa.int32()), pa.array(pairs[:, 1], pa.int32())], names=["row", "m", "number", "tf"])

    terms = classes.select("row", "m", "bag").mapInArrow(spread, "row bigint, m bigint, number int, tf int")
    gain = F.expr("weight * (1000000000L * tf div (1000L * tf + 20L * m))")
    scores = terms.join(postings, "number").groupBy("place", "row").agg(F.sum(gain).alias("score")).where("score > 0")
    return scores.join(classes.select("row", "first"), "row").select("place", "score", "row", "first")


def _nothing(docs: DataFrame, items: DataFrame) -> DataFrame:
    kinds = {c: f.schema[c].dataType.simpleString() for f, c in ((items, "item_id"), (docs, "doc_id"))}
    return docs.sparkSession.createDataFrame([], f"item_id {kinds['item_id']}, rank int, doc_id {kinds['doc_id']}, score bigint")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``; equal scores by ascending id.

    Rows of ``docs`` are documents, also where ids repeat; a NULL id comes last among equal scores. NULL and empty texts have no terms
    and are never found. Rows of ``items`` that share an id (NULL included) are one item; items without terms, or whose terms no document
    holds, give no rows. No documents or no items give no rows. Other columns are left out.

    A class is found by a hash of its counts and ``m`` and by these themselves, so no two unlike documents meet. ``k`` classes of each item
    suffice for ``k`` documents, as each has a member that is ranked before all members of later classes.
    """
    spark = docs.sparkSession
    named = staged(item_terms(items))
    vocabulary = named.select("term").distinct()
    size = vocabulary.count()
    if size == 0:
        return _nothing(docs, items)
    few = size <= VOCABULARY_LIMIT
    if few:
        terms = {r["term"]: i for i, r in enumerate(vocabulary.orderBy("term").collect())}
        numbered = spark.createDataFrame(pa.table({"term": list(terms), "number": pa.array(terms.values(), pa.int32())}))
        bags = staged(_bags(docs, terms))
    else:
        part = F.pmod(F.xxhash64("term"), F.lit(1024))  # numbered part by part, so that no task holds all terms
        at = F.row_number().over(Window.partitionBy(part).orderBy("term"))
        numbered = staged(vocabulary.select("term", (at * 1024 + part).cast("int").alias("number")))
        bags = staged(_joined_bags(docs, numbered))
    totals = bags.where("n > 0").agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    n_docs, length = totals["N"], totals["L"]
    if n_docs == 0:
        return _nothing(docs, items)
    df = staged(bags.where("octet_length(bag) > 0").select("bag").mapInArrow(_frequencies, "number int, df bigint").groupBy("number").agg(F.sum("df").alias("df")))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")

    m = F.expr(f"100 - 50 + ((50L * n * {n_docs}L) div {length}L)")
    members = bags.where("octet_length(bag) > 0").select("doc_id", m.alias("m"), "bag").withColumn("class", F.xxhash64("m", "bag"))
    classes = members.groupBy("class", "m", "bag").agg(F.coalesce(F.min("doc_id").cast("long"), F.lit(LAST)).alias("first"))
    classes = staged(classes.withColumn("row", F.monotonically_increasing_id()))

    places = staged(named.select("item_id").distinct().withColumn("place", F.monotonically_increasing_id()))
    if few and named.count() <= POSTING_LIMIT:
        rows = places.collect()
        places = spark.createDataFrame(pa.table({"place": pa.array(range(len(rows)), pa.int64()), "item_id": pa.array([r["item_id"] for r in rows])}), f"place bigint, item_id {places.schema['item_id'].dataType.simpleString()}")
        at = {r["item_id"]: place for place, r in enumerate(rows)}
        postings: dict[int, list[int]] = {}
        for r in named.collect():
            postings.setdefault(terms[r["term"]], []).append(at[r["item_id"]])
        weights = {r["number"]: r["w"] for r in df.select("number", weight.alias("w")).collect()}
        scored = _best_classes(classes, list(postings.items()), weights, len(rows), k)
    else:
        of = named.alias("a").join(places.alias("b"), F.expr("a.item_id <=> b.item_id")).select("term", "place")
        scored = _joined_classes(classes, staged(of.join(numbered, "term").join(df.select("number", weight.alias("weight")), "number").select("number", "place", "weight")))
    order = Window.partitionBy("place").orderBy(F.desc("score"), "first", "row")
    chosen = staged(scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("place", "score", "row"))

    # the chosen classes are opened: their smallest members, found without moving the members of a class to one place
    wanted = staged(classes.join(chosen.select("row").distinct(), "row", "left_semi").select("row", "class", "m", "bag"))
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("bag") + 32), F.lit(0))).first()[0]
    wanted = F.broadcast(wanted) if size <= OPEN_BYTES else wanted
    smallest = Window.partitionBy("row").orderBy(F.asc_nulls_last("doc_id"))
    found = members.join(wanted, ["class", "m", "bag"]).select("row", "doc_id").withColumn("_r", F.row_number().over(smallest)).where(F.col("_r") <= k).drop("_r")
    ranked = chosen.join(found, "row").withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))).cast("int"))
    return ranked.where(F.col("rank") <= k).join(places, "place").select("item_id", "rank", "doc_id", "score")
