"""Ranked lexical search by dense blocked matrix products.

The words that the items use are numbered; no other word of a document matters but for its length.

1. Every document is read once and leaves its length and the counts of the items' words, a small table.
2. Sums over that table give the number of documents, their length and each word's document frequency.
3. A tile of items has a compact vocabulary of its own, cut into tiles of at most TILE_TERMS words: a
   float64 matrix of weights, words by items. A tile of documents is the matrix of their impacts, documents
   by words. Weights and impacts are whole numbers and every partial sum of a product stays below 2**53, so
   the product is exact; sums over tiles of words are kept as 64-bit integers.
4. Scores that reach the k-th best of their item so far, ties included, are ranked by score and doc_id. Tasks
   hand on k rows for each item, which are merged share by share.

Items are taken in groups of bounded vocabulary, each of which is one pass over all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleloom.llm.common import ship
from saleloom.session import stored

TOP = 50
GROUP_TERMS, GROUP_ITEMS = 200_000, 4096  # a group of items ends with the item that reaches either
TILE_ITEMS, TILE_TERMS, TILE_DOCS = 256, 4096, 512
MOST_IMPACT = 10**6  # impacts are below 10**9 tf / (1000 tf)
EXACT = 2**53 - 1
SHARES = 64  # in which the tasks' best rows of an item are merged first
NO_ID = 2**63 - 1

#: ASCII letters in lower case, digits and all bytes of other characters stay; the rest separates words.
_SPLIT = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
               for b in range(256))


def terms_of(raw: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order and with repeats."""
    return raw.translate(_SPLIT).split() if raw else []


@dataclass
class Group:
    """Items that are searched in one pass, and the words they use by number."""

    items: list = field(default_factory=list)
    terms: list[list[int]] = field(default_factory=list)
    number: dict[bytes, int] = field(default_factory=dict)


def groups_of(benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> Iterator[Group]:
    """Groups of whole items in the order of item_id; the driver holds one of them at a time."""
    items = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t.as_py()))) for t in batch.column("text")]
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(rows)), pa.array(list(chain(*found)), pa.binary())],
                                             names=["item_id", "term"])

    schema = T.StructType([items.schema["item_id"], T.StructField("term", T.BinaryType())])
    group, last = Group(), None
    for row in items.mapInArrow(run, schema).distinct().orderBy("item_id", "term").toLocalIterator():
        if not group.items or row["item_id"] != last:
            if len(group.number) >= GROUP_TERMS or len(group.items) >= GROUP_ITEMS:
                yield group
                group = Group()
            last = row["item_id"]
            group.items.append(last)
            group.terms.append([])
        group.terms[-1].append(group.number.setdefault(bytes(row["term"]), len(group.number)))
    if group.items:
        yield group


def profiles(docs: DataFrame, number: dict[bytes, int], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers) and tf of every row."""
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       F.col(f"`{text}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = number.get
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                n, ends, terms, tf = [], [0], [], []
                for value in part.column("text"):
                    words = terms_of(value.as_py())
                    counts = Counter(map(of, words))
                    counts.pop(None, None)
                    n.append(len(words))
                    terms += counts
                    tf += counts.values()
                    ends.append(len(terms))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                     pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))], names=["doc_id", "n", "terms", "tf"])

    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


@dataclass(frozen=True)
class Corpus:
    """What the scores need of all documents."""

    n_docs: int
    n_terms: int
    df: np.ndarray

    def weights(self) -> np.ndarray:
        """floor(1000 ln((2 N + 2) / (2 df + 1))) of every word of the items."""
        return np.array([math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * int(df) + 1))) for df in self.df], dtype=np.int64)

    def impacts(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """10**9 tf div (1000 tf + 20 m) of words of documents with ``n`` words."""
        if len(n) and int(n.max()) * 50 * self.n_docs >= 2**63:
            share = np.array([50 * int(x) * self.n_docs // self.n_terms for x in n], dtype=np.int64)
        else:
            share = 50 * n * self.n_docs // self.n_terms
        return 10**9 * tf // (1000 * tf + 20 * (50 + share))


def corpus_of(found: DataFrame, n_terms: int) -> Corpus:
    """Sums over stored profiles; the driver sees one row for each word of the items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_terms + 2, dtype=np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy()
            sums[:n_terms] += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
            sums[n_terms] += np.count_nonzero(n)
            sums[n_terms + 1] += n.sum()
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["place", "n"])

    rows = found.select("n", "terms").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(n_terms + 2, dtype=np.int64)
    sums[rows["place"].to_numpy()] = rows["n"].to_numpy()
    return Corpus(int(sums[n_terms]), int(sums[n_terms + 1]), sums[:n_terms])


class ItemTile:
    """Some items: their compact vocabulary and its weights in tiles of words."""

    def __init__(self, first: int, terms: list[list[int]], weights: np.ndarray):
        self.first = first
        used = np.unique(np.concatenate([np.asarray(t, dtype=np.int64) for t in terms]))
        self.place = np.full(len(weights), -1, dtype=np.int64)
        self.place[used] = np.arange(len(used))
        most = max(1, int(weights[used].max(initial=0)) * MOST_IMPACT)
        self.step = max(1, min(TILE_TERMS, EXACT // most))
        self.matrix = np.zeros((len(used), len(terms)))
        for i, t in enumerate(terms):
            self.matrix[self.place[t], i] = weights[t]

    def scores(self, n_docs: int, owner: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> np.ndarray:
        """Scores of documents by items; ``owner`` is the document's row of every term and impact."""
        at = self.place[terms]
        out = np.zeros((n_docs, self.matrix.shape[1]), dtype=np.int64)
        for low in range(0, len(self.matrix), self.step):
            words = self.matrix[low:low + self.step]
            mine = (at >= low) & (at < low + len(words))
            tile = np.zeros((n_docs, len(words)))
            tile[owner[mine], at[mine] - low] = impacts[mine]
            out += (tile @ words).astype(np.int64)
        return out


class Best:
    """The k best documents of each item so far, ties by the smaller doc_id."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.ones(n_items, dtype=np.int64)  # what a score has to reach
        self.item = self.score = self.doc = np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray, first: int) -> None:
        row, col = np.nonzero(scores >= self.least[first:first + scores.shape[1]])
        if not len(row):
            return
        item = np.concatenate([self.item, col + first])
        score = np.concatenate([self.score, scores[row, col]])
        doc = np.concatenate([self.doc, ids[row]])
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        begin = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        rank = np.arange(len(item)) - np.repeat(begin, np.diff(np.r_[begin, len(item)]))
        self.least[item[rank == self.k - 1]] = score[rank == self.k - 1]
        kept = rank < self.k
        self.item, self.score, self.doc = item[kept], score[kept], doc[kept]


def ranked(found: DataFrame, group: Group, corpus: Corpus, k: int, item_type: T.StructField) -> DataFrame:
    """item_id, rank, doc_id, score from stored profiles."""
    weights = corpus.weights()
    items, terms = group.items, group.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = [ItemTile(at, terms[at:at + TILE_ITEMS], weights) for at in range(0, len(items), TILE_ITEMS)]
        best = Best(len(items), k)
        for batch in batches:
            for part in (batch.slice(at, TILE_DOCS) for at in range(0, batch.num_rows, TILE_DOCS)):
                sizes = part.column("terms").value_lengths().to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(part.num_rows), sizes)
                words = part.column("terms").flatten().to_numpy()
                tf = part.column("tf").flatten().to_numpy().astype(np.int64)
                impacts = corpus.impacts(part.column("n").to_numpy()[owner], tf)
                ids = part.column("doc_id").to_numpy()
                for tile in tiles:
                    best.add(ids, tile.scores(part.num_rows, owner, words, impacts), tile.first)
        names = pa.array(items).take(pa.array(best.item))
        for at in range(0, len(names), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([names[part], pa.array(best.doc[part]), pa.array(best.score[part])],
                                             names=["item_id", "doc_id", "score"])

    schema = T.StructType([item_type, T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    rows = found.mapInArrow(run, schema)
    order = [F.desc("score"), F.asc("doc_id")]
    some = Window.partitionBy("item_id", "share").orderBy(*order)
    rows = (rows.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES)))
            .withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k).drop("share", "rank"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return (rows.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score"))


def search(docs: DataFrame, benchmark: DataFrame, k: int = TOP, text: str = "text", doc_id: str = "doc_id",
           item_id: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest score above 0 of every item.

    Rows of one item_id, the null one included, are one item with all their terms; items without terms or
    without hits have no rows. Null and empty texts have no terms. Repeated rows of documents are documents of
    their own. Equal scores go by ascending doc_id, rows without doc_id come last. Empty tables give no rows.
    Other columns are ignored, whatever their names. Long texts are read whole.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = benchmark.select(F.col(f"`{item_id}`").alias("item_id")).schema["item_id"]
    out = None
    for group in groups_of(benchmark, text, item_id):
        found = stored(profiles(docs, group.number, text, doc_id), "profiles")
        corpus = corpus_of(found, len(group.number))
        some = ranked(found, group, corpus, k, kind)
        out = some if out is None else out.unionByName(some)
    if out is None:
        out = spark.createDataFrame([], T.StructType([kind] + [T.StructField(n, t) for n, t in (
            ("rank", T.IntegerType()), ("doc_id", T.LongType()), ("score", T.LongType()))]))
    return out
