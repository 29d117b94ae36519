"""Near duplicates by SimHash fingerprints and BK-trees.

Equal fingerprints fall together first, so a group of copies is one entry from there on. Two
fingerprints that differ in at most two bits agree in two of their four 16-bit blocks. Each distinct
fingerprint therefore goes to six shards, one for each pair of blocks and their value, and in every
shard a BK-tree finds all partners: children hang at their Hamming distance to the parent, and a
search follows only the edges within the radius. Shards travel by shuffle, as their total size grows
with the documents. A shard returns a star for each of its groups, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleloom.llm.common import row_key, ship
from saleloom.llm.components import stars
from saleloom.session import stored

SHINGLE = 3
RADIUS = 2
SEED = 42
BLOCKS = 4  # of 16 bits; RADIUS differing bits leave BLOCKS - RADIUS of them alike
FOREST_ROWS = 200_000  # fingerprints whose trees are searched together
SEARCH_ROWS = 4096  # queries in one step of a search


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words, repeats included; fewer words are one run, none has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = [0, *(ends[:-1] + 1).tolist()]
    return np.fromiter((digest(joined[b:e], seed) for b, e in zip(begins, ends[shingle - 1:].tolist())), dtype=np.uint64,
                       count=len(words) - shingle + 1)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bits that over half the rows of an array of 64-bit words have, as words again."""
    width = hashes.shape[1]
    ones = np.zeros(64 * width, dtype=np.int64)
    for at in range(0, len(hashes), 20_000):
        raw = np.ascontiguousarray(hashes[at:at + 20_000], dtype="<u8").view(np.uint8).reshape(-1, 8 * width)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bits that over half the hashes have, as a signed number; 0 where there are no hashes."""
    return int(majority(hashes.reshape(-1, 1)).view("<i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of one text as a signed number; 0 where there is no word."""
    return fingerprint_of(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, text: str = "text",
                 doc_id: str = "doc_id") -> DataFrame:
    """doc_id, key (tells rows of one doc_id apart) and fingerprint of every row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), row_key(F.col(f"`{text}`")).alias("key"),
                       F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle, seed) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(prints, pa.int64())],
                                             names=["doc_id", "key", "fingerprint"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, key long, fingerprint long")


class BkForest:
    """One BK-tree for each group of 64-bit values, built and searched level by level with arrays.

    Values of one group are distinct and stand side by side.
    """

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        self.values = values.astype(np.uint64)
        n = len(values)
        first = np.r_[True, groups[1:] != groups[:-1]] if n else np.zeros(0, bool)
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        rest = np.flatnonzero(~first)
        parent = self.root[rest]
        keys, nodes = [], []
        while len(rest):
            apart = np.bitwise_count(self.values[rest] ^ self.values[parent]).astype(np.int64)
            edge = parent * 65 + apart
            order = np.argsort(edge, kind="stable")
            head = np.r_[True, edge[order][1:] != edge[order][:-1]]
            child = rest[order][head]
            keys.append(edge[order][head])
            nodes.append(child)
            below = child[np.cumsum(head) - 1]
            rest, parent = rest[order][~head], below[~head]
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        nodes = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        order = np.argsort(keys)
        self.edge, self.child = keys[order], nodes[order]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, partner) of row numbers at most ``radius`` bits apart, a query's own row left out."""
        query, node = queries, self.root[queries]
        while len(query):
            apart = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
            hit = (apart <= radius) & (query != node)
            yield query[hit], node[hit]
            # a node's children stand side by side by distance: the open ones are one range
            low = np.searchsorted(self.edge, node * 65 + np.maximum(apart - radius, 0), "left")
            count = np.searchsorted(self.edge, node * 65 + np.minimum(apart + radius, 64), "right") - low
            at = np.arange(count.sum()) + np.repeat(low - np.cumsum(count) + count, count)
            query, node = np.repeat(query, count), self.child[at]


def group_roots(values: np.ndarray, groups: np.ndarray, radius: int) -> np.ndarray:
    """Row number of the first member of each row's component, links within groups only."""
    n = len(values)
    label = np.arange(n)
    alone = np.r_[True, groups[1:] != groups[:-1]] & np.r_[groups[1:] != groups[:-1], True] if n else np.zeros(0, bool)
    forest, asks = BkForest(values, groups), np.flatnonzero(~alone)
    for at in range(0, len(asks), SEARCH_ROWS):
        for a, b in forest.within(asks[at:at + SEARCH_ROWS], radius):
            while len(a):
                x, y = label[a], label[b]
                low, high = np.minimum(x, y), np.maximum(x, y)
                open_ = low != high
                if not open_.any():
                    break
                np.minimum.at(label, high[open_], low[open_])
                a, b = a[open_], b[open_]
                label = _jump(label)
    return _jump(label)


def _jump(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Star edges (a, b) between fingerprints; their components are those of all links."""
    ship(distinct.sparkSession)
    width = 64 // BLOCKS
    blocks = [F.shiftrightunsigned("fingerprint", width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(BLOCKS)]
    pairs = list(combinations(range(BLOCKS), BLOCKS - radius))
    shard = F.array(*[F.concat_ws("-", F.lit(k), *[blocks[i] for i in pair]) for k, pair in enumerate(pairs)])
    sent = (distinct.select("fingerprint", F.explode(shard).alias("shard"))
            .select("fingerprint", F.xxhash64("shard").alias("shard")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            held = tuple(np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("fingerprint", "shard")))
            if len(held[0]) >= FOREST_ROWS:
                cut = int(np.searchsorted(held[1], held[1][-1]))  # the last group may go on
                if cut:
                    yield _edges(held[0][:cut], held[1][:cut])
                    held = (held[0][cut:], held[1][cut:])
        if len(held[0]):
            yield _edges(*held)

    def _edges(values, groups):
        root = group_roots(values, groups, radius)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(values[moved]), pa.array(values[root[moved]])], names=["a", "b"])

    return (sent.repartition("shard").sortWithinPartitions("shard", "fingerprint")
            .mapInArrow(run, "a long, b long").distinct())


def components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, text: str = "text",
               doc_id: str = "doc_id") -> DataFrame:
    """doc_id, key, fingerprint, root (a fingerprint that names the component) and component_id of every row."""
    rows = stored(fingerprints(docs, shingle, text=text, doc_id=doc_id), "fingerprints")
    distinct = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_doc")), "distinct")
    roots = stars(links(distinct, radius))
    of = (distinct.join(roots, distinct["fingerprint"] == roots["node"], "left")
          .select("fingerprint", "first_doc", F.coalesce("root", "fingerprint").alias("root")))
    names = of.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return rows.join(of.join(names, "root").select("fingerprint", "root", "component_id"), "fingerprint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, text: str = "text",
                    doc_id: str = "doc_id") -> DataFrame:
    """doc_id, key, fingerprint and component_id of every row.

    component_id is the smallest doc_id that links reach, the row's own included. Texts without words
    have fingerprint 0 and link like any other. Repeated rows are kept, each with its result; rows
    without doc_id take part in links but never name a component, so it is null where all are such.
    An empty table gives no rows. Other columns are ignored, whatever their names. Texts are read whole.
    """
    return components(docs, shingle, radius, text, doc_id).select("doc_id", "key", "fingerprint", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component of near duplicates: the one with the smallest doc_id.

    Among rows of that doc_id the smallest text hash stays, and one of equal rows. A row without
    doc_id stays only where its component has no other. Texts without words are near duplicates of
    each other. Columns keep their order, whatever their names; an empty table stays empty.
    """
    found = stored(components(docs, shingle, radius).select("doc_id", "key", "root"), "components")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    kept = (found.withColumn("order", order).groupBy("root").agg(F.min("order").alias("o"))
            .select(F.col("o.doc_id").alias("_doc"), F.col("o.key").alias("_key")))
    again = (found.groupBy("doc_id", "key").agg(F.count("*").alias("_rows"))
             .select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "_rows"))
    kept = kept.join(again, kept["_doc"].eqNullSafe(again["_d"]) & (kept["_key"] == again["_k"])).select("_doc", "_key", "_rows")
    kept = stored(kept, "kept")
    # the row travels as one struct, so its columns may have any name
    rows = docs.select(F.struct("*").alias("row"), row_key(F.col("text")).alias("_row_key"))
    met = rows.join(kept, F.col("row.doc_id").eqNullSafe(kept["_doc"]) & (F.col("_row_key") == kept["_key"]))
    once = met.filter("_rows = 1").select("row.*")
    more = met.filter("_rows > 1").dropDuplicates(["_doc", "_key"]).select("row.*")
    return once.unionByName(more)


def component_digests(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id."""
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
