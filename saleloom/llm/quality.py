"""Quality scores by a generalised additive model with pairwise interactions.

Each feature of a text falls into one of at most BINS bins. Boosting goes through the features in turn,
over and over, and adds a small step of a shallow tree on one feature's bins; the steps add up to one
lookup table a feature. Then the pairs with most left to explain get tables of their own, from trees
that cut both features once. A score is the logistic of the sum of table entries.

The model is fitted on at most SAMPLE labelled rows, those with the smallest hash of doc_id; features
and scores cover every row and come from the text alone.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleloom.llm.common import row_key, ship
from saleloom.session import stored

SAMPLE = 20_000
BINS = 32
ROUNDS, PAIR_ROUNDS, PAIRS = 200, 60, 8
RATE, PENALTY, LEAST = 0.1, 1.0, 8.0
THRESHOLD = 0.3
FOLDS = 5

FEATURES = ["log_chars", "word_length", "letters", "capitals", "symbols", "digits", "bars", "exclamations", "sentence_marks",
            "line_ends", "beyond_ascii", "distinct_words", "top_word", "distinct_pairs", "distinct_lines", "odd_endings",
            "packed"]

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~"]] = True
_PLAIN_END = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:?!)\"'") | frozenset(range(128, 256))


def features(text: str | None) -> list[float]:
    """FEATURES of one text; all zero where it is null or has no word."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, count = len(words), np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    chars = int(count.sum() - count[128:192].sum())  # bytes that begin a character
    letters, beyond = int(count[_LETTER].sum()), int(count[192:].sum())
    held = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        float(np.log1p(chars)), sum(map(len, words)) / n, letters / chars, count[_UPPER].sum() / max(1, letters),
        count[_SYMBOL].sum() / chars, count[_DIGIT].sum() / chars, count[124] / n, count[33] / n, (count[46] + count[63]) / n,
        count[10] / n, beyond / chars, len(held) / n, max(held.values()) / n, pairs / max(1, n - 1), len(set(lines)) / len(lines),
        sum(c for w, c in held.items() if w[-1] not in _PLAIN_END) / n, len(zlib.compress(raw, 1)) / len(raw)]


class AdditiveModel:
    """Lookup tables for features and pairs of features."""

    def __init__(self, edges: list[np.ndarray], base: float, tables: list[np.ndarray], pairs: list[tuple[int, int]],
                 pair_tables: list[np.ndarray]):
        self.edges, self.base, self.tables, self.pairs, self.pair_tables = edges, base, tables, pairs, pair_tables

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        """Without rows the score is 1/2; with labels of one kind it is near that label everywhere."""
        width = x.shape[1]
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0)
                 for f in range(width)]
        bins = cls._bins(x, edges)
        share = (y.sum() + 0.5) / (len(y) + 1)
        base = float(np.log(share / (1 - share)))
        tables = [np.zeros(len(e) + 1) for e in edges]
        logit = np.full(len(y), base)
        if not len(y) or y.min() == y.max():
            return cls(edges, base, tables, [], [])
        for _ in range(ROUNDS):
            for f in range(width):
                p = 1 / (1 + np.exp(-logit))
                step = cls._tree(np.bincount(bins[f], y - p, len(tables[f])), np.bincount(bins[f], p * (1 - p), len(tables[f])),
                                 np.bincount(bins[f], minlength=len(tables[f])))
                tables[f] += step
                logit += step[bins[f]]
        p = 1 / (1 + np.exp(-logit))
        pairs = cls._best_pairs(bins, [len(t) for t in tables], y - p, p * (1 - p))
        pair_tables = [np.zeros((len(tables[a]), len(tables[b]))) for a, b in pairs]
        for _ in range(PAIR_ROUNDS):
            for (a, b), table in zip(pairs, pair_tables, strict=True):
                p = 1 / (1 + np.exp(-logit))
                step = cls._quarters(bins[a], bins[b], table.shape, y - p, p * (1 - p))
                table += step
                logit += step[bins[a], bins[b]]
        return cls(edges, base, tables, pairs, pair_tables)

    @staticmethod
    def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A step of a tree with up to three leaves over the bins in order."""
        cuts = [0, len(g)]
        for _ in range(2):
            best = (1e-6, None)
            for a, b in zip(cuts, cuts[1:]):
                if b - a < 2:
                    continue
                gl, hl, nl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1], np.cumsum(n[a:b])[:-1]
                gs, hs, ns = g[a:b].sum(), h[a:b].sum(), n[a:b].sum()
                gain = gl**2 / (hl + PENALTY) + (gs - gl) ** 2 / (hs - hl + PENALTY) - gs**2 / (hs + PENALTY)
                gain = np.where((nl >= LEAST) & (ns - nl >= LEAST), gain, 0)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], a + at + 1)
            if best[1] is None:
                break
            cuts = sorted([*cuts, best[1]])
        step = np.zeros(len(g))
        for a, b in zip(cuts, cuts[1:]):
            step[a:b] = RATE * g[a:b].sum() / (h[a:b].sum() + PENALTY)
        return step

    @staticmethod
    def _grid(a: np.ndarray, b: np.ndarray, shape: tuple[int, int], v: np.ndarray | None) -> np.ndarray:
        flat = a * shape[1] + b
        return np.bincount(flat, v, shape[0] * shape[1]).reshape(shape)

    @classmethod
    def _best_pairs(cls, bins, sizes, g, h) -> list[tuple[int, int]]:
        """The pairs whose cells explain most of what their two features leave."""
        gains = []
        for a, b in combinations(range(len(bins)), 2):
            shape = (sizes[a], sizes[b])
            cg, ch = cls._grid(bins[a], bins[b], shape, g), cls._grid(bins[a], bins[b], shape, h)
            gain = (cg**2 / (ch + PENALTY)).sum()
            gain -= max((cg.sum(k) ** 2 / (ch.sum(k) + PENALTY)).sum() for k in (0, 1))
            gains.append((gain, a, b))
        return [(a, b) for gain, a, b in sorted(gains, reverse=True)[:PAIRS] if gain > 0]

    @classmethod
    def _quarters(cls, a, b, shape, g, h) -> np.ndarray:
        """A step of a tree that cuts both features once."""
        cg = cls._grid(a, b, shape, g).cumsum(0).cumsum(1)
        ch = cls._grid(a, b, shape, h).cumsum(0).cumsum(1)
        if min(shape) < 2:
            return np.zeros(shape)
        parts = []
        for c in (cg, ch):
            low, row, column, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
            parts.append((low, row - low, column - low, all_ - row - column + low))
        gain = sum(x**2 / (y + PENALTY) for x, y in zip(*parts, strict=True))
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        value = [RATE * x[i, j] / (y[i, j] + PENALTY) for x, y in zip(*parts, strict=True)]
        step = np.empty(shape)
        step[:i + 1, :j + 1], step[:i + 1, j + 1:], step[i + 1:, :j + 1], step[i + 1:, j + 1:] = value
        return step

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x, self.edges)
        logit = np.full(len(x), self.base)
        for b, table in zip(bins, self.tables, strict=True):
            logit += table[b]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            logit += table[bins[a], bins[b]]
        return 1 / (1 + np.exp(-logit))


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def text_features(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, key and features (array of double) of every row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), row_key(F.col(f"`{text}`")).alias("key"),
                       F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(found, pa.list_(pa.float64()))],
                                             names=["doc_id", "key", "features"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, key long, features array<double>")


def fit(found: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> AdditiveModel:
    """A model of the stored features, from labelled rows outside the held-out fold, at most ``sample`` of them."""
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("_doc"), F.col(label).cast("double").alias("y"))
    rows = (found.filter(~_held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("_doc"))
            .select("features", "y", "key", F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("h")))
    # only hashes below this can be among the smallest ``sample``, give or take; so no task sends many
    most = min(int(1.25 * sample / max(1, rows.count()) * 2**63), 2**63 - 1)
    rows = (rows.filter(F.col("h") <= most).orderBy("h", "key", "y").limit(sample)
            .select("features", "y").toPandas())
    x = np.array(rows["features"].tolist(), dtype=np.float64).reshape(len(rows), len(FEATURES))
    return AdditiveModel.fit(x, rows["y"].to_numpy(dtype=np.float64))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null and empty texts have all features zero and get the score that follows from that. Rows without
    doc_id are scored, never learned from. Null labels and labels other than 0 and 1 are left out;
    repeated labels count as often as they stand.
    """
    found = stored(text_features(docs), "features")
    model = fit(found, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    kind = found.schema["doc_id"].dataType.simpleString()
    out = found.select("doc_id", "features").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that score below the threshold."""
    model = fit(stored(text_features(docs), "features"), labels, sample)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                x = np.array([features(t.as_py()) for t in part.column(place)], dtype=np.float64).reshape(-1, len(FEATURES))
                yield part.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
