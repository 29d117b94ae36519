"""Removal of repeated passages with sharded Aho-Corasick automata over words.

A window is WINDOW consecutive words. Its anchor is the run of GRAM words in it with the smallest hash,
so equal windows have equal anchors wherever they stand, and only about every fifth word is one.

1. Anchors that two documents hold are found in one shuffle. A task that sees an anchor in several of
   its documents sends two witnesses, however many there are, so no anchor's rows pile up.
2. Documents that hold such anchors give segments: the words of the windows around one anchor.
   Segments meet by anchor; that is a shard's share of all documents. An anchor of more than SHARE
   segments is dealt over several tasks, and its segments carry the number of their share.
3. For each anchor the windows that two documents hold are confirmed word by word, with the smallest
   doc_id, and compiled into an automaton; the segments of the anchor stream through it, which locates
   every occurrence. A window has one anchor, so automata stay small and need nothing of the other anchors. The shares of a busy anchor first hand in their windows, whose smallest doc_id is taken
   overall, and get back the confirmed ones that they hold themselves, so no window travels more often than
   it occurs; then they stream their segments through the automaton of these.
4. The words of the located windows leave their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleloom.llm.common import batches_of, row_key, ship, words_of
from saleloom.session import stored

WINDOW = 13
GRAM = 5
SHARE = 20_000  # segments of one anchor that one task takes, some 2 MB
SHARD = 5_000  # segments after which a task hands on what its automata have found

_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
MASK = 2**64 - 1
_INVERSE = pow(_BASE, -1, 2**64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text, all at once."""
    b = np.frombuffer(raw, dtype=np.uint8)
    word = np.zeros(len(b) + 2, dtype=bool)
    np.logical_not(_BLANK[b], out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    begin, end = edge[::2], edge[1::2]
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[b] * _power(_BASE, len(b)), dtype=np.uint64, out=sums[1:])
    return _mix((sums[end] - sums[begin]) * _power(_INVERSE, len(b) + 1)[begin] + (end - begin).astype(np.uint64))


def anchors(raw: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each stretch of windows with one anchor: the anchor's hash, first and last window start."""
    w = word_hashes(raw)
    n = len(w) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = len(w) - gram + 1
    g = np.zeros(grams, dtype=np.uint64)
    for j in range(gram):
        g = g * np.uint64(0x9FB21C651E98DF25) + w[j:j + grams]
    g = _mix(g)
    wide = np.lib.stride_tricks.as_strided(g, (n, window - gram + 1), (8, 8), writeable=False)
    at = wide.argmin(axis=1) + np.arange(n)
    fresh = np.ones(n, dtype=bool)
    np.not_equal(at[1:], at[:-1], out=fresh[1:])
    first = np.flatnonzero(fresh)
    last = np.empty_like(first)
    last[:-1], last[-1] = first[1:] - 1, n - 1
    return g[at[first]].view(np.int64), first, last


def _shared_anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, anchors (those of the document that another doc_id holds too) and shares, over how many tasks each is dealt."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            found = [np.unique(anchors(t.as_py().encode("utf-8", "surrogatepass"), window, gram)[0], return_counts=True)
                     for t in batch.column("text")]
            if not found:
                continue
            h, n = (np.concatenate(x) for x in zip(*found))
            d = np.repeat(ids, [len(f) for f, _ in found])
            order = np.lexsort((d, h))
            h, d, n = h[order], d[order], n[order]
            if not len(h):
                continue
            fresh = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
            h, d, n = h[fresh], d[fresh], np.add.reduceat(n, fresh)
            head = np.r_[True, h[1:] != h[:-1]]
            tail = np.r_[head[1:], True]
            witness = head | tail
            for a in range(0, len(h), 200_000):
                part = slice(a, a + 200_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(witness, h, d)[part]), pa.array(witness[part]), pa.array(h[part]), pa.array(d[part]),
                     pa.array(n[part].astype(np.int32))], names=["place", "witness", "anchor", "doc_id", "times"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        for batch in batches:
            sure = ~batch.column("witness").to_numpy(zero_copy_only=False)
            new = [batch.column(c).to_numpy() for c in ("anchor", "doc_id", "times")]
            if sure.any():
                yield out(*(x[sure] for x in new))
            held = tuple(np.concatenate([x, y[~sure]]) for x, y in zip(held, new))
            if len(held[0]):
                cut = int(np.searchsorted(held[0], held[0][-1]))  # the last anchor may go on
                yield out(*several(*(x[:cut] for x in held)))
                held = tuple(x[cut:] for x in held)
        if len(held[0]):
            yield out(*several(*held))

    def several(h: np.ndarray, d: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        if not len(h):
            return h, d, n
        head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[head, len(h)])
        more = np.repeat(np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head), size)
        return h[more], d[more], n[more]

    def out(h: np.ndarray, d: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(d), pa.array(n)], names=["anchor", "doc_id", "times"])

    pairs = stored(docs.select("doc_id", "text").mapInArrow(local, "place long, witness boolean, anchor long, doc_id long, times int")
                   .repartition("place").sortWithinPartitions("witness", "anchor", "doc_id")
                   .mapInArrow(shared, "anchor long, doc_id long, times int"), "anchors")
    busy = stored(pairs.groupBy("anchor").agg(F.sum("times").alias("n")).filter(F.col("n") > SHARE)
                  .select("anchor", F.ceil(F.col("n") / SHARE).cast("int").alias("shares")), "busy")
    known = pairs.join(busy, "anchor", "left").select("doc_id", F.struct("anchor", F.coalesce("shares", F.lit(1)).alias("shares")).alias("a"))
    return (known.groupBy("doc_id").agg(F.collect_set("a").alias("a"))
            .select("doc_id", F.col("a.anchor").alias("anchors"), F.col("a.shares").alias("shares")))


def segments(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """anchor, share, doc_id, key, first (word) and text of the words around every shared anchor.

    ``docs`` has doc_id (not null), key and text. share is -1 where an anchor is not dealt.
    """
    shared = _shared_anchors(docs, window, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 100) for at in range(0, batch.num_rows, 100)):
                texts, ids, keys, hashes, firsts, places = [], [], [], [], [], []
                for doc, key, text, known, shares in zip(part.column("doc_id").to_pylist(), part.column("key").to_pylist(),
                                                         part.column("text"), part.column("anchors"), part.column("shares"), strict=True):
                    raw = text.as_py().encode("utf-8", "surrogatepass")
                    h, first, last = anchors(raw, window, gram)
                    known, shares = known.values.to_numpy(), shares.values.to_numpy().astype(np.int64)
                    hit = np.flatnonzero(np.isin(h, known))
                    if not len(hit):
                        continue
                    dealt = np.full(len(hit), -1)
                    if shares.max() > 1:
                        order = known.argsort()
                        of = shares[order][np.searchsorted(known[order], h[hit])]
                        mixed = _mix(np.uint64(doc & MASK) + first[hit].astype(np.uint64)) >> np.uint64(1)
                        dealt = np.where(of > 1, mixed.astype(np.int64) % of, -1)
                    places.append(dealt)
                    words = raw.split()
                    joined = b" ".join(words)
                    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                    begins = np.zeros_like(ends)
                    begins[1:] = ends[:-1] + 1
                    first = first[hit]
                    texts += map(joined.__getitem__, map(slice, begins[first].tolist(), ends[last[hit] + window - 1].tolist()))
                    ids.append(np.full(len(hit), doc))
                    keys.append(np.full(len(hit), key))
                    hashes.append(h[hit])
                    firsts.append(first)
                if texts:
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(np.concatenate(c)) for c in (hashes, places, ids, keys, firsts)), pa.array(texts, pa.binary())],
                        names=["anchor", "share", "doc_id", "key", "first", "text"])

    return (docs.select("doc_id", "key", "text").join(shared, "doc_id")
            .mapInArrow(run, "anchor long, share long, doc_id long, key long, first long, text binary"))


class _Numbers(dict):
    """Words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class PhraseAutomaton:
    """Windows of words with the smallest doc_id that holds them, and the automaton that finds them."""

    def __init__(self, window: int):
        self.window = window
        self.number = _Numbers()
        self.holders: dict[tuple[int, ...], list[int]] = {}

    def numbers(self, text: bytes) -> tuple[int, ...]:
        return tuple(map(self.number.__getitem__, text.split(b" ")))

    def note(self, words: tuple[int, ...], low: int, high: int) -> None:
        """A text that documents from ``low`` to ``high`` hold."""
        holders, window = self.holders, self.window
        for i in range(len(words) - window + 1):
            phrase = words[i:i + window]
            seen = holders.get(phrase)
            if seen is None:
                holders[phrase] = [low, high]
            else:
                if low < seen[0]:
                    seen[0] = low
                if high > seen[1]:
                    seen[1] = high

    def compile(self) -> ahocorasick.Automaton | None:
        """Only what two documents hold."""
        found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for phrase, (low, high) in self.holders.items():
            if low != high:
                found.add_word(phrase, low)
        if not len(found):
            return None
        found.make_automaton()
        return found

    def stretches(self, occurrences: list[tuple[int, int]], doc: int) -> list[tuple[int, int]]:
        """Stretches of words, end exclusive, of located windows that a smaller doc_id holds."""
        out: list[tuple[int, int]] = []
        for end, low in occurrences:
            if low < doc:
                begin = end - self.window + 1
                if out and begin <= out[-1][1]:
                    out[-1] = (out[-1][0], end + 1)
                else:
                    out.append((begin, end + 1))
        return out


_HITS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_HITS_TYPE = "doc_id long, key long, start long, end long"


_Hits = tuple[list[int], list[int], list[int], list[int]]  # the columns of _HITS


def _stream(rows: list[tuple], window: int, out: _Hits, given: list[tuple[bytes, int, int]] | None = None) -> None:
    """Confirm, compile and stream the segments of one anchor; with ``given`` phrases nothing is confirmed here.

    Equal segments are read once, for all documents that hold them.
    """
    phrases = PhraseAutomaton(window)
    held: dict[bytes, list[tuple]] = {}
    for row in rows:
        held.setdefault(row[3], []).append(row)
    read = [(phrases.numbers(text), same) for text, same in held.items()]
    if given is None:
        for words, same in read:
            docs = [r[0] for r in same]
            phrases.note(words, min(docs), max(docs))
    else:
        for text, low, high in given:
            phrases.holders[phrases.numbers(text)] = [low, high]
    automaton = phrases.compile()
    for words, same in read if automaton is not None else ():
        occurrences = list(automaton.iter(words))
        if not occurrences:
            continue
        last = max(low for _, low in occurrences)
        for_all = phrases.stretches(occurrences, last + 1)
        for doc, key, first, _ in same:
            for a, b in for_all if doc > last else phrases.stretches(occurrences, doc):
                out[0].append(doc)
                out[1].append(key)
                out[2].append(first + a)
                out[3].append(first + b)


def _hits(out: _Hits) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=_HITS)


def _columns(batch: pa.RecordBatch | pa.Table, *names: str) -> list[list]:
    return [batch.column(n).to_numpy(zero_copy_only=False).tolist() if isinstance(batch, pa.RecordBatch) else batch.column(n).to_numpy().tolist()
            for n in names]


def _by_anchor(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """What the automaton of each anchor locates; the rows of an anchor stand side by side."""
    rows: list[tuple] = []
    out, seen, last = ([], [], [], []), 0, None
    for batch in batches:
        for anchor, *row in zip(*_columns(batch, "anchor", "doc_id", "key", "first", "text"), strict=True):
            if anchor != last and rows:
                _stream(rows, window, out)
                seen += len(rows)
                rows = []
                if seen >= SHARD:
                    yield _hits(out)
                    out, seen = ([], [], [], []), 0
            last = anchor
            rows.append(row)
    _stream(rows, window, out)
    yield _hits(out)


def located(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key, start, end of the stretches to remove, from stored segments."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_anchor(batches, window)

    cold = (found.filter("share < 0").drop("share").repartition("anchor").sortWithinPartitions("anchor")
            .mapInArrow(whole, _HITS_TYPE))
    dealt = found.filter("share >= 0")

    def hand_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("anchor", pa.int64()), ("share", pa.int64()), ("phrase", pa.binary()), ("low", pa.int64()), ("high", pa.int64())])

        def rows() -> Iterator[dict]:
            for batch in batches:
                seen: dict[tuple[int, int, bytes], list[int]] = {}
                for anchor, share, doc, text in zip(*_columns(batch, "anchor", "share", "doc_id", "text"), strict=True):
                    words = text.split(b" ")
                    for i in range(len(words) - window + 1):
                        at = seen.setdefault((anchor, share, b" ".join(words[i:i + window])), [doc, doc])
                        at[0], at[1] = min(at[0], doc), max(at[1], doc)
                for (anchor, share, phrase), (low, high) in seen.items():
                    yield {"anchor": anchor, "share": share, "phrase": phrase, "low": low, "high": high}

        yield from batches_of(rows(), schema, 20_000)

    # a confirmed window goes back to the shares that handed it in
    confirmed = (dealt.select("anchor", "share", "doc_id", "text")
                 .mapInArrow(hand_in, "anchor long, share long, phrase binary, low long, high long")
                 .groupBy("anchor", "phrase").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_set("share").alias("shares"))
                 .filter("low < high"))
    spread = confirmed.select("anchor", F.explode("shares").alias("share"), "phrase", "low", "high")

    def against(phrases: pa.Table, rows: pa.Table) -> pa.Table:
        given = list(zip(*_columns(phrases, "phrase", "low", "high"), strict=True))
        held = list(zip(*_columns(rows, "doc_id", "key", "first", "text"), strict=True))
        _stream(held, window, out := ([], [], [], []), given)
        return pa.Table.from_batches([_hits(out)])

    hot = (spread.groupBy("anchor", "share").cogroup(dealt.groupBy("anchor", "share"))
           .applyInArrow(against, _HITS_TYPE))
    return cold.unionByName(hot)


def _prepared(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), row_key(F.col(f"`{text}`")).alias("key"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def repeated_stretches(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text",
                       doc_id: str = "doc_id") -> DataFrame:
    """doc_id, key and stretches (start, end in words) of every row that has some.

    Rows of one doc_id are one document to the others. Null and empty texts have no words; rows
    without doc_id are neither earlier nor later than others and keep all words.
    """
    ship(docs.sparkSession)
    rows = _prepared(docs, text, doc_id).filter("doc_id IS NOT NULL AND text <> ''")
    found = stored(segments(rows, window, gram), "segments")
    hits = stored(located(found, window), "stretches")
    return hits.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "end")).alias("stretches"))


def _kept(words: list[bytes], stretches: list[dict] | None) -> list[bytes]:
    if not stretches:
        return words
    keep = np.ones(len(words), dtype=bool)
    for s in stretches:
        keep[s["start"]:s["end"]] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id",
          digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (words joined by a blank) of every row, or kept_sha256 instead.

    Null and empty texts have no words; rows without doc_id keep theirs. Rows of one doc_id are one document to
    the others, and repeated rows keep each its result. Long texts are read whole, an empty table gives no rows,
    other columns are ignored, whatever their names.
    """
    found = repeated_stretches(docs, window, gram, text, doc_id).withColumnsRenamed({"doc_id": "_doc", "key": "_key"})
    rows = _prepared(docs, text, doc_id)
    met = rows.join(found, (rows["doc_id"] == found["_doc"]) & (rows["key"] == found["_key"]), "left")
    last = "kept_sha256" if digest else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                n, removed, texts = [], [], []
                for value, stretches in zip(part.column("text"), part.column("stretches"), strict=True):
                    words = words_of(value.as_py())
                    kept = _kept(words, stretches.as_py())
                    n.append(len(words))
                    removed.append(len(words) - len(kept))
                    joined = b" ".join(kept)
                    texts.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                    names=["doc_id", "n_words", "n_removed", last])

    return (met.select("doc_id", "text", "stretches")
            .mapInArrow(run, f"doc_id long, n_words long, n_removed long, {last} string"))
