"""Byte-pair encoding by a tokenization automaton.

The automaton reads tokens. It starts with one state that allows every base symbol. Each merge
(u, v) -> uv, taken in order of priority, applies one gadget: the state that u leads to is copied
without its arc v, u leads to the copy from now on, and every state that has an arc u gets an arc uv
that leads to where v led. What it accepts afterwards are exactly the token sequences that the merges
produce, so a text has one accepted sequence, and so has each of its prefixes. Encoding walks the
text once, longest arcs first: every position holds one state, and an arc leaves it only where the table
has it.

All arcs of one label lead to one state, so the table keeps a target for each label, and for each
state its copy relation: the state it copies, the arc it lacks and when the gadget ran. An arc exists
unless some copy on the way lacks it, or lacks the left part it was made from.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from saleloom.llm.common import ship

ROOT = 0
#: Texts of these characters only need lower case and a cut at white space before the library's splitter.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-ſ]*+")
#: Entries that one worker keeps of pieces it has met; beyond it drops the later half.
KEPT_PIECES = 350_000
KEPT_ARCS = 500_000


class MergeAutomaton:
    """Deterministic automaton of a merge list."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str = "</w>"):
        self.suffix = suffix
        self.labels = {i: t for t, i in vocab.items()}
        size = max(self.labels) + 1
        merges = [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges]
        made = {w for _, _, w in merges}
        self.symbols = {t: i for t, i in vocab.items() if i not in made}
        self.left = [-1] * size
        self.born = [-1] * size
        self.void = [False] * size
        self.target = [ROOT] * size
        self.copied = [-1]  # of a state: the state it was copied from at the start of its label's chain
        self.owner = [-1]  # of a state: the label whose gadget made it
        self.time = [-1]  # of a state: the merge that made it
        self.chain: list[list[int]] = [[] for _ in range(size)]  # of a label: its states in order
        self.chain_times: list[list[int]] = [[] for _ in range(size)]
        self.lacks: list[dict[int, int]] = [{} for _ in range(size)]  # of a label: arc -> time of its loss
        self.start = [ROOT] * size  # of a label: the state before its first gadget
        for k, (u, v, w) in enumerate(merges):
            self._gadget(k, u, v, w)
        self._trie()
        self.arcs: dict[int, dict[int, bool]] = {}  # rows of the table that were met
        self.kept = 0

    def _gadget(self, k: int, u: int, v: int, w: int) -> None:
        self.left[w], self.born[w] = u, k
        came = self.target[u]
        if self.void[u] or self.void[v] or not self._allows(came, v):
            self.void[w] = True
            return
        self.target[w] = self.start[w] = self.target[v]
        self.copied.append(came)
        self.owner.append(u)
        self.time.append(k)
        self.target[u] = len(self.copied) - 1
        self.chain[u].append(self.target[u])
        self.chain_times[u].append(k)
        self.lacks[u][v] = k

    def _allows(self, state: int, label: int) -> bool:
        """Is there an arc of this label out of this state?"""
        if self.void[label]:
            return False
        while state != ROOT:
            made = self.time[state]
            if self.born[label] >= made:
                label = self.left[label]  # the arc came with its left part's arc
                continue
            owner = self.owner[state]
            if self.lacks[owner].get(label, made + 1) <= made:
                return False
            older = bisect.bisect_right(self.chain_times[owner], self.born[label])
            state = self.chain[owner][older - 1] if older else self.start[owner]
        return True

    def _trie(self) -> None:
        """Labels by their symbols, so that all labels that begin at a position are met in one walk."""
        spelled: dict[int, tuple[int, ...]] = {i: (i,) for i in self.symbols.values()}
        order = sorted((b, w) for w, b in enumerate(self.born) if b >= 0)
        right = self._right
        for _, w in order:
            spelled[w] = spelled[self.left[w]] + spelled[right(w)]
        spelling = {i: t for t, i in self.symbols.items()}
        self.trie: dict[str, list] = {}
        for w, symbols in spelled.items():
            if self.void[w]:
                continue
            node, entry = self.trie, None
            for s in symbols:
                entry = node.setdefault(spelling[s], [-1, {}])
                node = entry[1]
            entry[0] = w

    def _right(self, w: int) -> int:
        return self._ids[self.labels[w][len(self.labels[self.left[w]]):]]

    @property
    def _ids(self) -> dict[str, int]:
        if not hasattr(self, "_by_label"):
            self._by_label = {t: i for i, t in self.labels.items()}
        return self._by_label

    @property
    def states(self) -> int:
        return len(self.copied)

    def encode(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-split word, whose characters are base symbols."""
        if not word:
            return ()
        read = list(word)
        read[-1] += self.suffix
        n, trie, arcs, target = len(read), self.trie, self.arcs, self.target
        state, arc, begin = [ROOT] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        open_at = [0]
        while open_at:
            j = open_at.pop()
            if j == n:
                break
            here = state[j]
            known = arcs.get(here)
            if known is None:
                known = arcs[here] = {}
            node, i = trie, j
            while i < n:
                entry = node.get(read[i])
                if entry is None:
                    break
                label, node = entry
                i += 1
                if label < 0 or arc[i] >= 0:
                    continue
                there = known.get(label)
                if there is None:
                    there = known[label] = self._allows(here, label)
                    self.kept += 1
                if there:  # the one accepted way to get here, so no position is met twice
                    arc[i], begin[i], state[i] = label, j, target[label]
                    open_at.append(i)
        if self.kept >= KEPT_ARCS:
            arcs.clear()
            self.kept = 0
        out, at = [], n
        while at:
            out.append(arc[at])
            at = begin[at]
        return tuple(out[::-1])


class Codec:
    """Whole texts to ids and back, with the splitter and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.automaton = MergeAutomaton(spec["model"]["vocab"], map(tuple, spec["model"]["merges"]),
                                        spec["model"]["end_of_word_suffix"] or "")
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.label = dict(self.automaton.labels) | {i: t for t, i in self.special.items()}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _piece(self, piece: str) -> tuple[int, ...]:
        if piece.isascii() and piece.isprintable():  # then every character stands for its byte
            words = self.words.findall(piece)
        else:
            words = [word for word, _ in self.splitter.pre_tokenize_str(piece)]
        if len(words) == 1:
            ids = self.automaton.encode(words[0])
        else:
            ids = ()
            for word in words:
                ids += self.pieces.get(word) or self.automaton.encode(word) if word.isascii() \
                    else self.automaton.encode(word)
        if len(piece) <= 64:
            self.pieces[piece] = ids
        return ids

    def _plain(self, text: str) -> list[int]:
        ids: list[int] = []
        if PLAIN.fullmatch(text):
            parts = text.lower().split()
        else:
            parts = self.normalizer.normalize_str(text).split(" ")
        if len(self.pieces) >= KEPT_PIECES:  # what came first is what comes often
            self.pieces = dict(islice(self.pieces.items(), KEPT_PIECES // 2))
        known, extend = self.pieces.get, ids.extend
        for part in parts:
            found = known(part)
            extend(self._piece(part) if found is None else found)
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Special tokens first, as they stand in the text; None and the empty text give no ids."""
        if not text:
            return []
        if self.cut is None or "<|" not in text:
            return self._plain(text)
        ids: list[int] = []
        for part in self.cut.split(text):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                ids += self._plain(part)
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """The labels of the arcs taken, separated as the tokenizer file has it: by one blank."""
        return " ".join(map(self.label.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One automaton for each worker and vocabulary file."""
    return Codec(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` (text) for every row.

    A null or empty text has no ids and decodes to the empty text. Rows are handled one by one, so
    repeated rows give repeated results; columns of ``docs`` named like the new ones are replaced.
    """
    ship(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "decoded")]
    schema = T.StructType(kept + [T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
                                  T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in _slices(batch, text):
                ids = [own.encode(t) for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(map(own.decode, ids), pa.string())],
                    names=[*part.schema.names, "ids", "decoded"])

    return docs.select(*[_quoted(f.name) for f in kept]).mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, the digests taken where the ids arise."""

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for value in batch.column("text"):
                ids = own.encode(value.as_py())
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest())
                of_text.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()),
                 pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.selectExpr("doc_id", f"`{text}` AS text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _slices(batch: pa.RecordBatch, text: str, rows: int = 200) -> Iterator[pa.RecordBatch]:
    """Small parts, so that what a batch makes stays bounded by a few hundred texts."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
