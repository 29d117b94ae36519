"""Token ids as files: ids in document order, shuffled into bit or byte planes, compressed by plane.

A file set is a Parquet table that Spark writes and commits by task, so a lost executor leaves no half
file. One row is one chunk: some whole documents of one shard in ascending order, their ids cut into
blocks of fixed size, every block transposed into planes, every plane of the chunk compressed with
zstandard. The other columns are the chunk index: shard, place in the shard, documents and lengths.
Shards follow each other in document order; ``starts`` of the shards come from one sum by shard.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleloom.llm.bpe import PLAIN
from saleloom.llm.common import row_key, ship
from saleloom.session import new_folder

END_ID = 2
BLOCK = 4096  # ids transposed together; the last block of a chunk is shorter
CHUNK = 1 << 16  # a chunk ends with the document that reaches so many ids
KEPT_PIECES = 400_000  # a worker's words; a full store drops its later half, as frequent words are met early
PART_BYTES = 4 << 20  # of texts whose words are numbered together
FEW_TEXTS = 16  # fewer are not worth numbering their words
MARKS = frozenset(".,;:!?")  # one at the end of a word is a token of its own

CHUNKS = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("chunk", T.LongType()),
    T.StructField("first_id", T.LongType()), T.StructField("n_ids", T.LongType()),
    T.StructField("plane_bits", T.IntegerType()), T.StructField("block", T.IntegerType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())),
    T.StructField("planes", T.ArrayType(T.BinaryType())),
])
_ARROW = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("first_id", pa.int64()), ("n_ids", pa.int64()),
                    ("plane_bits", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                    ("lengths", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary()))])


class _Pieces(dict):
    """Ids of known words; a known word and a known mark are put together, other words are noted and answered by None."""

    def __init__(self):
        super().__init__()
        self.unmet: set[str] = set()

    def __missing__(self, word: str) -> bytes | None:
        if word[-1:] in MARKS and word[:-1].isalpha():
            base, mark = self.get(word[:-1]), self.get(word[-1])
            if base is not None and mark is not None:
                return base + mark
        self.unmet.add(word)
        return None


class LibraryEncoder:
    """The tokenizers library, asked once for each word that a worker meets.

    Texts of PLAIN characters are cut at white space and their new words, by the file's own pattern, go
    to the library in one text; the last token of a word ends with the suffix, which cuts the answer.
    Where a text has other characters or special tokens, the library gets it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores run tasks already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # the same model for words that are cut and in lower case already
        bare = spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "WhitespaceSplit"}, spec["pre_tokenizer"]["pretokenizers"][-1]]}}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        suffix, vocab = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
        self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.pieces = _Pieces()

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, new: set[str]) -> None:
        """Ask the library for words that are not known yet."""
        pieces, words, others = self.pieces, set(), []
        for p in new:
            if p.isalpha():  # one word
                words.add(p)
            elif p[-1:] in MARKS and p[:-1].isalpha():  # a word and a mark
                words.update((p[:-1], p[-1]))
            else:
                others.append((p, self.words.findall(p)))
                words.update(others[-1][1])
        words = [w for w in words if w not in pieces]
        if words:
            ids = np.asarray(self.bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(words):
                raw, ends = ids.tobytes(), (ends * 4).tolist()
                pieces.update(zip(words, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
            else:
                pieces.update((w, self._whole(w)) for w in words)
        pieces.update((p, b"".join(map(pieces.__getitem__, found))) for p, found in others)

    def _room(self) -> None:
        """Drop the later half of a full store."""
        if len(self.pieces) > KEPT_PIECES:
            for word in list(islice(self.pieces, KEPT_PIECES // 2, None)):
                del self.pieces[word]

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of each word; those met for the first time are learned together."""
        pieces = self.pieces
        found = list(map(pieces.__getitem__, words))
        if pieces.unmet:
            new, pieces.unmet = pieces.unmet, set()
            self._learn(new)
            found = [pieces[w] if f is None else f for w, f in zip(words, found)]
        return found

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; none for null and the empty text.

        The words of all texts are numbered first, so each distinct one is looked up once.
        """
        self._room()
        out, rows, plain = [b""] * len(texts), [], []
        for i, text in enumerate(texts):
            if text and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
                rows.append(i)
                plain.append(text.lower())
            elif text:
                out[i] = self._whole(text)
        if plain:
            split = [t.split() for t in plain] if len(plain) < FEW_TEXTS else None
            if split is not None:
                for i, words in zip(rows, split):
                    out[i] = b"".join(self._known(words))
            else:
                split = pc.utf8_split_whitespace(pa.array(plain, pa.large_string()))
                numbered = split.flatten().dictionary_encode()
                found = self._known(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
                at, codes, of = split.offsets.to_pylist(), numbered.indices.to_numpy().tolist(), found.__getitem__
                for i, a, b in zip(rows, at, at[1:]):
                    out[i] = b"".join(map(of, codes[a:b]))
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def encoder_of(path: str) -> LibraryEncoder:
    """The encoder of a file; a worker keeps it, and the words it has met, from task to task."""
    return LibraryEncoder(path)


def to_planes(ids: np.ndarray, plane_bits: int = 8, block: int = BLOCK) -> list[bytes]:
    """Planes of 32-bit ids, each compressed: 4 byte planes or 32 bit planes, block after block."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    planes: list[list[bytes]] = [[] for _ in range(32 // plane_bits)]
    for at in range(0, len(raw), block):
        part = raw[at:at + block]
        if plane_bits == 8:
            rows = np.ascontiguousarray(part.T)
        else:
            rows = np.packbits(np.unpackbits(part, axis=1, bitorder="little").T, axis=1, bitorder="little")
        for plane, row in zip(planes, rows, strict=True):
            plane.append(row.tobytes())
    pack = zstandard.ZstdCompressor(level=1).compress
    return [pack(b"".join(p)) for p in planes]


def from_planes(planes: list[bytes], n: int, plane_bits: int = 8, block: int = BLOCK) -> np.ndarray:
    """The ids that ``to_planes`` was given."""
    unpack = zstandard.ZstdDecompressor().decompress
    raw = [np.frombuffer(unpack(p), dtype=np.uint8) for p in planes]
    out = np.empty((n, 4), dtype=np.uint8)
    at = 0
    for begin in range(0, n, block):
        rows = min(block, n - begin)
        width = rows if plane_bits == 8 else (rows + 7) // 8
        part = np.stack([r[at:at + width] for r in raw])
        if plane_bits == 1:
            bits = np.unpackbits(part, axis=1, bitorder="little")[:, :rows]
            out[begin:begin + rows] = np.packbits(bits.T, axis=1, bitorder="little")
        else:
            out[begin:begin + rows] = part.T
        at += width
    return out.reshape(-1).view("<u4")


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, plane_bits: int = 8,
                      text: str = "text", doc_id: str = "doc_id") -> None:
    """Write the ids of every row, with ``end_id`` after each document, in ascending order of doc_id.

    Null and empty texts hold the end id only. Rows without doc_id come first; rows of one doc_id
    stand side by side, ordered by their text's hash. An empty table writes an empty file set.
    """

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = encoder_of(tokenizer), TaskContext.get().partitionId()
        end = np.asarray([end_id], dtype="<u4").tobytes()
        chunk, first, held, names, lengths = 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "chunk": chunk, "first_id": first, "n_ids": len(ids), "plane_bits": plane_bits,
                "block": BLOCK, "doc_ids": names, "lengths": lengths, "planes": to_planes(ids, plane_bits)}], _ARROW)

        size = 0
        for batch in batches:
            step = max(100, min(4000, PART_BYTES * batch.num_rows // max(1, batch.nbytes)))
            for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                encoded = encoder.encode_all(part.column("text").to_pylist())
                for name, ids in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                    held += (ids, end)
                    names.append(name)
                    lengths.append(len(ids) // 4 + 1)
                    size += lengths[-1]
                    if size >= CHUNK:
                        yield close()
                        chunk, first, size, held, names, lengths = chunk + 1, first + size, 0, [], [], []
        if held:
            yield close()

    rows = docs.selectExpr(f"CAST(`{doc_id}` AS BIGINT) AS doc_id", f"`{text}` AS text")
    key = row_key(F.col("text"))
    placed = rows.repartitionByRange("doc_id", key).sortWithinPartitions("doc_id", key)
    placed.mapInArrow(run, CHUNKS).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens and ids, or their CRC-32 instead of the ids."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    sizes = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row for each shard, which is as many as the writing job had tasks
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    last = T.StructField("ids_crc32", T.LongType()) if digest else T.StructField("ids", T.ArrayType(T.LongType()))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), last])

    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = from_planes(row["planes"], row["n_ids"], row["plane_bits"], row["block"])
                ends = np.cumsum(np.asarray(row["lengths"], dtype=np.int64))
                begins = ends - row["lengths"]
                parts = [ids[a:b] for a, b in zip(begins, ends, strict=True)]
                values = (pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()) if digest
                          else pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(begins + row["first_id"] + row["shard_start"]),
                     pa.array(row["lengths"], pa.int64()), values], names=schema.names)

    return (chunks.join(F.broadcast(starts), "shard").drop("shard", "chunk")
            .mapInArrow(run, schema))


def token_file_digests(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the file set below the shared folder, read it back and digest each document's ids."""
    spark = docs.sparkSession
    path = new_folder(spark, "tokens")
    write_token_files(docs, tokenizer, path, end_id)
    return read_token_files(spark, path, digest=True)
