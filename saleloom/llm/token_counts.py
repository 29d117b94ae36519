"""Token counts: texts go to the library in batches of equal size in bytes, and only lengths come back.

A long text is cut into pieces first. A blank between two ASCII letters or digits is a safe place if no entry
of the vocabulary spans a word's end: then nothing merges across it, the blank itself is what the library
puts in front of every text, and the counts of the pieces add up to that of the text. Files for which
this does not hold, and texts without such a place, are counted whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleloom.llm.common import ship

LIMIT = 4096
BATCH_BYTES = 1 << 20  # of text that the library gets in one call
PIECE_BYTES = 1 << 17  # a longer text is cut

_PLACE = re.compile(rb"(?<=[0-9A-Za-z])\x20(?=[0-9A-Za-z])")
_BLANK = "▁"  # fixed value: how the library's vocabulary writes a blank


def pieces_of(raw: bytes, most: int = PIECE_BYTES) -> Iterator[bytes]:
    """Pieces of a text in UTF-8, cut at the first safe blank after ``most`` bytes; that blank is left out."""
    at = 0
    while len(raw) - at > most:
        place = _PLACE.search(raw, at + most)
        if place is None:
            break
        yield raw[at:place.start()]
        at = place.end()
    yield raw[at:]


class SentencePieceCounter:
    """Lengths as sentencepiece gives them."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        spans = re.compile(f"[^{_BLANK}]{_BLANK}")
        of = self.library.encode
        self.splits = (_BLANK in names and not any(map(spans.search, names))
                       and of("a b c") == of("a") + of("b") + of("c") and of("a")[:1] == of(" a")[1:2])

    def lengths(self, texts: list[str]) -> list[int]:
        return list(map(len, self.library.encode(texts, num_threads=1)))


class TokenizersCounter:
    """Lengths as the tokenizers library gives them; its files know no place that is safe for all."""

    splits = False

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores run tasks already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def lengths(self, texts: list[str]) -> list[int]:
        return list(map(len, self.library.encode_batch_fast(texts, add_special_tokens=False)))


@lru_cache(maxsize=2)
def counter(path: str) -> SentencePieceCounter | TokenizersCounter:
    """The library of a file, read once by each worker."""
    return TokenizersCounter(path) if path.endswith(".json") else SentencePieceCounter(path)


def lengths_of(texts: pa.Array, count: SentencePieceCounter | TokenizersCounter,
               batch_bytes: int = BATCH_BYTES, piece_bytes: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of every text of an Arrow column; one batch of pieces is held at a time."""
    n_bytes, n_tokens = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    held, rows, size = [], [], 0

    def flush() -> None:
        np.add.at(n_tokens, rows, count.lengths(held))

    for row, value in enumerate(texts):
        text = value.as_py()
        if not text:
            continue
        raw = text.encode("utf-8", "surrogatepass")
        n_bytes[row] = len(raw)
        cut = count.splits and len(raw) > piece_bytes
        for piece in pieces_of(raw, piece_bytes) if cut else (raw,):
            held.append(piece.decode("utf-8", "surrogatepass") if cut else text)
            rows.append(row)
            size += len(piece)
            if size >= batch_bytes:
                flush()
                held, rows, size = [], [], 0
    if held:
        flush()
    return n_bytes, n_tokens


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    Null and empty texts have no bytes and no tokens. Repeated rows are kept, each with its result, and so
    are rows without doc_id. Long texts are counted whole, piece by piece. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            n_bytes, n_tokens = lengths_of(batch.column("text"), count)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes), pa.array(n_tokens)],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
