"""Token counts against the libraries, text by text."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from fixtures import awkward, awkward_texts, empty
from tokenizers import Tokenizer

from saleloom.llm import token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
JSON = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def random_texts(n=400):
    rnd = random.Random(3)
    alphabet = ["a", "the", "Ü", " ", " ", "  ", "\n", "\t", "▁", "9", "<s>", "</s>", "<unk>", "<0x41>", "日本", "é", " ", "."]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 120))) for _ in range(n)]


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 17])
def test_pieces_add_up(library, piece):
    texts = [t for _, t in awkward_texts() if t] + random_texts()
    count = token_counts.counter(MODEL)
    assert count.splits
    n_bytes, n_tokens = token_counts.lengths_of(pa.array(texts), count, 200, piece)
    assert n_tokens.tolist() == [len(library.encode(t)) for t in texts]
    assert n_bytes.tolist() == [len(t.encode()) for t in texts]


def test_pieces_are_whole():
    raw = b"one two  three 4 five-six " + b"x" * 50 + b" end"
    cut = list(token_counts.pieces_of(raw, 3))
    assert len(cut) > 3 and b" ".join(cut) == raw
    assert list(token_counts.pieces_of("日本 日本 日本".encode(), 1)) == ["日本 日本 日本".encode()]


def test_documents(spark, library):
    got = sorted(map(tuple, token_counts.token_counts(awkward(spark), MODEL, 50).collect()), key=str)
    sizes = [(d, len((t or "").encode()), len(library.encode(t or ""))) for d, t in awkward_texts()]
    assert got == sorted([(*s, s[2] > 50) for s in sizes], key=str)
    assert token_counts.token_counts(empty(spark), MODEL).count() == 0


def test_tokenizers_file(spark):
    library = Tokenizer.from_file(JSON)
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts.token_counts(awkward(spark), JSON).collect())
    assert got == sorted((str(d), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in awkward_texts())
