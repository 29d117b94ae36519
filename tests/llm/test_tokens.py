"""BPE automaton and token files against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import awkward, awkward_texts, empty
from tokenizers import Tokenizer

from saleloom.llm import bpe, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(n=3000):
    rnd = random.Random(1)
    alphabet = "aabbeeiinnttthhsrlo  '.,!1234ééÉßñ́Σσς<|startoftext|>İKΩ日本\x1c\x85\xa0²½_-—😀\n\t"
    out = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    return out + ["a" * 5000, "ha" * 3000, "<|endoftext|>x<|startoftext|>", "", "the" * 2000, "don't we'll"]


def test_automaton_equals_library(library):
    own = bpe.codec(PATH)
    texts = random_texts()
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text) == want.ids, text
        assert own.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)
    assert own.encode(None) == []


def test_gadgets_leave_one_sequence_for_each_word():
    """Over all words of a small alphabet the automaton gives what merging by hand gives."""
    merges = [("a", "a"), ("a", "b"), ("aa", "ab"), ("b", "a"), ("aa", "aa"), ("ab", "ab"), ("ba", "b")]
    labels = ["a", "b"] + [u + v for u, v in merges]
    auto = bpe.MergeAutomaton({t: i for i, t in enumerate(labels)}, merges, suffix="")

    def by_hand(word):
        parts = list(word)
        for u, v in merges:
            i = 0
            while i < len(parts) - 1:
                if parts[i] == u and parts[i + 1] == v:
                    parts[i:i + 2] = [u + v]
                i += 1
        return parts

    for n in range(1, 10):
        for k in range(2**n):
            word = "".join("ab"[k >> i & 1] for i in range(n))
            assert [labels[i] for i in auto.encode(word)] == by_hand(word), word


def test_documents_with_ids(spark, library):
    rows = bpe.encode_documents(awkward(spark), PATH).collect()
    assert len(rows) == len(awkward_texts())
    for r in rows:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_documents(empty(spark), PATH).count() == 0
    assert bpe.token_digests(empty(spark), PATH).count() == 0


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("n", [0, 1, 7, 4095, 4096, 4097, 20000])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
    assert (token_files.from_planes(token_files.to_planes(ids, bits), n, bits) == ids).all()


@pytest.mark.parametrize("bits", [1, 8])
def test_token_files_round_trip(spark, library, tmp_path, bits):
    path = str(tmp_path / "tokens")
    token_files.write_token_files(awkward(spark), PATH, path, plane_bits=bits)
    rows = token_files.read_token_files(spark, path).orderBy("start").collect()
    texts = {}
    for d, t in awkward_texts():
        texts.setdefault(d, []).append(library.encode(t or "", add_special_tokens=False).ids + [2])
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        texts[r["doc_id"]].remove(r["ids"])
        at += r["n_tokens"]
    assert not any(texts.values())
    ids = [r["doc_id"] for r in rows]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])


def test_token_file_digests(spark, library):
    rows = token_files.token_file_digests(awkward(spark), PATH).collect()
    want = sorted(zlib.crc32(np.asarray(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
                  for _, t in awkward_texts())
    assert sorted(r["ids_crc32"] for r in rows) == want
    assert token_files.token_file_digests(empty(spark), PATH).count() == 0
