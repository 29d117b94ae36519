"""Ranked lexical search against scores added up word by word."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import awkward, awkward_texts, docs_of, empty

from saleloom.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [(1, "The w1 w2 of W3"), (2, "日本語 and"), (3, None), (4, ""), (5, "unheard-of"), (6, "mail 10.0.0.1 w7"),
         (6, "w8 w7"), (None, "w9 w10 w11 straße"), (7, "the the the"), (8, "İI ﬁn")]


def by_hand(rows, items, k):
    docs = [(d, Counter(TERM.findall((t or "").translate(UPPER)))) for d, t in rows]
    n_docs = sum(bool(c) for _, c in docs)
    total = sum(sum(c.values()) for _, c in docs)
    terms = {}
    for name, text in items:
        terms.setdefault(name, set()).update(TERM.findall((text or "").translate(UPPER)))
    out = []
    for name, words in terms.items():
        weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(w in c for _, c in docs) + 1))) for w in words}
        found = []
        for d, c in docs:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(weight[w] * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in words if w in c)
            if score > 0:
                found.append((-score, d is None, d))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(name, i + 1, d, -s) for i, (s, _, d) in enumerate(found[:k])]
    return sorted(out, key=str)


def benchmark_of(spark, items):
    return spark.createDataFrame([(i, t, 1.5, "x") for i, t in items], "item_id long, text string, n double, doc_id string")


@pytest.mark.parametrize("k, terms, docs_tile", [(50, 4096, 512), (3, 2, 5)])
def test_search(spark, monkeypatch, k, terms, docs_tile):
    monkeypatch.setattr(lexical_search, "TILE_TERMS", terms)
    monkeypatch.setattr(lexical_search, "TILE_DOCS", docs_tile)
    rows = awkward_texts() + [(300 + i, "w1 w2 w3 the") for i in range(9)]  # ties
    got = lexical_search.search(docs_of(spark, rows), benchmark_of(spark, ITEMS), k).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows, ITEMS, k)


def test_groups_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "GROUP_ITEMS", 2)
    monkeypatch.setattr(lexical_search, "TILE_ITEMS", 1)
    got = lexical_search.search(awkward(spark), benchmark_of(spark, ITEMS), 5).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(awkward_texts(), ITEMS, 5)


def test_empty_tables(spark):
    for docs, items in ((empty(spark), ITEMS), (awkward(spark), [])):
        got = lexical_search.search(docs, benchmark_of(spark, items))
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_terms_are_those_of_the_pattern():
    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice("abZ09 -_.@[{~\t\n\x00\x7f\x85\xa0éß日😀İ") for _ in range(40))
        assert [t.decode() for t in lexical_search.terms_of(text.encode())] == TERM.findall(text.translate(UPPER))


def test_partial_sums_stay_exact():
    """Weights so large that only a few words fit below 2**53 at once."""
    rnd = np.random.default_rng(1)
    weights = rnd.integers(2**31, 2**32, 40)
    terms = [sorted(rnd.choice(40, 25, replace=False).tolist()) for _ in range(6)]
    tile = lexical_search.ItemTile(0, terms, weights)
    assert tile.step < 3
    impacts = rnd.integers(900_000, 10**6, (7, 40))
    owner, words = np.divmod(np.arange(280), 40)
    want = [[sum(int(weights[t]) * int(row[t]) for t in item) for item in terms] for row in impacts]
    assert tile.scores(7, owner, words, impacts.reshape(-1)).tolist() == want
