"""Vector codes against whole searches in exact integers."""

import hashlib
import math

import numpy as np
import pytest

from saleloom.llm import vector_codes
from saleloom.llm.vector_codes import compare_all, follow, moved_by, next_length

SCHEMA = "vec_id long, embedding array<double>, label int, code string, _label string"


def by_hand(rows, parts=4, entries=256, rounds=4, scale=1024.0):
    kept = [(i, [max(-2**63, min(2**63 - 1, math.floor(scale * x))) for x in e], y) for i, e, y in rows
            if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return []
    width = -(-max(len(e) for _, e, _ in kept) // parts)
    kept = [(i, e + [0] * (width * parts - len(e)), y) for i, e, y in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[e[p * width:(p + 1) * width] for p in range(parts)] for _, e, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], entry)), k) for k, entry in enumerate(books[p])) for p in range(parts)]
                for c in cut]

    for _ in range(rounds):
        found = nearest()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, f in zip(cut, found) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = nearest()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [min(2**63 - 1, sum(d for d, _ in f)) for f in found]
    by_label = {}
    for (_, _, y), e in zip(kept, errors):
        by_label[y] = by_label.get(y, 0) + e
    return [(i, "".join(f"{k:02x}" for _, k in f), e, min(2**63 - 1, by_label[y]), digest) for (i, _, y), f, e in zip(kept, found, errors)]


def table_of(spark, rows):
    return spark.createDataFrame([(i, e, y, "c", "l") for i, e, y in rows], SCHEMA).repartition(3)


def clustered(n, width, seed):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(0, 1, (20, width))
    return (base[rnd.integers(0, 20, n)] + rnd.normal(0, 0.2, (n, width))).tolist()


def awkward_vectors():
    rows = [(1000 + i, e, i % 7 if i % 11 else None) for i, e in enumerate(clustered(360, 8, 1))]
    rows += [(5, None, 1), (6, [1.0, None, 2.0], 1), (7, [float("nan")] * 8, 1), (8, [float("inf")] + [0.0] * 7, None),
             (9, [], 3), (10, [0.5], 3), (None, [0.25] * 8, None), (11, rows[0][1], 2), (11, rows[0][1], 2), (12, rows[0][1], 2),
             (13, [0.0] * 8, 4), (14, [-0.0005] * 8, 4)]
    return rows


@pytest.mark.parametrize("scale", [1.0, 1e9, 1e17, 1e30])
def test_codes(spark, scale):
    """Sizes at which squares fit a double, a long, neither, and at which components are beyond a long."""
    rows = [(i, None if e is None else [None if x is None else x * scale for x in e], y) for i, e, y in awkward_vectors()]
    got = vector_codes.code_digests(table_of(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(by_hand(rows), key=str)


def test_few_and_none(spark):
    rows = [(3, [1.0, 2.0, 3.0], None), (1, [1.0, 2.0, 3.5], 2), (2, [0.0], 2)]
    assert sorted(map(tuple, vector_codes.code_digests(table_of(spark, rows)).collect())) == sorted(by_hand(rows))
    for rows in ([], [(1, None, 1)]):
        assert vector_codes.code_digests(table_of(spark, rows)).count() == 0


def test_lists_spare_work(spark):
    rows = [(i, e, 0) for i, e in enumerate(clustered(3000, 16, 2))]
    found = vector_codes.compress(table_of(spark, rows))
    shares = [d.get(-1, 0) / sum(d.values()) for _, d in found.looks]
    assert shares[0] == 1 and min(shares[1:]) < 0.7
    assert all(sum(d.values()) == 4 * 3000 for _, d in found.looks)


@pytest.mark.parametrize("b", [2, 5, 16, 300])
def test_following_equals_comparing(b):
    rnd = np.random.default_rng(b)
    x = rnd.integers(-9, 10, (2000, 3))  # many ties
    entries = rnd.integers(-9, 10, (40, 3))
    lists = compare_all(x, entries, b)
    for step in range(6):
        new = entries + rnd.integers(-1, 2, entries.shape) * (rnd.random((40, 1)) < 0.5)
        b = max(2, b + (-1, 3, 0)[step % 3])
        lists = follow(x, lists, new, moved_by(entries, new), b)
        entries, whole = new, compare_all(x, new, b)
        assert (lists.code == whole.code).all() and (lists.square == whole.square).all()
        assert (lists.near[:, 0] == lists.code).all() and lists.near.shape[1] == b
        apart = np.sqrt(((x[:, None] - entries[None]) ** 2).sum(axis=2))
        listed = lists.near >= 0
        rows = np.arange(len(x))[:, None]
        assert (lists.lower <= apart[rows, lists.near] + 1e-9)[listed].all()
        beyond = np.ones(apart.shape, bool)
        np.put_along_axis(beyond, np.where(listed, lists.near, lists.near[:, :1]), False, axis=1)
        assert (np.where(beyond, apart, np.inf).min(axis=1) >= lists.outer - 1e-9).all()


def test_length_of_lists():
    assert next_length({-1: 50, 0: 50}, 16, 256) == 32 and next_length({-1: 90}, 64, 256) == 64
    assert next_length({-1: 1, 0: 900, 3: 95, 9: 5}, 16, 256) == 4
    assert next_length({0: 100}, 16, 256) == vector_codes.SHORTEST_LIST == next_length({}, 2, 3)
