"""Repeated passages and near copies against brute force."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from fixtures import awkward, awkward_texts, docs_of, empty

from saleloom.llm import simhash, substring_dedup
from saleloom.llm.components import stars


def removed_by_hand(rows, window):
    words = [(d, [] if t is None else t.encode().split()) for d, t in rows]
    low = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i:i + window])
                low[k] = min(d, low.get(k, d))
    out = []
    for d, w in words:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if low[tuple(w[i:i + window])] < d:
                    gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("share", [5000, 2])
def test_passages(spark, monkeypatch, share):
    monkeypatch.setattr(substring_dedup, "SHARE", share)  # 2: nearly every anchor is dealt over several tasks
    rows = awkward_texts()
    got = substring_dedup.dedup(awkward(spark), digest=True).collect()
    assert sorted(map(tuple, got), key=str) == removed_by_hand(rows, 13)


def test_repetitive_passages(spark):
    rows = [(i, "a b a b " * n + "c " * m) for i, (n, m) in enumerate([(9, 3), (4, 20), (12, 0), (3, 14), (5, 30)])]
    got = substring_dedup.dedup(docs_of(spark, rows), digest=True).collect()
    assert sorted(map(tuple, got), key=str) == removed_by_hand(rows, 13)
    assert substring_dedup.dedup(empty(spark)).count() == 0


def print_by_hand(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(prints, radius=2):
    name = {p: p for p in prints}

    def top(x):
        while name[x] != x:
            x = name[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= radius:
                name[max(top(a), top(b))] = min(top(a), top(b))
    return {p: top(p) for p in prints}


def test_near_duplicates(spark):
    rows = awkward_texts()
    base = rows[30][1] + " " + rows[31][1] + " " + rows[32][1] + " " + rows[33][1]
    rows += [(500 + i, base + " tail%d" % i) for i in range(12)]
    got = simhash.component_digests(docs_of(spark, rows)).collect()
    prints = [print_by_hand(t) for _, t in rows]
    group = components_by_hand(set(prints))
    first = {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            first[group[p]] = min(d, first.get(group[p], d))
    want = [(d, f"{p:016x}", first.get(group[p])) for (d, _), p in zip(rows, prints)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash.component_digests(empty(spark)).count() == 0


def test_keep_one(spark):
    """One row of each component by bit distance, whole and unchanged."""
    rows = awkward_texts()
    base = " ".join(t for _, t in rows[30:36])
    rows += [(500 + i, base + " tail%d" % i) for i in range(12)] + [(None, "only one without a name"), (8, rows[25][1])]
    prints = [print_by_hand(t) for _, t in rows]
    group = components_by_hand(set(prints))
    want = {}
    for (d, t), p in zip(rows, prints):
        old = want.get(group[p], (None, None))
        if group[p] not in want or d is not None and (old[0] is None or d < old[0]):
            want[group[p]] = (d, t)
    docs = docs_of(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in want.values())
    texts = {}
    for d, t in rows:
        texts.setdefault(d, set()).add(t)
    assert all(r["text"] in texts[r["doc_id"]] and r["row"] == "y" and r["_key"] == 6 for r in got)
    found = {group[print_by_hand(r["text"])] for r in got}
    assert len(found) == len(got) == len(want)
    assert simhash.keep_one(empty(spark)).count() == 0


def test_forest_finds_every_partner():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << np.uint64(i)) for i in range(0, 40, 3)]
                                    + [base ^ (np.uint64(5) << np.uint64(i)) for i in range(0, 40, 7)]))
    groups = np.sort(rng.integers(0, 3, len(near)))
    forest = simhash.BkForest(near, groups)
    found = {(int(a), int(b)) for q, p in forest.within(np.arange(len(near)), 2) for a, b in zip(q, p)}
    want = {(i, j) for i in range(len(near)) for j in range(len(near))
            if i != j and groups[i] == groups[j] and int(near[i] ^ near[j]).bit_count() <= 2}
    assert found == want


def test_stars_follow_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)] + [(200 + i, 200) for i in range(30)]
    got = {r["node"]: r["root"] for r in stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 41)} | {100: 90, 95: 90} | {200 + i: 200 for i in range(1, 30)}
    assert got == want


def test_every_anchor_has_its_automaton(monkeypatch):
    """An anchor's segments stream through their own phrases alone, wherever a batch ends."""
    sizes = []
    build = substring_dedup.PhraseAutomaton.compile

    def noted(self):
        sizes.append(len(self.holders))
        return build(self)

    monkeypatch.setattr(substring_dedup.PhraseAutomaton, "compile", noted)
    rows = [(a, d, 7, 3, " ".join(f"w{a}.{i}" for i in range(15)).encode()) for a in range(20) for d in (1, 2, 5)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["anchor", "doc_id", "key", "first", "text"])
    got = [r for b in substring_dedup._by_anchor(iter([batch.slice(0, 31), batch.slice(31)]), 13) for r in b.to_pylist()]
    assert sizes[:20] == [3] * 20 and not any(sizes[20:])  # three windows of 13 in 15 words
    assert sorted((r["doc_id"], r["start"], r["end"]) for r in got) == sorted((d, 3, 18) for d in (2, 5) for _ in range(20))
    assert not sum(b.num_rows for b in substring_dedup._by_anchor(iter([]), 13))
