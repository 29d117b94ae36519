"""Partial sums in levels, and the ledger of files."""

import datetime

from pyspark.sql import functions as F

from saleloom.sources.ledger import Ledger, difference
from saleloom.streaming.levels import PartialSums


def sums_at(spark, tmp_path, fanout=3):
    return PartialSums(spark, f"file://{tmp_path}/sums", "k long, n long, x double", ("k",), fanout)


def batch_of(spark, b):
    return spark.createDataFrame([(k, b + k, 0.5 * b) for k in range(b % 4 + 1)], "k long, n long, x double")


def totals(df):
    return {r["k"]: (r["n"], r["x"]) for r in df.collect()}


def by_hand(last):
    out = {}
    for b in range(last + 1):
        for k in range(b % 4 + 1):
            n, x = out.get(k, (0, 0.0))
            out[k] = (n + b + k, x + 0.5 * b)
    return out


def test_levels_change_no_sum_and_bound_reading(spark, tmp_path):
    sums = sums_at(spark, tmp_path)
    assert totals(sums.read(-1)) == {} and sums.newest_batch() == -1
    for b in range(32):
        sums.put(batch_of(spark, b), b)
        before = totals(sums.read(b)) if b % 5 == 0 else None
        merged = sums.compact(b - 1)
        if before is not None:
            assert totals(sums.read(b)) == before == by_hand(b)
        line = sums.manifest()
        assert len(line["entries"]) <= 2 * 3 and b - line["covered"] <= 4 and (not merged or line["covered"] == b - 1)
    assert max(e["level"] for e in sums.manifest()["entries"]) == 3
    assert totals(sums.read(sums.newest_batch())) == by_hand(31)
    left = len(list((tmp_path / "sums/batches").iterdir()))
    assert left <= 8  # merged batches go


def test_a_repeated_or_broken_merge_changes_nothing(spark, tmp_path):
    sums = sums_at(spark, tmp_path)
    for b in range(8):
        sums.put(batch_of(spark, b), b)
        sums.compact(b - 1)
    want = by_hand(7)
    sums.put(batch_of(spark, 7), 7)  # the open batch runs again
    sums.put(batch_of(spark, 2), 2)  # and so does a merged one
    assert totals(sums.read(7)) == want
    sums._merged(1, 6, 7, [f"{sums.folder}/batches/batch=7"])  # a merge that dies before its line is written
    assert totals(sums.read(7)) == want


def listing_of(spark, files):
    rows = [(p, n, datetime.datetime(2001, 1, 1, 0, t)) for p, n, t in files]
    return spark.createDataFrame(rows, "path string, length long, modificationTime timestamp")


def states(df):
    return {r["path"]: r["status"] for r in df.collect()}


def test_ledger(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    first = listing_of(spark, [("a", 1, 0), ("b", 2, 0), ("c", 3, 0)])
    assert states(ledger.compare(first)) == dict.fromkeys("abc", "new")
    assert ledger.note(first) == 1 and states(ledger.compare(first)) == dict.fromkeys("abc", "unchanged")
    second = listing_of(spark, [("a", 1, 0), ("b", 2, 5), ("d", 4, 0), ("d", 4, 0)])
    want = {"a": "unchanged", "b": "changed", "c": "gone", "d": "new"}
    assert states(ledger.compare(second)) == want and ledger.note(second) == 2
    assert ledger.lines().filter("note = 2").count() == 3  # what has happened, not the listing
    assert states(ledger.compare(first)) == {"a": "unchanged", "b": "changed", "c": "new", "d": "gone"}
    third = listing_of(spark, [("a", 9, 0), ("b", 2, 5), ("c", 3, 0), ("d", 4, 0)])
    ledger.note(third)
    assert states(ledger.compare(third)) == dict.fromkeys("abcd", "unchanged")
    assert states(difference(listing_of(spark, []), third)) == dict.fromkeys("abcd", "gone")
    assert ledger.known().agg(F.sum("length")).first()[0] == 18
