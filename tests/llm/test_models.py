"""Quality model, exact search, registered queries and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from check_queries import difference
from fixtures import awkward, awkward_texts, docs_of, empty
from pyspark.sql import functions as F

import corpus_pipeline
from saleloom.llm import quality, topk
from saleloom.llm.common import table
from saleloom.llm.queries import QUERIES, SQL


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # no single feature tells
    model = quality.AdditiveModel.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.95
    assert (0, 1) in model.pairs


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3))
    model = quality.AdditiveModel.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    for row, score in zip(x[:20], model.score(x[:20])):
        bins = [int((e <= v).sum()) for e, v in zip(model.edges, row)]
        logit = model.base + sum(t[b] for t, b in zip(model.tables, bins))
        logit += sum(t[bins[a], bins[b]] for (a, b), t in zip(model.pairs, model.pair_tables))
        assert score == pytest.approx(1 / (1 + np.exp(-logit)))


def test_degenerate_fits():
    x = np.zeros((0, 3))
    assert quality.AdditiveModel.fit(x, np.zeros(0)).score(np.ones((2, 3))).tolist() == [0.5, 0.5]
    assert (quality.AdditiveModel.fit(np.ones((50, 3)), np.ones(50)).score(np.ones((2, 3))) > 0.9).all()


def test_quality_of_held_out_rows(spark, sf_dir):
    docs = table(spark, sf_dir.replace("0.001", "0.1"), "documents")
    labels = table(spark, sf_dir.replace("0.001", "0.1"), "labels")
    got = quality.scored(docs, labels).toPandas().merge(labels.select("doc_id", "quality").toPandas(), on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.97


def test_quality_of_awkward_rows(spark):
    rows = awkward_texts()
    labels = spark.createDataFrame([(100 + i, i % 2, None) for i in range(40)] + [(None, 1, 0), (6, None, 1), (7, 5, 1), (100, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.scored(awkward(spark), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert quality.scored(empty(spark), labels).count() == 0
    assert {r["score"] for r in quality.scored(awkward(spark), labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(awkward(spark), labels)
    assert kept.columns == awkward(spark).columns
    assert kept.count() == sum(r["predicted"] for r in got)


def top_by_hand(rows, k):
    ints = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(ints):
        if q is None or q % 50:
            continue
        found = [(-sum(x * y for x, y in zip(a, b)), 2**63 if c is None else c) for i, (c, b) in enumerate(ints) if i != at]
        out += [(q, r + 1, None if c == 2**63 else c, -s) for r, (s, c) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("part_rows", [16_384, 40])
def test_top_k(spark, monkeypatch, part_rows):
    monkeypatch.setattr(topk, "PART_ROWS", part_rows)
    rnd = random.Random(6)
    rows = [(i, [round(rnd.gauss(0, 0.3), 2) for _ in range(6)]) for i in range(300)]
    rows += [(50, rows[7][1]), (301, rows[7][1]), (302, rows[7][1]), (None, rows[8][1]), (350, None), (400, [1.0, None]), (450, [1.0, float("nan")]),
             (500, [float("inf")]), (550, []), (600, [0.5, 0.25]), (7, rows[7][1])]
    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    got = topk.top_k(frame, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == top_by_hand(rows, 5)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(frame.limit(1), F.lit(True)).count() == 0


def test_pivots_spare_candidates():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16)) * 300
    matrix = np.rint(centres[rng.integers(0, 20, 6000)] + rng.normal(size=(6000, 16)) * 5).astype(np.int64)
    table_ = topk.PivotTable(np.arange(6000), np.arange(6000), matrix, matrix[:16])
    best, score, seen = table_.search(5, matrix[5], 5)
    want = np.lexsort((np.arange(6000), -(matrix @ matrix[5])))
    assert best.tolist() == [i for i in want.tolist() if i != 5][:5] and seen < 3000


def test_large_components():
    matrix = np.array([[2**40, 2**40], [2**62, 2**62], [-2**62, 1]])
    assert topk._scores(matrix, np.array([2**20, 1])).tolist() == [2**60 + 2**40, 2**63 - 1, -2**63]


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).toPandas()
    assert len(rows) > 0
    assert difference(rows, con.execute(SQL[name]).df()) == ""


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = corpus_pipeline.run(spark, sf_dir)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_classifier" and len(corpus_pipeline.STAGES) == 5
    assert 0 < out.count() < docs.count()
    assert out.select("doc_id").distinct().count() == out.count()


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, sf_dir, stage):
    rows = docs_of(spark, awkward_texts()).drop("key", "ids", "row", "_key")
    out = stage(spark, rows, sf_dir)
    if stage is not corpus_pipeline.as_tokens:
        assert out.columns == rows.columns
    assert out.count() <= rows.count()
    assert stage(spark, rows.limit(0), sf_dir).count() == 0
