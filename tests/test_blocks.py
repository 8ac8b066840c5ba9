"""Scores of every document for blocks of queries: the rows of brute force, ties and odd rows among them, and no row a pair."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mnemora.operators import blocks
from mnemora.operators import lexical as L

DIR = "/root/testdata/sf0.1"
NODES = 1200
#: One for each finding F1 to F8.
QUERIES = "maxsim_phased confidence_fallback fallback_bm25 rocchio_hybrid bm25_then_resonance fusion_three_way facade_blend ranking_jaccard".split()


@pytest.fixture(scope="module")
def asking(spark, tmp_path_factory):
    """Tables in which each of 1,200 nodes asks, so that rows of pairs can't be overlooked."""
    d = str(tmp_path_factory.mktemp("asking"))
    for t in ("memory_nodes", "node_vectors"):
        n = spark.read.parquet(f"{DIR}/{t}.parquet").where(F.col("node_id") < f"m{NODES:09d}")
        n.withColumn("node_id", F.concat("node_id", F.lit("00"))).coalesce(1).write.parquet(f"{d}/{t}.parquet")
    return d


def _stages(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", QUERIES)
def test_no_row_a_pair(spark, asking, name):
    before = _stages(spark)
    assert entry.queries()[name](spark, asking).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    most = max(n for k, n in _stages(spark).items() if k not in before)
    assert most < NODES * NODES / 5  # of 1.44 million pairs


def test_bm25_best_is_bm25(spark):
    """Dense and sparse terms, ties of equal texts, empty and null texts, several blocks and a query that matches nothing."""
    texts = ["a b c", "a b c", "a a a d", "", None, "the x%d a" % 1] + [f"w{i % 7} w{i % 3} a u{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    asks = spark.createDataFrame([(1, "a b"), (2, "w1 w2 w2 u5"), (3, "nothing"), (4, ""), (5, "a"), (6, "d x1")], "query_id long, text string")
    keys = {"doc_key": "doc_id", "doc_text": "text", "query_key": "query_id", "query_text": "text"}
    want = {(r.query_id, r.doc_id, r.score) for r in L.ranked(L.bm25(docs, asks, **keys), 8).collect()}
    for size in (2, 4096):
        got = blocks.bm25_best(L.tokenised(docs, "doc_id", "text"), L.query_terms(asks, "query_id", "text"), 8, block_rows=size)
        assert {(r.query_id, r.doc_id, r.score) for r in got.collect()} == want


def test_best_keeps_lesser_ids_and_all_rows(monkeypatch):
    monkeypatch.setattr(blocks, "HELD", 50)
    rng = np.random.default_rng(1)
    s = np.round(rng.random((500, 3)), 1)  # many ties
    names = np.array([f"n{i:03d}" for i in rng.permutation(500)], object)
    for k in (4, 1000):
        best, got = blocks.Best([7, 8, 9], k, 6), {}
        for a in range(0, 500, 50):
            rows = list(best.add(s[a : a + 50], names[a : a + 50]))
            best.new = max(best.new, 100_001)
            for q, n, v in rows:
                for x in zip(q, n, v):
                    got.setdefault(x[0], []).append((-x[2], x[1]))
        for q, n, v in best.end():
            for x in zip(q, n, v):
                got.setdefault(x[0], []).append((-x[2], x[1]))
        for j, q in enumerate((7, 8, 9)):
            want = sorted((-v, n) for v, n in zip(s[:, j], names))[:k]
            assert sorted(got[q])[:k] == want


def test_group_max_is_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(f"n{i}", rng.normal(size=4).tolist(), None if i % 5 == 0 else float(rng.random() * 6), None if i % 7 == 0 else float(rng.random()), None if i % 11 == 0 else f"g{i % 3}") for i in range(60)]
    rows.append(("v", None, 0.0, 1.0, "g0"))
    n = spark.createDataFrame(rows, "id string, vector array<double>, phase double, amplitude double, group string").repartition(3)
    q = n.where("id in ('n1', 'n2', 'n5', 'n7', 'v')").withColumnRenamed("id", "query_id")
    by = {r[0]: r for r in rows}
    want = {}
    for a in ("n1", "n2", "n5"):
        for r in rows:
            if r[1] is not None and r[3] is not None and r[4] is not None:
                s = float(np.dot(by[a][1], r[1])) * math.cos((by[a][2] or 0.0) - (r[2] or 0.0)) * by[a][3] * r[3]
                want[a, r[4]] = max(want.get((a, r[4]), -math.inf), s)
    for size in (2, 4096):
        got = {(r.query_id, r.group): r.score for r in blocks.group_max(n, q, block_rows=size).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert blocks.group_max(n, q.where("false")).count() == 0
