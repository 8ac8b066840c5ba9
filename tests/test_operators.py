"""Scoring, lexical, graph, analytics, mutation, plan and streaming operators on small tables."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemora.functions import text as T
from mnemora.functions import vectors as V
from mnemora.operators import analytics as A
from mnemora.operators import graph as G
from mnemora.operators import lexical as L
from mnemora.operators import mutations as M
from mnemora.operators import scoring
from mnemora.plans import pipeline as P
from mnemora.streaming import events as S


def vectors(spark, n=40, dim=8, seed=1):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<float>"), x.astype(np.float32).astype(float)


@pytest.mark.parametrize("kernel", ["gaussian", "cosine", "exponential", "euclidean", "dot"])
def test_topk_against_brute_force_and_in_blocks(spark, kernel):
    df, x = vectors(spark)
    q = df.where("id < 5").withColumnRenamed("id", "query_id")
    got = {(r.query_id, r.rank): r.id for r in scoring.topk(df, q, 4, kernel=kernel, block_rows=2).collect()}
    for i in range(5):
        d2 = ((x - x[i]) ** 2).sum(1)
        s = {"gaussian": np.exp(-d2 / 2), "cosine": x @ x[i] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[i]), "exponential": np.exp(-np.sqrt(d2)), "euclidean": -np.sqrt(d2), "dot": x @ x[i]}[kernel].round(6)
        want = sorted(range(len(x)), key=lambda j: (-s[j], j))[:4]
        assert [got[(i, r)] for r in range(1, 5)] == want


def test_topk_nulls_ties_and_empty(spark):
    df = spark.createDataFrame([(2, [1.0, 0.0], None), (1, [1.0, 0.0], 0.5), (3, None, 1.0), (None, [1.0, 0.0], 1.0)], "id bigint, vector array<float>, amplitude double")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id bigint, vector array<float>")
    assert [(r.query_id, r.id, r.score) for r in scoring.topk(df, q, 5).orderBy("rank").collect()] == [(7, 2, 1.0), (7, 1, 0.5)]
    assert scoring.topk(df.where("id > 9"), q, 5).count() == 0
    assert scoring.topk(df, q.where("query_id > 9"), 5).count() == 0


def test_vector_expressions(spark):
    df = spark.createDataFrame([([0.5, -0.25], [0.1, 0.2])], "a array<float>, b array<float>")
    r = df.select(V.dot("a", "b").alias("d"), V.squared_distance("a", "b").alias("s"), V.poincare_distance("a", "a").alias("p"), V.quantise_int8("a").alias("q")).first()
    assert abs(r.d - 0.0) < 1e-7 and abs(r.s - (0.16 + 0.2025)) < 1e-6 and r.p == 0 and r.q.codes == [127, -64]


def test_bm25_counts_repeated_query_terms_twice(spark):
    docs = spark.createDataFrame([(1, "red red fox"), (2, "blue fox"), (3, None), (4, "")], "doc_id bigint, text string")
    key = {"doc_key": "doc_id", "doc_text": "text", "query_key": "item_id", "query_text": "query"}
    one = spark.createDataFrame([(1, "red")], "item_id bigint, query string")
    two = spark.createDataFrame([(1, "Red RED")], "item_id bigint, query string")
    a, b = (L.bm25(docs, q, **key).first().score for q in (one, two))
    assert abs(b - 2 * a) < 1e-9
    assert L.bm25(docs, spark.createDataFrame([(1, None)], "item_id bigint, query string"), **key).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("a b c d e",), ("  ",), (None,), ("Wort straße ЁЖ x_1",)], "t string")
    got = [r[0] for r in df.select(T.chunk_words("t", 3, 1)).collect()]
    assert got == [["a b c", "c d e", "e"], [], [], ["Wort straße ЁЖ", "ЁЖ x_1"]]
    assert df.select(T.tokens("t")).collect()[3][0] == ["wort", "straße", "ёж", "x_1"]
    assert df.select(T.tokens("t")).collect()[2][0] == []


def union_find(edges):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {x: find(x) for x in p}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{a:03}", f"n{a + 1:03}") for a in range(60)] + [(f"m{rng.randrange(40):03}", f"m{rng.randrange(40):03}") for _ in range(25)]
    edges = [(a, b) for a, b in edges if a != b]
    rng.shuffle(edges)
    got = {r.node: r.component for r in G.components(spark.createDataFrame(edges, "source string, target string")).collect()}
    assert got == union_find(edges)


def test_overlap_pairs_against_brute_force(spark):
    rng = random.Random(5)
    sets = {g: {rng.randrange(12) for _ in range(rng.randrange(1, 7))} for g in range(60)}
    df = spark.createDataFrame([(g, i) for g, s in sets.items() for i in s], "group bigint, item bigint")
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    assert {(r.a, r.b) for r in G.overlap_pairs(df).collect()} == want


def test_forward_chaining_stops_at_weak_bodies(spark):
    facts = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.1)], "item string, conf double")
    rules = spark.createDataFrame([(1, "d", ["a", "b"], 0.9), (2, "e", ["d"], 1.0), (3, "f", ["c"], 1.0)], "rule int, head string, body array<string>, weight double")
    got = {r.item: round(r.conf, 6) for r in G.forward_chain(facts, rules).collect()}
    assert got == {"a": 0.9, "b": 0.8, "d": 0.72, "e": 0.72}


def test_mutations(spark):
    t = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 2, "c"), (3, 1, "d"), (None, 9, "z")], "k int, v int, x string")
    assert sorted(M.upsert(t, new, "k", "v").collect()) == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]
    assert sorted(tuple(r) for r in M.snapshot_diff(t, new.where("k is not null"), "k", ["x"]).collect()) == [(1, "changed"), (2, "removed"), (3, "added")]
    n = spark.createDataFrame([(f"n{k}", k / 10, 1.0) for k in range(5)], "node_id string, salience double, amplitude double")
    assert sorted(r.node_id for r in M.beyond_capacity(n, 2).collect()) == ["n0", "n1", "n2"]
    assert M.beyond_capacity(n, 9).count() == 0
    assert M.beyond_capacity(n.where("false"), 2).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=8), st.integers(0, 200))
def test_decay_never_raises_and_keeps_its_floors(spark, values, steps):
    n = spark.createDataFrame([(v, v) for v in values], "amplitude double, salience double")
    for before, r in zip(values, M.decay(n, F.lit(0.99), F.lit(steps)).collect()):
        assert 0.05 <= r.amplitude <= max(0.05, before) and 0.025 <= r.salience <= max(0.025, before)


def test_analytics(spark):
    n = spark.createDataFrame([(0.9,), (0.05,)], "salience double")
    assert {r.bin: r.n for r in A.salience_bins(n).collect()} == {"critical": 1, "high": 0, "medium": 0, "low": 1}
    v = spark.createDataFrame([("u", float(k)) for k in range(1, 101)], "k string, v double")
    r = A.nearest_p95(v, "k", "v").first()
    assert (r.n, r.p95, r.most) == (100, 96.0, 100.0)
    import hashlib

    got = {r.k: r.m for r in spark.createDataFrame([(f"x{k}",) for k in range(20)], "k string").select("k", A.variant("k", 7).alias("m")).collect()}
    assert got == {k: int(hashlib.md5(k.encode()).hexdigest(), 16) % 7 for k in got}


def test_planner(spark):
    q = spark.createDataFrame([(1, "who is it"), (2, "why do the long days of the year end before the evening comes here")], "id int, q string")
    got = {r.id: (r.route, r.stages) for r in P.plan(q, "id", "q").collect()}
    assert got == {1: ("fast", "embed,route,retrieve"), 2: ("deep", "embed,route,retrieve,rerank,calibrate,explain")}


def run_stream(spark, tmp_path, rows, schema, make):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    df = make(S.file_stream(spark, f"file://{tmp_path}/in", schema))
    df.writeStream.format("memory").queryName("t").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.table("t").collect()


def test_streaming_rate_limit_and_breaker(spark, tmp_path):
    import datetime as dt

    at = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    rows = [("a", at(0)), ("a", at(1)), ("a", at(2)), ("a", at(61)), ("b", at(0))]
    got = run_stream(spark, tmp_path / "r", rows, "k string, t timestamp", lambda e: S.rate_limit(e, key="k", at="t", most=2, seconds=60))
    assert sorted((r.k, (r.t - at(0)).seconds, r.allowed) for r in got) == [("a", 0, True), ("a", 1, True), ("a", 2, False), ("a", 61, True), ("b", 0, True)]
    rows = [("s", at(k), True) for k in range(5)] + [("s", at(10), False), ("s", at(40), False), ("s", at(41), False)]
    got = run_stream(spark, tmp_path / "b", rows, "k string, t timestamp, f boolean", lambda e: S.circuit_breaker(e, key="k", at="t", failed="f"))
    states = [r.state for r in sorted(got, key=lambda r: r.t)]
    assert states == ["closed"] * 5 + ["open", "half_open", "closed"]


def test_field_operators(spark):
    from mnemora.operators import field as D

    df, x = vectors(spark, 30, 4, 6)
    q = df.where("id < 3").withColumnRenamed("id", "query_id")
    near = {(r.query_id, r.id) for r in D.neighbours(df, q, 2).collect()}
    for i in range(3):
        d = np.sqrt(((x - x[i]) ** 2).sum(1)).round(6)
        assert {(i, j) for j in sorted((j for j in range(30) if j != i), key=lambda j: (d[j], j))[:2]} == {p for p in near if p[0] == i}
    assert D.noise_scale(1, 0, 1e-5) == float("inf")
    rot, _ = np.linalg.qr(np.random.default_rng(2).standard_normal((4, 4)))
    pairs = spark.createDataFrame([(v.tolist(), (v @ rot + 1).tolist()) for v in x], "a array<double>, b array<double>")
    r, ma, mb = D.procrustes(pairs, "a", "b")
    assert np.abs((x - ma) @ r + mb - (x @ rot + 1)).max() < 1e-6


def test_health_of_the_whole_field(spark):
    from mnemora.operators import field as D

    rng = np.random.default_rng(5)
    x = rng.standard_normal((130, 6)) * 0.3
    x[[17, 77]] += [[9.0] * 6, [-9.0] * 6]  # no id divisible by 100 lies apart
    n = spark.createDataFrame([(k, v.tolist(), k % 6 * 1.0, 0.5) for k, v in enumerate(x)], "id bigint, vector array<double>, phase double, salience double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    mean = d.sum() / (130 * 129)
    np.fill_diagonal(d, np.inf)
    dead = {int(k) for k in np.flatnonzero(d.min(1) > np.median(d.min(1)) * 1.75)}
    assert {17, 77} <= dead == {r.id for r in D.dead_zones(n).collect()}
    h = D.whole_health(n).first()
    assert (h.nodes, h.dead, h.hyperconverged, h.state) == (130, len(dead), False, "stable")
    assert abs(h.mean_pairwise - mean) < 1e-5 and abs(h.fragmented - 2 / 130) < 1e-6
    parts = D.pairwise_distance(n, block_rows=50).first()
    assert parts.pairs == 130 * 129 and abs(parts.mean - mean) < 1e-9
    assert D.merge_candidates(n, D.every(n)).where("query_id % 100 <> 0").count() > 50
    close = D.whole_health(n.withColumn("vector", F.transform("vector", lambda v: v * 0.001))).first()
    assert close.hyperconverged and close.state == "critical"
    assert D.whole_health(n.where("false")).first().nodes == 0


def test_wrapped_documents_of_any_source(spark, tmp_path):
    from mnemora.queries import plans

    rows = [
        (1, '[{"text": "ab"}, {"text": "c"}]', "json_import"),
        (2, '{"records": [{"text": "abc"}]}', None),
        (3, 'id,text\n0,"one, ""two""\nlines"\n\n1,plain\n', "csv_import"),
        (4, "id,text\r\n0,é🙂\r\n", "notes"),
        (5, "id,text and more words\nof a note", "csv_import"),
        (6, "just words", "csv_import"),
        (7, None, "csv_import"),
        (8, "text\nalone", None),
        (9, "text,id\nfirst,3", None),
        (10, '[{"text": "cut', "json_import"),
    ]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in plans.import_records_all(spark, str(tmp_path)).collect()}
    assert got == {(1, 2, 3), (2, 1, 3), (3, 2, 21), (4, 1, 2), (9, 1, 5)}
