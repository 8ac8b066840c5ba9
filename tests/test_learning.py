"""Learned parts against numpy and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.operators import field as D
from mnemora.operators import learning as E
from mnemora.operators import spectral as S
from mnemora.plans.registry import Registry, due_jobs


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(5)
    centres = np.array([[0, 0, 0], [6, 0, 0], [0, 6, 0]], float)
    x = np.concatenate([c + 0.4 * rng.standard_normal((25, 3)) for c in centres] + [np.array([[30.0, 30, 30], [-30, 5, 1]])])
    return x, np.array([0] * 25 + [1] * 25 + [2] * 25 + [9, 9])


def frame(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id bigint, vector array<double>").repartition(3)


def brute_dbscan(x, radius, least):
    d = np.linalg.norm(x[:, None] - x[None], axis=2) <= radius + 1e-9
    core = np.flatnonzero(d.sum(1) >= least)
    label = {int(i): int(i) for i in core}
    while True:
        new = {i: min(label[j] for j in label if d[i, j]) for i in label}
        if new == label:
            break
        label = new
    out = dict(label)
    dist = np.linalg.norm(x[:, None] - x[None], axis=2)
    for i in range(len(x)):
        if i not in label:
            near = [(dist[i, j].round(9), label[j]) for j in label if d[i, j]]
            if near:
                out[i] = min(near)[1]
    return out


def test_density_groups_equal_brute_force(spark, blobs):
    x, _ = blobs
    for radius, least in ((0.8, 4), (0.4, 3), (0.1, 5)):
        got = {r.id: r.cluster for r in E.dense_groups(frame(spark, x), radius=radius, least=least).collect()}
        assert got == brute_dbscan(x, radius, least)


def test_spectral_groups_part_blobs(spark, blobs):
    x, label = blobs
    x, label = x[:75], label[:75]
    got = {r.node: r.cluster for r in S.power_groups(S.affinity(frame(spark, x), 6), 3, rounds=20).collect()}
    assert len(got) == 75
    assert len({(label[k], c) for k, c in got.items()}) == 3


def test_centres_after_rounds(spark, blobs):
    x, _ = blobs
    c = x[[0, 30, 60]].copy()
    for _ in range(3):
        home = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[home == k].mean(0) for k in range(3)])
    first = spark.createDataFrame([(k, x[i].tolist()) for k, i in enumerate((0, 30, 60))], "shard bigint, vector array<double>")
    got = {r.shard: r.vector for r in E.kmeans(frame(spark, x), first, 3).collect()}
    assert np.allclose([got[k] for k in range(3)], c)


def test_principal_directions(spark, blobs):
    x, _ = blobs
    mean, top = E.principal(frame(spark, x), 2)
    u, s, vt = np.linalg.svd(x - x.mean(0))
    assert np.allclose(mean, x.mean(0)) and np.allclose(np.abs(top @ vt[:2].T), np.eye(2), atol=1e-6)
    p = E.projected(frame(spark, x), top, mean).collect()
    assert all(np.allclose(r.vector, top @ (x[r.id] - mean)) for r in p)
    flat = E.without_direction(frame(spark, x), top[0]).collect()
    assert all(abs(np.dot(r.vector, top[0])) < 1e-9 for r in flat)
    assert E.covariance(frame(spark, x).where("false"))[2] == 0


def test_word_vectors_keep_the_information(spark):
    texts = ["cats chase mice", "dogs chase cats", "mice eat cheese", "cats eat fish", "dogs eat meat", "boats sail seas", "ships sail seas", "boats cross seas", "ships cross seas"] * 4
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "doc_id bigint, text string")
    w = {r.term: np.array(r.vector) for r in E.word_vectors(docs, "text", dim=4, vocabulary=50, least=2).collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in w.values())
    assert w["boats"] @ w["ships"] > 0.9 > 0.5 > abs(w["boats"] @ w["dogs"])
    words = spark.createDataFrame([(k, v.tolist()) for k, v in w.items()], "term string, vector array<double>")
    shares = E.word_shares(docs, "text")
    p = {r.term: r.p for r in shares.collect()}
    got = {r.doc_id: r.vector for r in E.sentence_vectors(docs, "doc_id", "text", words, shares, 0.01).collect()}
    weight = {t: 0.01 / (0.01 + p[t]) for t in texts[0].split()}
    assert np.allclose(got[0], sum(weight[t] * w[t] for t in weight) / sum(weight.values()))
    assert 99 not in got
    assert E.word_vectors(docs.where("false"), "text").count() == 0


def test_ema_equals_the_fold(spark):
    x = [3.0, -1.0, 4.0, 1.0, 5.0]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(x)] + [("k", 9, None)], "k string, i int, v double")
    e = 2.0
    for v in x:
        e = 0.9 * e + 0.1 * v
    assert abs(E.ema(df, "k", ["i"], "v", rate=0.1, start=2.0).first().ema - e) < 1e-9
    s = 0.0
    for v in x:
        s = 0.8 * s + 0.5 * v
    assert abs(E.state_space(df, "k", ["i"], "v", decay=0.8, gain=0.5).first().state - s) < 1e-9


def test_ball_maps_are_inverse(spark):
    df = spark.createDataFrame([([0.1, 0.2, -0.3],)], "v array<double>").withColumn("p", E.exp_map("v", 0.85)).withColumn("b", E.log_map("p", 0.85))
    r = df.withColumn("z", E.mobius_add("p", F.transform("p", lambda x: -x), 0.85)).first()
    assert np.allclose(r.b, r.v) and np.allclose(r.z, 0) and np.linalg.norm(r.p) < 0.85


def test_merge_candidates_look_beyond_nearer_nodes_of_a_like_phase(spark):
    rows = [(0, [0.0, 0.0], 0.0)] + [(k, [0.01 * k, 0.0], 0.1) for k in range(1, 15)] + [(20, [2.0, 0.0], 3.0), (21, [2.4, 0.0], 3.0)]
    n = spark.createDataFrame(rows, "id bigint, vector array<double>, phase double")
    got = {r.query_id: (r.id, r.distance) for r in D.merge_candidates(n, D.every(n)).collect()}
    assert got[0] == (20, 2.0) and got[21][0] == 14


def test_registry_and_schedule(spark):
    seen = []
    r = Registry().register("odd", lambda df: df.where("id % 2 = 1")).register("few", lambda df: df.where("id < 6")).hook(lambda name, df: seen.append((name, df.columns)))
    assert [x.id for x in r.run(spark.range(10), ["odd", "few"]).collect()] == [1, 3, 5] and [n for n, _ in seen] == ["odd", "few"]
    with pytest.raises(KeyError):
        r.run(spark.range(3), ["none"])
    with pytest.raises(ValueError):
        r.register("odd", lambda df: df)
    jobs = {(x.step, x.job) for x in due_jobs(spark.createDataFrame([(50, 100), (50, 600), (7, 3000)], "step bigint, nodes bigint")).collect()}
    assert (50, "consolidate") in jobs and (7, "decay") in jobs and (7, "prune") not in jobs
