"""Ranks, running sums and trailing windows in ranges against plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from mnemora.operators import analytics as A
from mnemora.operators import ranks


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    keys = ["hot"] * 6 + ["a", "b", None]
    return [(rng.choice(keys), rng.randrange(50), k, rng.choice([1.0, 2.5, None, 7.0])) for k in range(700)]


def grouped(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    return by


SCHEMA = "k string, v int, id int, x double"


def test_places_and_sums(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {r.id: (r.place, r.s) for r in ranks.running(ranks.running(df, ["k"], ["v", "id"]), ["k"], ["v", "id"], "v", "s").collect()}
    want = {}
    for part in grouped(rows).values():
        s = 0
        for place, r in enumerate(part, 1):
            s += r[1]
            want[r[2]] = (place, s)
    assert got == want
    whole = {r.id: r.place for r in ranks.running(df, [], [F.desc("v"), "id"]).collect()}
    assert whole == {r[2]: k for k, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])), 1)}
    assert ranks.running(df.where("false"), ["k"], ["v"]).count() == 0


def test_trailing_windows_in_blocks(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for block in (5, 64, 1000):
        x = ranks.blocks(df, ["k"], ["v", "id"], 12, block)
        w = ranks.Window.partitionBy("k", "_block").orderBy("v", "id").rowsBetween(-12, -1)
        got = {r.id: r.n for r in x.withColumn("n", F.sum("v").over(w)).where("_own").collect()}
        want = {p[i][2]: sum(r[1] for r in p[max(0, i - 12) : i]) if i else None for p in grouped(rows).values() for i in range(len(p))}
        assert got == want


def test_percentiles_of_a_hot_key(spark, rows):
    import numpy as np

    got = {r.k: (r.p50, r.p95, r.p99) for r in A.percentiles(spark.createDataFrame(rows, SCHEMA), ["k"], "x").collect()}
    for k, part in grouped(rows).items():
        x = [r[3] for r in part if r[3] is not None]
        assert got[k] == tuple(round(float(np.percentile(x, q)), 6) for q in (50, 95, 99))
