"""The field of nodes around a query set: tension, health, groups active together, privacy, alignment.

All build on ``scoring.topk``: neighbours come from blocks of queries against
all nodes, never from pairs of all nodes. Null vectors take no part; ties go to
the lesser id; empty inputs give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions import vectors as V
from mnemora.operators import scoring

TWO_PI = 6.283185307179586


def neighbours(nodes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance): the k nearest other nodes."""
    near = scoring.topk(nodes.select("id", "vector"), asked.select("query_id", "vector"), k + 1, kernel="euclidean").where("id <> query_id")
    w = Window.partitionBy("query_id").orderBy("rank")
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", "id", (-F.col("score")).alias("distance"))


def tension(nodes: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, tension): how far the phases and saliences of a node's neighbours disagree."""
    n = neighbours(nodes, asked, k).join(nodes.select("id", "phase", "salience"), "id")
    sd = lambda c: F.coalesce(F.stddev_pop(c), F.lit(0.0))
    return n.groupBy("query_id").agg((0.6 * (sd(F.cos("phase")) + sd(F.sin("phase"))) + 0.4 * sd("salience")).alias("tension"))


def soft_gate(tension: Column, threshold: float = 0.15) -> Column:
    return 1 / (1 + F.exp(-(tension - threshold) / 0.15))


def health(nodes: DataFrame, asked: DataFrame, *, radius: float = 2.0, slack: float = 0.75) -> DataFrame:
    """One row: nodes asked for, dead zones (nearest neighbour beyond the median times 1 + slack), share without one in the radius, state."""
    near = neighbours(nodes, asked, 1)
    limit = near.agg(F.percentile("distance", 0.5).alias("median"))
    a = near.crossJoin(F.broadcast(limit)).agg(
        F.count("*").alias("asked"),
        F.count_if(F.col("distance") > F.col("median") * (1 + slack)).alias("dead"),
        F.avg((F.col("distance") > radius).cast("double")).alias("fragmented"),
        F.avg("distance").alias("mean"),
    )
    state = F.when((F.col("mean") < 0.05) | (F.col("fragmented") > 0.8), "critical").when((F.col("dead") > 0.3 * F.col("asked")) | (F.col("fragmented") > 0.6), "degraded").otherwise("healthy")
    return a.select("asked", "dead", F.round("fragmented", 6).alias("fragmented"), F.round("mean", 6).alias("mean"), state.alias("state"))


def pairwise_distance(nodes: DataFrame, *, block_rows: int = 4096) -> DataFrame:
    """One row (pairs, mean): over the distances of all pairs of different nodes, in blocks of nodes against all; null of no pair."""
    spark = nodes.sparkSession
    source = nodes.select("id", "vector").where("id is not null and vector is not null")

    def one(block: list) -> DataFrame:
        held = spark.sparkContext.broadcast((np.array([r.id for r in block]), np.array([r.vector for r in block], np.float64)))

        def run(batches):
            ids, q = held.value
            for b in batches:
                if len(b):
                    other = b.id.to_numpy()[:, None] != ids[None, :]
                    d = -scoring._spatial(q, np.array(b.vector.tolist(), np.float64), "euclidean", 1.0, 1.0)
                    yield pd.DataFrame({"pairs": [int(other.sum())], "total": [float(d[other].sum())]})

        return source.mapInPandas(run, "pairs bigint, total double")

    result, block = spark.createDataFrame([], "pairs bigint, total double"), []
    for r in source.toLocalIterator():
        block.append(r)
        if len(block) == block_rows:
            result, block = result.unionByName(one(block)), []
    if block:
        result = result.unionByName(one(block))
    pairs = F.coalesce(F.sum("pairs"), F.lit(0))
    return result.agg(pairs.alias("pairs"), F.when(pairs > 0, F.sum("total") / pairs).alias("mean"))


def every(nodes: DataFrame) -> DataFrame:
    """All nodes as a query set."""
    return nodes.withColumnRenamed("id", "query_id")


def dead_zones(nodes: DataFrame, *, slack: float = 0.75) -> DataFrame:
    """(id, distance) of every node whose nearest neighbour lies beyond the median of all times 1 + slack; none of fewer than three nodes."""
    near = neighbours(nodes, every(nodes), 1)
    limit = near.agg(F.percentile("distance", 0.5).alias("median"), F.count("*").alias("n"))
    return near.crossJoin(F.broadcast(limit)).where((F.col("n") >= 3) & (F.col("distance") > F.col("median") * (1 + slack))).select(F.col("query_id").alias("id"), "distance")


def whole_health(nodes: DataFrame, *, radius: float = 2.0, slack: float = 0.75, converged: float = 0.05) -> DataFrame:
    """One row on all nodes: dead zones, share without a neighbour in the radius, mean distance of all pairs, hyperconvergence, state.

    Every node is held against every other, in blocks of queries; the cost is that of all pairs.
    """
    near = neighbours(nodes, every(nodes), 1)
    limit = near.agg(F.percentile("distance", 0.5).alias("median"))
    count = nodes.where("id is not null and vector is not null").agg(F.count("*").alias("nodes"))
    a = near.crossJoin(F.broadcast(limit)).agg(
        F.count_if(F.col("distance") > F.col("median") * (1 + slack)).alias("dead"), F.coalesce(F.avg((F.col("distance") > radius).cast("double")), F.lit(0.0)).alias("fragmented")
    )
    a = a.crossJoin(count).crossJoin(pairwise_distance(nodes).select("mean")).withColumn("dead", F.when(F.col("nodes") < 3, 0).otherwise(F.col("dead")))
    a = a.withColumn("hyperconverged", F.coalesce((F.col("nodes") >= 3) & (F.col("mean") < converged), F.lit(False)))
    state = F.when(F.col("hyperconverged") | (F.col("fragmented") > 0.8), "critical").when((F.col("dead") > 0.3 * F.col("nodes")) | (F.col("fragmented") > 0.6), "degraded").otherwise("stable")
    return a.select("nodes", "dead", F.round("fragmented", 6).alias("fragmented"), F.round("mean", 6).alias("mean_pairwise"), "hyperconverged", state.alias("state"))


def merge_candidates(nodes: DataFrame, asked: DataFrame, *, reach: float = 2.5, gap: float = 1.0, block_rows: int = 4096) -> DataFrame:
    """(query_id, id, distance): the nearest node within reach whose phase lies more than ``gap`` apart on the circle.

    Blocks of queries against all nodes; a batch gives one row a query, so none is cut off by nearer nodes of a like phase.
    """
    spark = nodes.sparkSession
    source = nodes.select("id", "vector", "phase").where("id is not null and vector is not null and phase is not null")
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {nodes.schema['id'].dataType.simpleString()}, distance double"

    def one(block: list) -> DataFrame:
        held = spark.sparkContext.broadcast((np.array([r.query_id for r in block]), np.array([r.vector for r in block], np.float64), np.array([r.phase for r in block], np.float64)))

        def run(batches):
            ids, q, phase = held.value
            for b in batches:
                if not len(b):
                    continue
                d = np.round(-scoring._spatial(q, np.array(b.vector.tolist(), np.float64), "euclidean", 1.0, 1.0), 6)
                apart = np.abs(b.phase.to_numpy(float)[:, None] - phase[None, :]) % TWO_PI
                names = b.id.to_numpy()
                fit = (np.minimum(apart, TWO_PI - apart) > gap) & (d < reach) & (names[:, None] != ids[None, :])
                order = np.argsort(names, kind="stable")
                d = np.where(fit, d, np.inf)[order]
                best = d.argmin(0)
                ok = np.isfinite(d[best, np.arange(len(ids))])
                yield pd.DataFrame({"query_id": ids[ok], "id": names[order][best[ok]], "distance": d[best, np.arange(len(ids))][ok]})

        return source.mapInPandas(run, schema)

    out, block = spark.createDataFrame([], schema), []
    for r in asked.select("query_id", "vector", "phase").where("vector is not null and phase is not null").toLocalIterator():
        block.append(r)
        if len(block) == block_rows:
            out, block = out.unionByName(one(block)), []
    out = out.unionByName(one(block)) if block else out
    return out.groupBy("query_id").agg(F.min(F.struct("distance", "id")).alias("b")).select("query_id", "b.id", "b.distance")


def engrams(activations: DataFrame, *, least: float = 0.6, most: int = 20) -> DataFrame:
    """(engram, id, weight): the ``most`` strongest nodes of each result (query_id, id, score), where two or more are active enough on average."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = activations.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    mean, n = F.avg("score").over(Window.partitionBy("query_id")), F.count("*").over(Window.partitionBy("query_id"))
    return top.withColumn("mean", mean).withColumn("n", n).where((F.col("n") >= 2) & (F.col("mean") >= least)).select(F.col("query_id").alias("engram"), "id", F.col("score").alias("weight"))


def engram_centroids(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(engram, dim, value): the weighted mean of the members' vectors."""
    x = members.join(nodes.select("id", "vector"), "id").select("engram", "weight", F.posexplode("vector").alias("dim", "x"))
    return x.groupBy("engram", "dim").agg((F.sum(F.col("weight") * F.col("x").cast("double")) / F.sum("weight")).alias("value"))


def engram_decay(members: DataFrame, steps: int, *, rate: float = 0.998, least: float = 0.01) -> DataFrame:
    """Members whose weight stays at ``least`` after so many steps."""
    return members.withColumn("weight", F.col("weight") * rate**steps).where(F.col("weight") >= least)


def reinforce(nodes: DataFrame, inputs: DataFrame, *, least: float = 0.3, pull: float = 0.02) -> DataFrame:
    """(query_id, id, vector, action): each input's best node drawn towards it, or the input itself as a new node.

    Inputs of a batch are matched against the nodes as they stood before it.
    """
    best = scoring.topk(nodes.select("id", "vector"), inputs, 1, kernel="gaussian").where(F.col("score") > least)
    m = inputs.join(best.select("query_id", "id"), "query_id", "left").join(nodes.select("id", F.col("vector").alias("x")), "id", "left")
    moved = F.zip_with("x", "vector", lambda a, b: (a + pull * (b - a)).cast("float"))
    return m.select("query_id", "id", F.coalesce(moved, "vector").alias("vector"), F.when(F.col("id").isNull(), "insert").otherwise("reinforce").alias("action"))


def clipped(vector: str | Column, most: float = 1.0) -> Column:
    """The vector scaled to at most the norm ``most``."""
    v = F.col(vector) if isinstance(vector, str) else vector
    f = F.least(F.lit(1.0), most / F.greatest(V.norm(v), F.lit(1e-12)))
    return F.transform(v.cast("array<double>"), lambda x: x * f)


def noise_scale(sensitivity: float, epsilon: float, delta: float) -> float:
    """Deviation of the Gaussian mechanism; infinite where epsilon is not positive."""
    return sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / epsilon if epsilon > 0 else math.inf


def privatised(nodes: DataFrame, *, epsilon: float = 2.0, delta: float = 1e-5, most: float = 1.0, seed: int = 7) -> DataFrame:
    """``nodes`` with clipped vectors and seeded Gaussian noise added to every value."""
    s = noise_scale(most, epsilon, delta)
    noisy = nodes.select("*", F.posexplode(clipped("vector", most)).alias("dim", "x")).withColumn("x", F.col("x") + s * F.randn(seed))
    rest = [c for c in nodes.columns if c != "vector"]
    return noisy.groupBy(*rest).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("vector"))


def procrustes(pairs: DataFrame, a: str, b: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotation, mean of a, mean of b) that bring vectors a nearest to b: one aggregation of d x d sums, the rest on the driver."""
    dim = len(pairs.select(a).first()[0])
    x = pairs.select(F.posexplode(a).alias("i", "x"), F.col(b).alias("b")).select("i", "x", F.posexplode("b").alias("j", "y"))
    sums = x.groupBy("i", "j").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"), F.sum(F.col("x").cast("double")).alias("sx"), F.sum(F.col("y").cast("double")).alias("sy"), F.count("*").alias("n")).collect()  # d * d rows
    m, sx, sy, n = np.zeros((dim, dim)), np.zeros(dim), np.zeros(dim), 1
    for r in sums:
        m[r.i, r.j], sx[r.i], sy[r.j], n = r.xy, r.sx, r.sy, r.n
    u, _, vt = np.linalg.svd(m - np.outer(sx, sy) / n)
    return u @ vt, sx / n, sy / n
