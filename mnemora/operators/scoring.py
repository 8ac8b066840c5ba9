"""Ranked similarity of a query set against all nodes, in blocks of queries.

Nodes stay where they are: each partition scores its rows against a block of
queries by one matrix product and keeps the best k of each query, so what is
shuffled is at most k rows per query and task. Queries are sent to the
executors in blocks of at most ``block_rows``; a larger set is a pass per block.

Defined cases: a null vector on either side scores nothing; null phases count
as 0, null amplitudes, saliences and gates as 1, null sessions match none; ties
go to the lesser id; empty inputs give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora.operators import blocks, ranks

_NODE = ("phase", "amplitude", "salience", "gate", "session")


def _spatial(q: np.ndarray, x: np.ndarray, kernel: str, bandwidth: float, radius: float) -> np.ndarray:
    """(nodes, queries) similarity of positions."""
    if kernel in ("cosine", "cosine01", "dot"):
        d = x @ q.T
        if kernel == "dot":
            return d
        d = d / np.maximum(np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :], 1e-300)
        return d if kernel == "cosine" else 0.5 + 0.5 * d
    if kernel == "poincare":
        inside = lambda v: np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) >= radius, v * (radius * 0.999 / np.maximum(n, 1e-300)), v)
        q, x = inside(q), inside(x)
    d2 = np.maximum((x * x).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * x @ q.T, 0.0)
    row, col = np.nonzero(d2 < 1e-6)  # the difference of large sums is too rough here
    d2[row, col] = ((x[row] - q[col]) ** 2).sum(1)
    if kernel == "gaussian":
        return np.exp(-d2 / (2 * bandwidth * bandwidth))
    if kernel == "exponential":
        return np.exp(-np.sqrt(d2) / bandwidth)
    if kernel == "euclidean":
        return -np.sqrt(d2)
    r2 = radius * radius
    den = np.maximum((r2 - (x * x).sum(1))[:, None] * (r2 - (q * q).sum(1))[None, :] / r2, 1e-8)
    return -radius * np.arccosh(np.maximum(1.0, 1 + 2 * d2 / den))


def topk(
    nodes: DataFrame, queries: DataFrame, k: int, *, kernel: str = "gaussian", bandwidth: float = 1.0, coupling: float = 0.0, boost: float = 0.0,
    least: float | None = None, radius: float = 0.85, digits: int = 6, block_rows: int = 4096,
) -> DataFrame:
    """(query_id, id, score, rank) from nodes (id, vector, ...) and queries (query_id, vector, phase?, session?).

    score = kernel * phase alignment * amplitude * salience * gate, times
    1 + boost for nodes of the query's session; rows under ``least`` fall away.
    Scores are rounded to ``digits`` before they are ranked.
    """
    spark = nodes.sparkSession
    extra = [c for c in (*_NODE, "scale") if c in nodes.columns]
    kind = nodes.schema["id"].dataType
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    source = nodes.select("id", "vector", *extra).where("id is not null and vector is not null")

    def one(block: list) -> DataFrame:
        held = spark.sparkContext.broadcast(
            (
                [r["query_id"] for r in block],
                np.array([r["vector"] for r in block], np.float64),
                np.array([(r["phase"] if "phase" in r else None) or 0.0 for r in block]),
                [r["session"] if "session" in r else None for r in block],
            )
        )

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q, phase, session = held.value
            best = blocks.Best(ids, k, digits, least)
            found = lambda rows: (pd.DataFrame({"query_id": a, "id": n, "score": v}) for a, n, v in rows)
            asked = 0.5 * coupling * np.array([np.cos(phase), np.sin(phase)])
            for b in batches:
                if not len(b):
                    continue
                x = np.array(b.vector.tolist(), np.float64)
                if "scale" in b:  # codes of a byte a value
                    x *= b["scale"].to_numpy(float)[:, None]
                names = b.id.to_numpy()
                if coupling and "phase" in b:
                    p = b.phase.fillna(0.0).to_numpy(float)
                    turn = np.column_stack([np.cos(p), np.sin(p)])
                for i, j in blocks.slices(len(x), len(q)):
                    s = _spatial(q, x[i:j], kernel, bandwidth, radius)
                    if coupling and "phase" in b:
                        s *= (1 - 0.5 * coupling) + turn[i:j] @ asked
                    for c in ("amplitude", "salience", "gate"):
                        if c in b:
                            s *= b[c][i:j].fillna(1.0).to_numpy(float)[:, None]
                    if boost and "session" in b:
                        own = b.session[i:j]
                        s = np.where((own.to_numpy(object)[:, None] == np.array(session, object)[None, :]) & own.notna().to_numpy()[:, None], s * (1 + boost), s)
                    yield from found(best.add(s, names[i:j]))
            yield from found(best.end())

        return source.mapInPandas(run, schema)

    result, block = None, []
    cols = [c for c in ("query_id", "vector", "phase", "session") if c in queries.columns]
    for r in queries.where("vector is not null").select(*cols).toLocalIterator():
        block.append(r.asDict())
        if len(block) == block_rows:
            result, block = one(block) if result is None else result.unionByName(one(block)), []
    if block:
        result = one(block) if result is None else result.unionByName(one(block))
    if result is None:
        result = spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return result.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def group_scores(nodes: DataFrame, queries: DataFrame, *, how: str = "max", block_rows: int = 4096) -> DataFrame:
    """(query_id, group, score): over the vectors of each group, the greatest inner product or the sum of squares.

    Each batch gives one row per query and group, so little is shuffled.
    """
    spark = nodes.sparkSession
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("group", nodes.schema["group"].dataType), T.StructField("score", T.DoubleType())])
    total = F.max("score") if how == "max" else F.sum("score")

    def one(block: list) -> DataFrame:
        held = spark.sparkContext.broadcast(([r.query_id for r in block], np.array([r.vector for r in block], np.float64)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = held.value
            for b in batches:
                if len(b):
                    s = pd.DataFrame(np.array(b.vector.tolist(), np.float64) @ q.T)
                    g = (s if how == "max" else s * s).groupby(b.group.to_numpy())
                    part = (g.max() if how == "max" else g.sum()).stack()
                    at = part.index
                    yield pd.DataFrame({"query_id": [ids[j] for j in at.get_level_values(1)], "group": at.get_level_values(0), "score": part.to_numpy()})

        return nodes.select("group", "vector").where("group is not null and vector is not null").mapInPandas(run, schema)

    result, block = None, []
    for r in queries.select("query_id", "vector").where("vector is not null").toLocalIterator():
        block.append(r)
        if len(block) == block_rows:
            result, block = one(block) if result is None else result.unionByName(one(block)), []
    if block:
        result = one(block) if result is None else result.unionByName(one(block))
    return (result if result is not None else spark.createDataFrame([], schema)).groupBy("query_id", "group").agg(total.alias("score"))


def attention(scored: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Softmax of the scores within each query's result, as ``weight``."""
    e = F.exp(F.col("score") / temperature)
    return scored.withColumn("weight", e / (F.sum(e).over(Window.partitionBy("query_id")) + 1e-8))


def adaptive_depth(scored: DataFrame, *, base: int = 5, least: int = 3, most: int = 15, gap: float = 0.1) -> DataFrame:
    """Keep more rows where the first five scores lie close together."""
    w = Window.partitionBy("query_id")
    top = F.max("score").over(w)
    fifth = F.min(F.when(F.col("rank") <= 5, F.col("score"))).over(w)
    keep = F.when(top - fifth < gap, F.lit(min(most, 2 * base))).otherwise(F.lit(max(least, base)))
    return scored.withColumn("keep", keep).where("rank <= keep").drop("keep")


def confident_depth(scored: DataFrame) -> DataFrame:
    """Keep 1 row where the best score is at least .95, 3 where at least .8, else 5."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    keep = F.when(top >= 0.95, 1).when(top >= 0.8, 3).otherwise(5)
    return scored.withColumn("keep", keep).where("rank <= keep").drop("keep")


def route(nodes: DataFrame, centres: DataFrame, s: int = 1) -> DataFrame:
    """(id, shard, rank): the ``s`` nearest of the centres (shard, vector) for each node.

    The centres are the few: they are sent to the nodes, which stay where they are.
    """
    rows = sorted((r.shard, r.vector) for r in centres.where("vector is not null").collect())  # a row a centre
    names, c = np.array([k for k, _ in rows]), np.array([v for _, v in rows], np.float64)
    held = nodes.sparkSession.sparkContext.broadcast((names, c))
    schema = T.StructType([T.StructField("id", nodes.schema["id"].dataType), T.StructField("shard", centres.schema["shard"].dataType), T.StructField("rank", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards, x = held.value
        for b in batches:
            if len(b) and len(x):
                d = np.round(_spatial(x, np.array(b.vector.tolist(), np.float64), "euclidean", 1.0, 1.0), 6)
                near = np.argsort(-d, axis=1, kind="stable")[:, :s]  # centres are in the order of their names
                yield pd.DataFrame({"id": np.repeat(b.id.to_numpy(), near.shape[1]), "shard": shards[near.ravel()], "rank": np.tile(np.arange(1, near.shape[1] + 1), len(b))})

    return nodes.select("id", "vector").where("id is not null and vector is not null").mapInPandas(run, schema)


def conformal_threshold(calibration: DataFrame, score: str, alpha: float = 0.1) -> DataFrame:
    """One row ``threshold``: the (n - k + 1)-th least score with k = ceil((n + 1)(1 - alpha)); 0 where k > n.

    By ranks taken in ranges, so no task sorts the whole set.
    """
    placed = ranks.running(calibration.where(F.col(score).isNotNull()).select(F.col(score).alias("s")), [], ["s"])
    n = placed.agg(F.count("*").alias("n"))
    k = F.ceil((F.col("n") + 1) * (1 - alpha) - 1e-9)
    return placed.crossJoin(F.broadcast(n)).where((F.col("place") == F.col("n") - k + 1) & (k <= F.col("n"))).agg(F.coalesce(F.min("s"), F.lit(0.0)).alias("threshold"))
