"""Groups by the spectrum of a neighbour graph, indexed search by cells, and density matrices of groups.

The graph holds the k nearest of each node, so its edges are k times the nodes;
power iteration runs on it in rounds over its edges. Ties go to the lesser id;
null vectors take no part; empty inputs give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora import workspace
from mnemora.functions import vectors as V
from mnemora.operators import field as D
from mnemora.operators import scoring


def affinity(nodes: DataFrame, k: int, bandwidth: float = 1.0) -> DataFrame:
    """(a, b, w): Gaussian weights of each node's k nearest, both ways, each edge once a way."""
    n = D.neighbours(nodes, D.every(nodes), k)
    w = F.exp(-F.col("distance") * F.col("distance") / (2 * bandwidth * bandwidth))
    one = n.select(F.col("query_id").alias("a"), F.col("id").alias("b"), w.alias("w"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.max("w").alias("w"))


def power_groups(edges: DataFrame, groups: int, rounds: int = 30) -> DataFrame:
    """(node, cluster): groups of a weighted graph (a, b, w) by power iteration.

    A value is carried along the normalised edges until it is alike within a
    dense part, and the values are cut at their ``groups`` - 1 widest gaps. A
    round moves one number an edge; the gaps are found from sorted values in
    ranges, of which only the widest reach the driver.
    """
    from mnemora.operators import ranks

    e = workspace.materialise(edges, "affinity")
    degree = e.groupBy("a").agg(F.sum("w").alias("d"))
    p = workspace.materialise(e.join(degree, "a").select("a", "b", (F.col("w") / F.col("d")).alias("p")), "steps")
    value = workspace.materialise(degree.select(F.col("a").alias("node"), ((F.pmod(F.xxhash64("a"), F.lit(1_000_003)) + 1) / 1_000_003.0).alias("v")), "value")
    for _ in range(rounds):
        step = p.join(value.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum(F.col("p") * F.col("v")).alias("v"))
        value = workspace.materialise(step, "value")
    placed = ranks.running(value, [], ["v", "node"])
    after = placed.select((F.col("place") - 1).alias("place"), F.col("v").alias("next"))
    gaps = placed.join(after, "place").select("v", (F.col("next") - F.col("v")).alias("gap"))
    cuts = sorted(r.v for r in gaps.orderBy(F.desc("gap"), "v").limit(groups - 1).collect())  # a row a group
    cluster = sum((F.when(F.col("v") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    return placed.select("node", cluster.alias("cluster"))


def indexed_topk(nodes: DataFrame, queries: DataFrame, centres: DataFrame, k: int, *, probes: int) -> DataFrame:
    """(query_id, id, score, rank): the k of greatest cosine among the nodes in the ``probes`` cells nearest to each query.

    Nodes are routed to their nearest centre and queries to several; only pairs
    of one cell are scored, exactly. A cell that holds much more than its share is
    split among tasks by its nodes, the few queries going to each part.
    """
    cells = scoring.route(nodes, centres, 1).select("id", F.col("shard").alias("cell"))
    asked = scoring.route(queries.select(F.col("query_id").alias("id"), "vector"), centres, probes).select(F.col("id").alias("query_id"), F.col("shard").alias("cell"))
    pairs = cells.join(asked, "cell")
    q = queries.select("query_id", F.col("vector").alias("q"))
    s = pairs.join(nodes.select("id", "vector"), "id").join(q, "query_id").select("query_id", "id", F.round(V.cosine("vector", "q"), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def density(df: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """(group, n, purity): of each group's density matrix, the mean outer product of its vectors over its trace, the sum of squares.

    Batches give one matrix a group, so what is shuffled does not follow the rows.
    """
    kind = df.schema[group].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, part in b.groupby(group):
                x = np.array(part[vector].tolist(), np.float64)
                m = x.T @ x
                i, j = np.triu_indices(len(m))
                yield pd.DataFrame({"g": [g] * len(i), "i": i.astype(np.int32), "j": j.astype(np.int32), "x": m[i, j], "n": [len(x)] * len(i)})

    parts = df.where(F.col(vector).isNotNull() & F.col(group).isNotNull()).select(group, vector).mapInPandas(run, f"g {kind}, i int, j int, x double, n bigint")
    m = parts.groupBy("g", "i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    square = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0) * F.col("x") * F.col("x")
    trace = F.sum(F.when(F.col("i") == F.col("j"), F.col("x")).otherwise(0.0))
    return m.groupBy(F.col("g").alias(group)).agg(F.max("n").alias("n"), (F.sum(square) / (trace * trace)).alias("purity"))
