"""Learned and dynamic parts: word vectors, sentence vectors, projections, clusters, filters, feedback.

Counts and sums are taken in Spark over all rows; what reaches the driver is a
matrix bounded by a parameter (words of a vocabulary, dimensions, centres).
Null vectors take no part; ties go to the lesser id; empty inputs give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora import workspace
from mnemora.functions import vectors as V
from mnemora.functions.text import tokens
from mnemora.operators import lexical as L


# --- word and sentence vectors


def word_shares(docs: DataFrame, text: str, *, least: int = 1) -> DataFrame:
    """(term, n, p): words met at least ``least`` times and their share of all words."""
    c = docs.select(F.explode(tokens(text)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.crossJoin(F.broadcast(total)).where(F.col("n") >= least).select("term", "n", (F.col("n") / F.col("total")).alias("p"))


def smoothing(shares: DataFrame) -> DataFrame:
    """One row ``a``: the tenth percentile of the words' shares, from counts per distinct share."""
    by_n = shares.groupBy("p").agg(F.count("*").alias("words"))
    return by_n.agg(F.percentile("p", 0.1, F.col("words")).alias("a"))


def word_vectors(docs: DataFrame, text: str, *, dim: int = 32, vocabulary: int = 2000, window: int = 5, least: int = 3, shift: float = 0.0) -> DataFrame:
    """(term, vector): the singular vectors of the positive pointwise mutual information of the most frequent words, rows of length 1.

    Pairs are counted in Spark; the matrix that reaches the driver has at most
    ``vocabulary`` rows and columns. ``shift`` is taken off the information
    before it is cut at 0 (the log of the number of negative samples).
    """
    shares = L.ranked(word_shares(docs, text).select(F.lit(0).alias("query_id"), F.col("term").alias("doc_id"), F.col("n").cast("double").alias("score")), vocabulary, digits=0)
    words = [r.doc_id for r in shares.orderBy("rank").select("doc_id").collect()]  # at most ``vocabulary`` rows
    if not words:
        return docs.sparkSession.createDataFrame([], "term string, vector array<double>")
    at = {w: k for k, w in enumerate(words)}
    known = docs.sparkSession.createDataFrame([(w,) for w in words], "term string")
    pairs = L.pmi(docs, text, window=window, least=least).where(F.col("pmi") > shift)
    pairs = pairs.join(F.broadcast(known.withColumnRenamed("term", "a")), "a").join(F.broadcast(known.withColumnRenamed("term", "b")), "b")
    m = np.zeros((len(words), len(words)))
    for r in pairs.select("a", "b", "pmi").toLocalIterator():  # at most vocabulary squared
        m[at[r.a], at[r.b]] = m[at[r.b], at[r.a]] = r.pmi - shift
    u, s, _ = np.linalg.svd(m, hermitian=True)
    x = u[:, :dim] * np.sqrt(s[:dim])
    x *= np.where(np.abs(x).max(0) > 0, np.sign(x[np.abs(x).argmax(0), np.arange(x.shape[1])]), 1.0)  # the sign of a direction is free
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return docs.sparkSession.createDataFrame(list(zip(words, x.tolist())), "term string, vector array<double>")


def sentence_vectors(docs: DataFrame, key: str, text: str, words: DataFrame, shares: DataFrame, a: float) -> DataFrame:
    """(key, vector): mean of the words' vectors weighted by a / (a + p), over the weights; texts without a known word are left out."""
    t = docs.select(key, F.explode(tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    w = t.join(words, "term").join(shares.select("term", "p"), "term").withColumn("w", F.col("tf") * a / (a + F.col("p")))
    x = w.select(key, "w", F.posexplode("vector").alias("dim", "x")).groupBy(key, "dim").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    return x.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("vector"))


def covariance(df: DataFrame, vector: str = "vector", *, centred: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, matrix of second moments, rows), summed in batches of rows: one small row a batch is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.array(b[vector].tolist(), np.float64)
                yield pd.DataFrame({"n": [len(x)], "s": [x.sum(0).tolist()], "m": [(x.T @ x).ravel().tolist()]})

    parts = df.where(F.col(vector).isNotNull()).select(vector).mapInPandas(run, "n bigint, s array<double>, m array<double>")
    add = lambda c: F.expr(f"aggregate(collect_list({c}), cast(array() as array<double>), (x, y) -> if(size(x) = 0, y, zip_with(x, y, (p, q) -> p + q)))")
    # batches are first added up within a few groups, so no row holds all of them
    some = parts.withColumn("g", F.pmod(F.xxhash64("n", "s"), F.lit(64))).groupBy("g").agg(F.sum("n").alias("n"), add("s").alias("s"), add("m").alias("m"))
    r = some.agg(F.sum("n").alias("n"), add("s").alias("s"), add("m").alias("m")).first()
    if not r.n:
        return np.zeros(0), np.zeros((0, 0)), 0
    mean = np.array(r.s) / r.n
    second = np.array(r.m).reshape(len(mean), -1) / r.n
    return mean, second - np.outer(mean, mean) if centred else second, r.n


def principal(df: DataFrame, k: int, vector: str = "vector", *, centred: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(mean, k x dim directions) of greatest variance, each with its greatest entry positive."""
    mean, m, n = covariance(df, vector, centred=centred)
    values, u = np.linalg.eigh(m)
    top = u[:, np.argsort(-values)[:k]].T
    top *= np.sign(top[np.arange(len(top)), np.abs(top).argmax(1)])[:, None]
    return (mean if centred else np.zeros_like(mean)), top


def projected(df: DataFrame, directions: np.ndarray, mean: np.ndarray, vector: str = "vector") -> DataFrame:
    """``df`` with the vector brought to the directions; the matrix is small and sent along."""
    rows = F.array(*(F.array(*(F.lit(float(x)) for x in d)) for d in directions))
    centre = F.array(*(F.lit(float(x)) for x in mean))
    return df.withColumn(vector, F.transform(rows, lambda d: V.dot(F.zip_with(F.col(vector).cast("array<double>"), centre, lambda x, c: x - c), d)))


def without_direction(df: DataFrame, direction: np.ndarray, vector: str = "vector") -> DataFrame:
    """Vectors without their part along a direction, brought to length 1."""
    d = F.array(*(F.lit(float(x)) for x in direction))
    along = V.dot(vector, d)
    df = df.withColumn("_along", along).withColumn(vector, F.zip_with(F.col(vector), d, lambda x, u: x - F.col("_along") * u)).drop("_along")
    n = V.norm(vector)
    return df.withColumn("_n", F.greatest(n, F.lit(1e-12))).withColumn(vector, F.transform(vector, lambda x: x / F.col("_n"))).drop("_n")


# --- clusters


def kmeans(nodes: DataFrame, first: DataFrame, rounds: int) -> DataFrame:
    """(shard, vector): centres after so many rounds, from the first ones (shard, vector), which bound what is broadcast.

    A round is one pass with the centres at every task; what is shuffled is a
    sum for each centre and batch. A centre nobody is nearest to stays.
    """
    spark = nodes.sparkSession
    centres = sorted((r.shard, r.vector) for r in first.collect())  # a row a centre
    names, c = [k for k, _ in centres], np.array([v for _, v in centres], np.float64)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(c)

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x = np.array(b.vector.tolist(), np.float64)
                    home = np.round(((x[:, None, :] - held.value[None]) ** 2).sum(2), 9).argmin(1)
                    for k in np.unique(home):
                        yield pd.DataFrame({"k": [int(k)], "n": [int((home == k).sum())], "s": [x[home == k].sum(0).tolist()]})

        parts = nodes.where("vector is not null").select("vector").mapInPandas(run, "k int, n bigint, s array<double>")
        sums = parts.select("k", "n", F.posexplode("s").alias("dim", "x")).groupBy("k", "dim").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()  # centres x dimensions
        c = c.copy()
        for r in sums:
            c[r.k, r.dim] = r.x / r.n
    return spark.createDataFrame([(k, v.tolist()) for k, v in zip(names, c)], "shard bigint, vector array<double>")


def topic_shards(docs: DataFrame, key: str, text: str, *, shards: int) -> DataFrame:
    """(key, topic): each document by its rarest word, the lesser of equal ones; all but the ``shards`` - 1 largest topics are one, ``rest``."""
    t = docs.select(key, F.explode(F.array_distinct(tokens(text))).alias("term"))
    df = t.groupBy("term").agg(F.count("*").alias("df"))
    rarest = t.join(df, "term").groupBy(key).agg(F.min(F.struct("df", "term"))["term"].alias("topic"))
    sizes = rarest.groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(shards - 1).withColumn("large", F.lit(True))
    return rarest.join(F.broadcast(sizes.select("topic", "large")), "topic", "left").select(key, F.when(F.col("large"), F.col("topic")).otherwise("rest").alias("topic"))


def _against_blocks(nodes: DataFrame, schema: str, make, *, block_rows: int = 4096) -> DataFrame:
    """Every batch of (id, vector, ...) held against blocks of the nodes; ``make(batch, ids, matrix, extra)`` gives a frame."""
    spark = nodes.sparkSession
    source = nodes.where("id is not null and vector is not null")
    extra = [c for c in nodes.columns if c not in ("id", "vector")]

    def one(block: list) -> DataFrame:
        held = spark.sparkContext.broadcast((np.array([r.id for r in block]), np.array([r.vector for r in block], np.float64), {c: np.array([r[c] for r in block]) for c in extra}))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield make(b, *held.value)

        return source.mapInPandas(run, schema)

    out, block = spark.createDataFrame([], schema), []
    for r in source.toLocalIterator():
        block.append(r)
        if len(block) == block_rows:
            out, block = out.unionByName(one(block)), []
    return out.unionByName(one(block)) if block else out


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0.0))


def dense_groups(nodes: DataFrame, *, radius: float = 0.4, least: int = 3) -> DataFrame:
    """(id, cluster): points with at least ``least`` points within the radius, themselves included, linked to each other where
    they lie within it, and the points within reach of one; a cluster is named by its least core point, others are left out.

    Points are counted and labelled in blocks, and labels are carried on until
    none changes, so a dense group never gives its pairs.
    """

    def count(b: pd.DataFrame, ids, x, extra) -> pd.DataFrame:
        return pd.DataFrame({"id": b.id, "n": (_distances(np.array(b.vector.tolist(), float), x) <= radius + 1e-9).sum(1)})

    n = _against_blocks(nodes.select("id", "vector"), f"id {nodes.schema['id'].dataType.simpleString()}, n bigint", count).groupBy("id").agg(F.sum("n").alias("n"))
    core = workspace.materialise(nodes.select("id", "vector").join(n.where(F.col("n") >= least).select("id"), "id").withColumn("label", F.col("id")), "core")
    kind = nodes.schema["id"].dataType.simpleString()

    def least_label(b: pd.DataFrame, ids, x, extra) -> pd.DataFrame:
        near = _distances(np.array(b.vector.tolist(), float), x) <= radius + 1e-9
        found = np.where(near, extra["label"][None, :], extra["label"].max()).min(1)
        return pd.DataFrame({"id": b.id, "label": found})[near.any(1)]

    while True:
        new = _against_blocks(core, f"id {kind}, label {kind}", least_label).groupBy("id").agg(F.min("label").alias("new"))
        # a label's own label is taken at once, which halves the rounds
        jump = new.select(F.col("id").alias("new"), F.col("new").alias("further"))
        step = workspace.materialise(core.join(new, "id").join(jump, "new", "left").select("id", "vector", F.least("new", F.coalesce("further", "new"), "label").alias("label"), F.col("label").alias("old")), "core")
        changed = not step.where("label <> old").isEmpty()
        core = step.drop("old")
        if not changed:
            break
    rest = nodes.select("id", "vector").join(core.select("id"), "id", "left_anti")
    both = core.withColumn("is_core", F.lit(True)).unionByName(rest.withColumn("label", F.lit(None).cast(kind)).withColumn("is_core", F.lit(False)))

    def reach(b: pd.DataFrame, ids, x, extra) -> pd.DataFrame:
        b = b[~b.is_core]
        if not len(b) or not extra["is_core"].any():
            return pd.DataFrame({"id": b.id[:0], "d": [], "label": b.label[:0]})
        y, labels = x[extra["is_core"]], extra["label"][extra["is_core"]]
        d = np.round(_distances(np.array(b.vector.tolist(), float), y), 9)
        d = np.where(d <= radius + 1e-9, d, np.inf)
        order = np.lexsort((labels,))
        j = order[d[:, order].argmin(1)]
        ok = np.isfinite(d[np.arange(len(b)), j])
        return pd.DataFrame({"id": b.id.to_numpy()[ok], "d": d[np.arange(len(b)), j][ok], "label": labels[j][ok].astype(labels.dtype)})

    near = _against_blocks(both, f"id {kind}, d double, label {kind}", reach).groupBy("id").agg(F.min(F.struct("d", "label"))["label"].alias("cluster"))
    return core.select("id", F.col("label").alias("cluster")).unionByName(near)


def mutual_merges(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, vector, phase, amplitude, salience): candidate pairs (query_id, id) that name each other, merged.

    The middle of the vectors and of the phases on the circle; amplitudes add up
    to at most 1 at .8, saliences at .7. Pairs that name each other can be
    merged at once, in any order, each node once.
    """
    c = candidates.select("query_id", "id")
    pairs = c.join(c.select(F.col("query_id").alias("id"), F.col("id").alias("query_id")), ["query_id", "id"], "left_semi").where("query_id < id").select(F.col("query_id").alias("a"), F.col("id").alias("b"))
    side = lambda k: nodes.select(F.col("id").alias(k), *(F.col(x).alias(f"{k}_{x}") for x in ("vector", "phase", "amplitude", "salience")))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    mean = lambda f: (f("a_phase") + f("b_phase")) / 2
    return j.select(
        "a", "b", F.zip_with(F.col("a_vector").cast("array<double>"), F.col("b_vector").cast("array<double>"), lambda x, y: (x + y) / 2).alias("vector"),
        F.pmod(F.atan2(mean(F.sin), mean(F.cos)), F.lit(6.283185307179586)).alias("phase"),
        F.least(F.lit(1.0), 0.8 * (F.col("a_amplitude") + F.col("b_amplitude"))).alias("amplitude"),
        F.least(F.lit(1.0), 0.7 * (F.col("a_salience") + F.col("b_salience"))).alias("salience"),
    )


# --- dynamics and feedback


def moved_towards(vector: str | Column, goal: str | Column, strength: float) -> Column:
    v, g = (F.col(x) if isinstance(x, str) else x for x in (vector, goal))
    return F.zip_with(v.cast("array<double>"), g.cast("array<double>"), lambda x, y: (1 - strength) * x + strength * y)


def ema(df: DataFrame, key: str, order: list[str], value: str, *, rate: float = 0.1, start: float = 0.0) -> DataFrame:
    """(key, ema): rate * x + (1 - rate) * before, folded over the rows of each key in order, from ``start``.

    A fold over n rows is the sum of x weighted by rate * (1 - rate) ** (rows
    after it), so it is an aggregation over a rank, and rows too old to count
    in double precision are cut before the shuffle.
    """
    depth = int(np.ceil(np.log(1e-18) / np.log(1 - rate)))
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    r = df.where(F.col(value).isNotNull()).select(key, *order, value).withColumn("after", F.row_number().over(w) - 1).where(F.col("after") < depth)
    return r.groupBy(key).agg((F.sum(rate * F.col(value) * F.pow(F.lit(1 - rate), F.col("after"))) + start * F.pow(F.lit(1 - rate), F.count("*"))).alias("ema"))


def folded(df: DataFrame, key: str, order: list[str], value: str, start: Column, step) -> DataFrame:
    """(key, result): ``step(state, value)`` folded over a key's values in order. For folds that clip and so don't commute; a key's values are one array, so keys must be entities with few rows each."""
    arr = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(arr.alias("a")).select(key, F.aggregate("a", start, lambda s, x: step(s, x["_v"])).alias("result"))


def goal_relevance(links: DataFrame, goals: DataFrame) -> DataFrame:
    """(node, relevance): summed priority * (1 - completion) of a node's active goals (goal, priority, completion), at most 1."""
    j = links.join(goals.where("status = 'active'"), "goal")
    return j.groupBy("node").agg(F.least(F.lit(1.0), F.sum(F.col("priority") * (1 - F.col("completion")))).alias("relevance"))


def state_space(df: DataFrame, key: str, order: list[str], value: str, *, decay: float, gain: float) -> DataFrame:
    """(key, state) of s = decay * s + gain * x over a key's rows in order: the sum of gain * x * decay ** (rows after it)."""
    return ema(df, key, order, value, rate=1 - decay).select(key, (F.col("ema") * gain / (1 - decay)).alias("state"))


def privacy_budget(queries: Column, epsilon: float, delta: float) -> Column:
    """Epsilon spent by so many queries, by advanced composition."""
    return F.sqrt(2 * queries * float(np.log(1 / delta))) * epsilon


# --- the ball of radius r


def mobius_add(a, b, radius: float) -> Column:
    """Sum in the ball of ``radius``."""
    r2 = radius * radius
    ab, aa, bb = V.dot(a, b), V.dot(a, a), V.dot(b, b)
    x, y = 1 + 2 * ab / r2 + bb / r2, 1 - aa / r2
    den = 1 + 2 * ab / r2 + aa * bb / (r2 * r2)
    return F.zip_with(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b, lambda p, q: (x * p + y * q) / F.greatest(den, F.lit(1e-12)))


def exp_map(v, radius: float) -> Column:
    """Point of the ball that a tangent vector at its middle leads to."""
    n = F.greatest(V.norm(v), F.lit(1e-12))
    f = radius * F.tanh(n / radius) / n
    return F.transform(F.col(v) if isinstance(v, str) else v, lambda x: x * f)


def log_map(p, radius: float) -> Column:
    """Tangent vector at the middle that leads to a point of the ball."""
    n = F.greatest(V.norm(p), F.lit(1e-12))
    f = radius * F.atanh(F.least(n / radius, F.lit(1 - 1e-9))) / n
    return F.transform(F.col(p) if isinstance(p, str) else p, lambda x: x * f)
