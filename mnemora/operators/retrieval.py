"""Retrieval paths of several stages: lexical candidates scored by resonance, fusions, feedback, fallbacks.

Scores come as (query_id, id, score). A first stage bounds the candidates of a
query; later stages score those pairs alone, in the JVM, by joining the pairs
to the two sides' vectors, so no stage after the first looks at all nodes.
Null vectors score nothing; ties go to the lesser id; empty inputs give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions import vectors as V


def _per_query() -> Window:
    return Window.partitionBy("query_id")


def best(scored: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best of each query by the rounded score, then id, with their rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def by_max(score: str = "score", floor: float = 1e-8) -> Column:
    return F.col(score) / F.greatest(F.max(score).over(_per_query()), F.lit(floor))


def by_range(score: str = "score") -> Column:
    low, high = F.min(score).over(_per_query()), F.max(score).over(_per_query())
    return (F.col(score) - low) / (high - low + 1e-8)


def pair_scores(pairs: DataFrame, nodes: DataFrame, queries: DataFrame, score: Column) -> DataFrame:
    """(query_id, id, score) of candidate pairs; ``score`` is an expression over the node's columns and the query's, which begin with q_."""
    q = queries.select("query_id", *(F.col(c).alias(f"q_{c}") for c in queries.columns if c != "query_id"))
    both = pairs.select("query_id", "id").distinct().join(nodes.where("vector is not null"), "id").join(q.where("q_vector is not null"), "query_id")
    return both.select("query_id", "id", score.alias("score"))


def resonance(coupling: float = 0.0, bandwidth: float = 1.0, kernel: str = "gaussian") -> Column:
    """Kernel of the distance times the alignment of phases, of a node and the query beside it."""
    d2 = V.squared_distance("vector", "q_vector")
    s = F.exp(-d2 / (2 * bandwidth * bandwidth)) if kernel == "gaussian" else F.exp(-F.sqrt(d2) / bandwidth)
    return s * V.phase_alignment(F.coalesce("phase", F.lit(0.0)), F.coalesce("q_phase", F.lit(0.0)), coupling) if coupling else s


def cosine01() -> Column:
    return 0.5 + 0.5 * V.cosine("vector", "q_vector")


def staged(first: DataFrame, nodes: DataFrame, queries: DataFrame, score: Column, *, candidates: int, k: int) -> DataFrame:
    """The k best by ``score`` of the ``candidates`` best of the first stage."""
    return best(pair_scores(best(first, candidates), nodes, queries, score), k)


def three_way(dense: DataFrame, lexical: DataFrame, nodes: DataFrame, queries: DataFrame, *, k: int, weights: tuple[float, float, float] = (0.4, 0.35, 0.25), digits: int = 5) -> DataFrame:
    """Resonance and lexical scores over the query's greatest and cosine in 0..1, summed by weight over the union of both results."""
    a = dense.select("query_id", "id", (by_max() * weights[0]).alias("s"))
    b = lexical.select("query_id", "id", (by_max() * weights[1]).alias("s"))
    c = pair_scores(a.unionByName(b), nodes, queries, cosine01()).select("query_id", "id", (F.col("score") * weights[2]).alias("s"))
    return best(a.unionByName(b).unionByName(c).groupBy("query_id", "id").agg(F.sum("s").alias("score")), k, digits)


def blend(dense: DataFrame, lexical: DataFrame, *, alpha: float, least: float, k: int) -> DataFrame:
    """Dense results mixed with the lexical score over its greatest, and behind them the lexical results above ``least`` that dense search missed."""
    b = lexical.select("query_id", "id", by_max(floor=1e-12).alias("b"))
    mixed = dense.join(b, ["query_id", "id"], "left").select("query_id", "id", (alpha * F.col("score") + (1 - alpha) * F.coalesce("b", F.lit(0.0))).alias("score"))
    asked = dense.select("query_id").distinct()
    more = b.where(F.col("b") > least).join(dense.select("query_id", "id"), ["query_id", "id"], "left_anti").join(asked, "query_id", "left_semi")
    return best(mixed.unionByName(more.select("query_id", "id", ((1 - alpha) * F.col("b")).alias("score"))), k)


def ranged_sum(dense: DataFrame, lexical: DataFrame, alpha: float) -> DataFrame:
    """``alpha`` of the dense score and the rest of the lexical one, each brought to 0..1 over all documents of the query; no lexical score is 0."""
    full = dense.join(lexical.select("query_id", "id", F.col("score").alias("b")), ["query_id", "id"], "left").withColumn("b", F.coalesce("b", F.lit(0.0)))
    return full.select("query_id", "id", (alpha * by_range() + (1 - alpha) * by_range("b")).alias("score"))


def expanded(queries: DataFrame, first: DataFrame, nodes: DataFrame, *, beta: float) -> DataFrame:
    """Queries moved by ``beta`` towards the mean vector of their first results."""
    x = first.select("query_id", "id").join(nodes.select("id", "vector"), "id").select("query_id", F.posexplode("vector").alias("dim", "x"))
    mean = x.groupBy("query_id", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = mean.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda p: p["m"]).alias("feedback"))
    moved = F.zip_with(F.col("vector").cast("array<double>"), F.coalesce("feedback", F.transform("vector", lambda _: F.lit(0.0))), lambda a, b: a + beta * b)
    return queries.join(mean, "query_id", "left").withColumn("vector", moved).drop("feedback")


def keep_max(*results: DataFrame) -> DataFrame:
    """The greatest score of each id among the results of a query's parts."""
    union = results[0].select("query_id", "id", "score")
    for r in results[1:]:
        union = union.unionByName(r.select("query_id", "id", "score"))
    return union.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def or_else(first: DataFrame, second: DataFrame, factor: float) -> DataFrame:
    """The first result, and for queries that have none the second with its scores times ``factor``."""
    rest = second.join(first.select("query_id").distinct(), "query_id", "left_anti")
    return first.select("query_id", "id", "score").unionByName(rest.select("query_id", "id", (F.col("score") * factor).alias("score")))


def by_confidence(dense: DataFrame, lexical: DataFrame, *, sure: float = 0.3, some: float = 0.1, factor: float = 0.5) -> DataFrame:
    """(query_id, id, score, verdict): dense rows where the best reaches ``sure``, else lexical rows at ``factor`` where
    theirs reaches ``some``, else one row without an id that says ``unknown``; every query of either result is given."""
    top = lambda df, name: df.groupBy("query_id").agg(F.max("score").alias(name))
    asked = top(dense, "d").join(top(lexical, "l"), "query_id", "full_outer")
    verdict = F.when(F.coalesce("d", F.lit(0.0)) >= sure, "confident").when(F.coalesce("l", F.lit(0.0)) >= some, "fallback").otherwise("unknown")
    asked = asked.select("query_id", verdict.alias("verdict"))
    a = dense.join(asked.where("verdict = 'confident'"), "query_id").select("query_id", "id", "score", "verdict")
    b = lexical.join(asked.where("verdict = 'fallback'"), "query_id").select("query_id", "id", (F.col("score") * factor).alias("score"), "verdict")
    none = asked.where("verdict = 'unknown'").select("query_id", F.lit(None).cast(dense.schema["id"].dataType).alias("id"), F.lit(0.0).alias("score"), "verdict")
    return a.unionByName(b).unionByName(none)


def tier_fallback(scored: DataFrame, tiers: DataFrame, *, k: int, order: tuple[str, ...]) -> DataFrame:
    """The k best of each query from the first tier, filled up from the next ones in turn where it holds fewer."""
    place = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for i, t in enumerate(order) for x in (t, i))), F.col("tier")), F.lit(len(order)))
    w = Window.partitionBy("query_id").orderBy("place", F.desc("score"), "id")
    t = scored.join(tiers.select("id", "tier"), "id").withColumn("score", F.round("score", 6)).withColumn("place", place)
    return t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "score", "tier", "rank")


def in_session(nodes: DataFrame, queries: DataFrame, *, share: float = 0.3) -> DataFrame:
    """(query_id, id) that each query looks at: only its session's nodes where these are some, but under ``share`` of all, else every node.

    Sessions' sizes are counted once; a query of a small session is joined to
    that session only, and the others to all nodes.
    """
    n = nodes.select("id", "session").groupBy("session").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    q = queries.select("query_id", F.col("session").alias("session")).join(n, "session", "left").crossJoin(F.broadcast(total))
    q = q.select("query_id", "session", (F.coalesce("n", F.lit(0)).between(1, F.ceil(F.col("total") * share) - 1)).alias("small"))
    return q


def reweighted(scored: DataFrame, signals: DataFrame, *, temperature: float = 1.0) -> DataFrame:
    """(query_id, id, weight): scores raised by causes and goals, lowered by tension, as a softmax over the query's result.

    ``signals`` has (id, causes, tension, goal); nulls count as none.
    """
    of = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    s = F.col("score") * (1 + 0.2 * F.least(F.lit(1.0), of("causes"))) * F.greatest(F.lit(0.5), 1 - of("tension")) * (1 + 0.3 * of("goal"))
    e = scored.join(signals, "id", "left").select("query_id", "id", F.exp(s / temperature).alias("e"))
    return e.select("query_id", "id", (F.col("e") / (F.sum("e").over(_per_query()) + 1e-8)).alias("weight"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, common, jaccard, concordance) of two ranked results (query_id, id, rank): shared ids over all, and shared pairs in the same order."""
    both = a.select("query_id", "id", F.col("rank").alias("ra")).join(b.select("query_id", "id", F.col("rank").alias("rb")), ["query_id", "id"], "full_outer")
    shared = both.where("ra is not null and rb is not null")
    x, y = shared.alias("x"), shared.alias("y")
    pairs = x.join(y, (F.col("x.query_id") == F.col("y.query_id")) & (F.col("x.ra") < F.col("y.ra")))  # results hold a few ranks each
    con = pairs.groupBy(F.col("x.query_id").alias("query_id")).agg(F.avg((F.col("x.rb") < F.col("y.rb")).cast("double")).alias("concordance"))
    n = both.groupBy("query_id").agg(F.count_if(F.col("ra").isNotNull() & F.col("rb").isNotNull()).alias("common"), F.count("*").alias("all"))
    return n.join(con, "query_id", "left").select("query_id", "common", (F.col("common") / F.col("all")).alias("jaccard"), "concordance")
