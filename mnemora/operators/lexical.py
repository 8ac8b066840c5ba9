"""Lexical search over token postings, and what is built on its scores.

Postings are made for the terms of the queries only: the terms are few and sent
to the executors when their number is checked to be small, otherwise joined. A
document's length comes from its token array, so nothing but the terms asked
for is exploded. Null and empty texts hold no token; ties go to the lesser id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora import workspace
from mnemora.functions.text import tokens

SMALL = 50_000  # rows up to which a side is sent to every executor


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint where it is counted to have at most ``SMALL`` rows; ``df`` must be cheap to count."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def tokenised(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, t): token arrays in the shared folder, so that texts are cut once however many passes follow."""
    return workspace.materialise(docs.select(F.col(key).alias("doc_id"), tokens(text).alias("t")), "tokens")


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, term, qtf): terms count as often as they occur; written once, as it decides about joins."""
    t = queries.select(F.col(key).alias("query_id"), F.explode(tokens(text)).alias("term"))
    return workspace.materialise(t.groupBy("query_id", "term").agg(F.count("*").alias("qtf")), "terms")


def postings(cut: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, len, term, tf) of the given terms in tokenised documents; written once, as frequencies and scores both follow from it."""
    t = cut.select("doc_id", F.size("t").alias("len"), F.explode("t").alias("term"))
    p = t.join(small(terms.select("term").distinct()), "term", "left_semi").groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    return workspace.materialise(p, "postings")


def bm25(docs: DataFrame, queries: DataFrame, *, doc_key: str, doc_text: str, query_key: str, query_text: str, k1: float = 1.5, b: float = 0.75, binary: bool = False) -> DataFrame:
    """(query_id, doc_id, score) of every document that shares a term with a query."""
    return bm25_of(tokenised(docs, doc_key, doc_text), query_terms(queries, query_key, query_text), k1=k1, b=b, binary=binary)


def bm25_of(cut: DataFrame, q: DataFrame, *, k1: float = 1.5, b: float = 0.75, binary: bool = False, p: DataFrame | None = None) -> DataFrame:
    """``bm25`` of tokenised documents and query terms; ``p`` are their postings where these are at hand."""
    p = postings(cut, q) if p is None else p
    stats = cut.agg(F.count("*").alias("docs"), F.avg(F.size("t")).alias("mean"))
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.lit(1.0) if binary else F.col("tf").cast("double")
    part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.greatest(F.col("len"), F.lit(1)) / F.greatest(F.col("mean"), F.lit(1.0))))
    weights = q.join(df, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", "qtf", "mean", idf.alias("idf"))
    # one row a query and term, as many as the query terms, which are counted
    weights = F.broadcast(weights) if q.limit(SMALL + 1).count() <= SMALL else weights
    return p.join(weights, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * F.col("idf") * part).alias("score"))


def bm25_all(docs: DataFrame, queries: DataFrame, **keys) -> DataFrame:
    """``bm25`` with a row for every document of every query, 0 where they share no term; for a stated query set against all documents."""
    scored = bm25(docs, queries, **keys)
    every = docs.select(F.col(keys["doc_key"]).alias("doc_id")).crossJoin(small(queries.select(F.col(keys["query_key"]).alias("query_id"))))
    return every.join(scored, ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def sparse_dot(docs: DataFrame, queries: DataFrame, *, doc_key: str, doc_text: str, query_key: str, query_text: str) -> DataFrame:
    """(query_id, doc_id, score): inner product of term frequencies."""
    q = query_terms(queries, query_key, query_text)
    return sparse_dot_of(postings(tokenised(docs, doc_key, doc_text), q), q)


def sparse_dot_of(p: DataFrame, q: DataFrame) -> DataFrame:
    return p.join(small(q), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * F.col("tf")).cast("double").alias("score"))


def ranked(scored: DataFrame, k: int, score: str = "score", digits: int = 6) -> DataFrame:
    """The best k of each query by the rounded score, then id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id")
    return scored.withColumn(score, F.round(score, digits)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def minmax(score: str) -> Column:
    w = Window.partitionBy("query_id")
    return (F.col(score) - F.min(score).over(w)) / (F.max(score).over(w) - F.min(score).over(w) + 1e-8)


def by_max(score: str) -> Column:
    w = Window.partitionBy("query_id")
    return F.col(score) / F.greatest(F.max(score).over(w), F.lit(1e-12))


def fuse(parts: dict[str, tuple[DataFrame, float]], norm=by_max) -> DataFrame:
    """Weighted sum of scores (query_id, doc_id, score), each normalised within its query; a missing score is 0."""
    both = None
    for df, weight in parts.values():
        one = df.select("query_id", "doc_id", (norm("score") * weight).alias("s"))
        both = one if both is None else both.unionByName(one)
    return both.groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"))


def confidence(scored: DataFrame, *, sure: float, some: float) -> DataFrame:
    """The verdict on each query by its best score."""
    top = F.max("score")
    verdict = F.when(top >= sure, "confident").when(top >= some, "fallback").otherwise("unknown")
    return scored.groupBy("query_id").agg(F.round(top, 6).alias("best"), verdict.alias("verdict"))


def pair_counts(cut: DataFrame, window: int = 5) -> DataFrame:
    """(a, b, n): how often terms occur within the window of each other, a < b, found inside each tokenised document."""
    t = cut.select("t").where(F.size("t") > 1)
    near = F.transform("t", lambda x, i: F.transform(F.slice("t", i + 2, window), lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))))
    return t.select(F.explode(F.flatten(near)).alias("p")).where("p.a <> p.b").groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def pmi(docs: DataFrame, text: str, *, window: int = 5, least: int = 3) -> DataFrame:
    """(a, b, n, pmi): positive pointwise mutual information of pairs met at least ``least`` times."""
    cut = tokenised(docs.select(F.lit(0).alias("k"), text), "k", text)
    pairs = pair_counts(cut, window).where(F.col("n") >= least)
    counts = workspace.materialise(cut.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("c")), "counts")
    total = counts.agg(F.sum("c").alias("total"))
    one = lambda k: counts.select(F.col("term").alias(k), F.col("c").alias(f"c{k}"))
    value = F.log(F.col("n") + 1e-8) + F.log("total") - F.log("ca") - F.log("cb")
    return pairs.join(one("a"), "a").join(one("b"), "b").crossJoin(F.broadcast(total)).select("a", "b", "n", F.greatest(F.lit(0.0), value).alias("pmi"))


def expansions(pairs: DataFrame, queries: DataFrame, key: str, text: str, k: int = 3, least: float = 0.5) -> DataFrame:
    """(query_id, term, weight, rank): the k terms of greatest summed PMI with a query's terms, its own left out."""
    q = query_terms(queries, key, text).select("query_id", "term")
    both = pairs.select(F.col("a").alias("term"), F.col("b").alias("other"), "pmi").unionByName(pairs.select(F.col("b").alias("term"), F.col("a").alias("other"), "pmi"))
    w = both.where(F.col("pmi") >= least).join(small(q), "term").groupBy("query_id", F.col("other").alias("doc_id")).agg(F.sum("pmi").alias("score"))
    own = q.withColumnRenamed("term", "doc_id")
    return ranked(w.join(small(own), ["query_id", "doc_id"], "left_anti"), k).select("query_id", F.col("doc_id").alias("term"), F.col("score").alias("weight"), "rank")
