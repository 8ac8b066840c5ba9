"""Vector similarity queries: every hundredth vector against all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import vectors as V
from mnemora.operators import scoring
from mnemora.sources.tables import table


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("vector"),
        (F.col("vec_id") % 628 / 100.0).alias("phase"),
        (0.5 + F.col("vec_id") % 50 / 100.0).alias("amplitude"),
        (0.3 + F.col("vec_id") % 70 / 100.0).alias("salience"),
        F.concat(F.lit("s"), F.col("vec_id") % 7).alias("session"),
    )


def _asked(nodes: DataFrame) -> DataFrame:
    return nodes.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector", "phase", "session")


def _plain(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "vector")


def resonance_topk(spark, d, **how):
    n = _nodes(spark, d)
    return scoring.topk(n, _asked(n), how.pop("k", 10), **how)


def _kernel(name: str, k: int = 10):
    def run(spark, d):
        n = _nodes(spark, d)
        return scoring.topk(_plain(n), _asked(n), k, kernel=name)

    return run


def int8_roundtrip(spark, d):
    q = table(spark, d, "embeddings").select("vec_id", "embedding", V.quantise_int8("embedding").alias("q"))
    back = F.transform("q.codes", lambda c: c * F.col("q.scale"))
    return q.select("vec_id", F.round("q.scale", 9).alias("scale"), F.array_max("q.codes").alias("most"), F.round(F.sqrt(V.squared_distance("embedding", back)), 6).alias("error"))


def int8_topk(spark, d):
    """Codes and their scale are scored as they are: the kernel brings them back within the matrix product."""
    q = V.quantise_int8("vector")
    n = _nodes(spark, d).select("id", q.alias("q"), "vector")
    codes = n.select("id", F.col("q.codes").cast("array<tinyint>").alias("vector"), F.col("q.scale").alias("scale"))
    return scoring.topk(codes, _asked(_nodes(spark, d)), 10)


def softmax_attention(spark, d):
    s = scoring.attention(resonance_topk(spark, d, coupling=0.3))
    return s.select("query_id", "id", F.round("weight", 6).alias("weight"))


def shard_assign(spark, d):
    n = _plain(_nodes(spark, d))
    # eight fixed rows stand for fitted centres, so that the result can be checked
    centres = n.where("id < 8").select(F.col("id").alias("shard"), "vector")
    return scoring.route(n, centres, 1).select("id", "shard")


def shard_route3(spark, d):
    n = _plain(_nodes(spark, d))
    return scoring.route(n.where("id % 100 = 0"), n.where("id < 8").select(F.col("id").alias("shard"), "vector"), 3)


def conformal_set(spark, d):
    s = resonance_topk(spark, d, k=20)
    t = scoring.conformal_threshold(s, "score")
    return s.crossJoin(t).where("score >= threshold").select("query_id", "id", "score", F.round("threshold", 6).alias("threshold"))


def _groups(spark, d, how):
    n = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.col("label").alias("group"))
    return scoring.group_scores(n, n.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), how=how)


def density_score(spark, d):
    """Sum of squared projections of a label's vectors on each query (an unnormalised density matrix form)."""
    return _groups(spark, d, "squares").select("query_id", F.col("group").alias("label"), F.round("score", 6).alias("score"))


def maxsim(spark, d):
    """Late interaction of labels: each query vector's best match in a label, summed over the label's queries."""
    asked = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    best = _groups(spark, d, "max").join(asked, "query_id")
    return best.groupBy(F.col("label").alias("query_id"), F.col("group").alias("doc")).agg(F.round(F.sum("score"), 6).alias("score"))


def kalman_merge(spark, d):
    """Measurement update of each vector by the next one of its label, with unit variances."""
    from pyspark.sql import Window

    n = table(spark, d, "embeddings").withColumn("z", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("z is not null")
    p, r = 1.0 + 0.01, 0.1
    g = p / (p + r + 1e-10)
    x = F.zip_with(F.col("embedding").cast("array<double>"), F.col("z").cast("array<double>"), lambda a, b: a + g * (b - a))
    return n.select("vec_id", F.round(V.norm(x), 6).alias("norm"), F.round(F.lit((1 - g) * p), 9).alias("variance"))


def label_centroids(spark, d):
    n = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return n.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


QUERIES = {
    "resonance_topk": resonance_topk,
    "resonance_phase_topk": lambda s, d: resonance_topk(s, d, coupling=0.3),
    "resonance_min_response": lambda s, d: resonance_topk(s, d, coupling=0.3, least=0.15, k=50),
    "session_boost_topk": lambda s, d: resonance_topk(s, d, boost=0.5),
    "kernel_exponential": _kernel("exponential"),
    "kernel_cosine01": _kernel("cosine01"),
    "cosine_knn": _kernel("cosine"),
    "dot_knn": _kernel("dot"),
    "euclidean_knn": _kernel("euclidean"),
    "poincare_knn": _kernel("poincare"),
    "int8_roundtrip": int8_roundtrip,
    "int8_topk": int8_topk,
    "softmax_attention": softmax_attention,
    "adaptive_depth": lambda s, d: scoring.adaptive_depth(resonance_topk(s, d, k=30)),
    "confident_depth": lambda s, d: scoring.confident_depth(_kernel("cosine", 5)(s, d)),
    "shard_assign": shard_assign,
    "shard_route3": shard_route3,
    "conformal_set": conformal_set,
    "density_score": density_score,
    "maxsim": maxsim,
    "kalman_merge": kalman_merge,
    "label_centroids": label_centroids,
}

_N = """n AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, (vec_id % 628) / 100.0 AS phase, 0.5 + (vec_id % 50) / 100.0 AS amplitude,
  0.3 + (vec_id % 70) / 100.0 AS salience, 's' || (vec_id % 7) AS session FROM embeddings),
q AS (SELECT id AS query_id, v AS qv, phase AS qphase, session AS qsession FROM n WHERE id % 100 = 0),
p AS (SELECT *, list_sum(list_transform(list_zip(v, qv), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2, list_inner_product(v, qv) AS dp,
  sqrt(list_inner_product(v, v)) AS nv, sqrt(list_inner_product(qv, qv)) AS nq FROM n, q)"""
_WEIGHT = "CAST(amplitude AS DOUBLE) * CAST(salience AS DOUBLE)"


def _top(score: str, k: int = 10, least: float | None = None, tail: str = "") -> str:
    cut = "" if least is None else f"WHERE score >= {least}"
    return f"""WITH {_N}, s AS (SELECT query_id, id, round({score}, 6) AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s {cut}) {tail or f'SELECT * FROM r WHERE rank <= {k}'}"""


_G = "exp(-d2 / 2)"
_PHASE = "(0.7 + 0.3 * (0.5 + 0.5 * cos(phase - qphase)))"
_IN = "CASE WHEN {n} >= 0.85 THEN list_transform({v}, lambda x: x * (0.85 * 0.999 / {n})) ELSE {v} END"
_INT8 = "sc AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) / 127.0 AS s FROM embeddings)"

SQL = {
    "resonance_topk": _top(f"{_G} * {_WEIGHT}"),
    "resonance_phase_topk": _top(f"{_G} * {_PHASE} * {_WEIGHT}"),
    "resonance_min_response": _top(f"{_G} * {_PHASE} * {_WEIGHT}", 50, 0.15),
    "session_boost_topk": _top(f"{_G} * {_WEIGHT} * CASE WHEN session = qsession THEN 1.5 ELSE 1 END"),
    "kernel_exponential": _top("exp(-sqrt(d2))"),
    "kernel_cosine01": _top("0.5 + 0.5 * dp / (nv * nq)"),
    "cosine_knn": _top("dp / (nv * nq)"),
    "dot_knn": _top("dp"),
    "euclidean_knn": _top("-sqrt(d2)"),
    "poincare_knn": f"""WITH {_N}, i AS (SELECT query_id, id, {_IN.format(n='nv', v='v')} AS a, {_IN.format(n='nq', v='qv')} AS b FROM p),
        s AS (SELECT query_id, id, round(-0.85 * acosh(greatest(1.0, 1 + 2 * list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))
          / greatest((0.7225 - list_inner_product(a, a)) * (0.7225 - list_inner_product(b, b)) / 0.7225, 1e-8))), 6) AS score FROM i)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""",
    "int8_roundtrip": f"""WITH {_INT8} SELECT vec_id, round(s, 9) AS scale, CAST(list_max(list_transform(v, lambda x: round(x / s))) AS INT) AS most,
        round(sqrt(list_sum(list_transform(v, lambda x: pow(x - round(x / s) * s, 2)))), 6) AS error FROM sc""",
    "int8_topk": _top("exp(-list_sum(list_transform(list_zip(list_transform(v, lambda x: round(x / sc) * sc), qv), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 2)").replace(
        "s AS (SELECT query_id, id", "pp AS (SELECT *, list_max(list_transform(v, lambda x: abs(x))) / 127.0 AS sc FROM p), s AS (SELECT query_id, id"
    ).replace("AS score FROM p)", "AS score FROM pp)"),
    "softmax_attention": _top(f"{_G} * {_PHASE} * {_WEIGHT}", tail="""SELECT query_id, id, round(exp(score) / (sum(exp(score)) OVER (PARTITION BY query_id) + 1e-8), 6) AS weight
        FROM (SELECT * FROM r WHERE rank <= 10)"""),
    "adaptive_depth": _top(f"{_G} * {_WEIGHT}", tail="""SELECT * EXCLUDE (gap) FROM (SELECT *, max(score) OVER (PARTITION BY query_id) -
        min(score) FILTER (rank <= 5) OVER (PARTITION BY query_id) AS gap FROM r WHERE rank <= 30) WHERE rank <= CASE WHEN gap < 0.1 THEN 10 ELSE 5 END"""),
    "confident_depth": _top("dp / (nv * nq)", tail="""SELECT * EXCLUDE (top) FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM r WHERE rank <= 5)
        WHERE rank <= CASE WHEN top >= 0.95 THEN 1 WHEN top >= 0.8 THEN 3 ELSE 5 END"""),
    "shard_assign": """WITH n AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
        SELECT a.id, arg_min(c.id, (round(list_distance(a.v, c.v), 6), c.id)) AS shard FROM n a, n c WHERE c.id < 8 GROUP BY a.id""",
    "shard_route3": """WITH n AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
        SELECT * FROM (SELECT a.id, c.id AS shard, row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.v, c.v), 6), c.id) AS rank
        FROM n a, n c WHERE c.id < 8 AND a.id % 100 = 0) WHERE rank <= 3""",
    "conformal_set": _top(f"{_G} * {_WEIGHT}", tail="""SELECT query_id, id, score, round(threshold, 6) AS threshold FROM (SELECT * FROM r WHERE rank <= 20),
        (SELECT CASE WHEN ceil((count(*) + 1) * 0.9 - 1e-9) > count(*) THEN 0 ELSE list_sort(list(score))[CAST(count(*) - ceil((count(*) + 1) * 0.9 - 1e-9) + 1 AS BIGINT)] END AS threshold
         FROM r WHERE rank <= 20) WHERE score >= threshold"""),
    "density_score": f"WITH {_N} SELECT query_id, label, round(sum(dp * dp), 6) AS score FROM p JOIN embeddings ON vec_id = id GROUP BY ALL",
    "maxsim": f"""WITH {_N}, t AS (SELECT e2.label AS query_id, p.query_id AS tok, e1.label AS doc, max(dp) AS m FROM p JOIN embeddings e1 ON e1.vec_id = p.id
        JOIN embeddings e2 ON e2.vec_id = p.query_id GROUP BY ALL) SELECT query_id, doc, round(sum(m), 6) AS score FROM t GROUP BY ALL""",
    "kalman_merge": """WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, lead(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS z FROM embeddings),
        g AS (SELECT *, 1.01 / (1.01::DOUBLE + 0.1 + 1e-10) AS g FROM n WHERE z IS NOT NULL)
        SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(x, z), lambda a: pow(a[1] + g * (a[2] - a[1]), 2)))), 6) AS norm, round((1 - g) * 1.01::DOUBLE, 9) AS variance FROM g""",
    "label_centroids": """SELECT label, CAST(dim - 1 AS INT) AS dim, round(avg(x), 6) AS mean FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x,
        generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY ALL""",
}
