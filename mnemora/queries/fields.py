"""Tension, health, merges and groups of the vectors' field; every hundredth vector asks, in the queries ending in ``_all`` and ``dead_zones`` every one."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemora.functions import vectors as V
from mnemora.operators import field as D
from mnemora.operators import scoring
from mnemora.queries.similarity import _asked, _N, _nodes


def tension_topology(s, d):
    n = _nodes(s, d)
    t = D.tension(n, _asked(n))
    return t.select("query_id", F.round("tension", 5).alias("tension"), F.round(D.soft_gate(F.col("tension")), 5).alias("gate"))


def field_health(s, d):
    n = _nodes(s, d)
    return D.health(n, _asked(n))


def merge_candidates(s, d):
    n = _nodes(s, d)
    return D.merge_candidates(n, _asked(n))


def tension_topology_all(s, d):
    n = _nodes(s, d)
    t = D.tension(n, D.every(n))
    return t.select("query_id", F.round("tension", 5).alias("tension"), F.round(D.soft_gate(F.col("tension")), 5).alias("gate"))


def field_health_all(s, d):
    return D.whole_health(_nodes(s, d))


def dead_zones(s, d):
    return D.dead_zones(_nodes(s, d))


def merge_candidates_all(s, d):
    n = _nodes(s, d)
    return D.merge_candidates(n, D.every(n))


def _engrams(s, d):
    n = _nodes(s, d)
    return n, D.engrams(scoring.topk(n.select("id", "vector"), _asked(n), 20, kernel="cosine01"))


def engram_members(s, d):
    return D.engram_decay(_engrams(s, d)[1], 100).withColumn("weight", F.round("weight", 6))


def engram_centroids(s, d):
    n, e = _engrams(s, d)
    return D.engram_centroids(e, n).withColumn("value", F.round("value", 6))


def reinforce_step(s, d):
    """Halved vectors as inputs: near enough to be drawn or new."""
    n = _nodes(s, d)
    inputs = _asked(n).select("query_id", F.transform("vector", lambda x: (x * 0.5).cast("float")).alias("vector"))
    r = D.reinforce(n, inputs)
    return r.select("query_id", "id", "action", F.round(V.norm("vector"), 5).alias("norm"))


def dp_clip(s, d):
    return _nodes(s, d).select("id", F.round(V.norm(D.clipped("vector", 0.5)), 6).alias("norm"))


def field_position(s, d):
    """Mean position of all nodes, value by value."""
    x = _nodes(s, d).select(F.posexplode("vector").alias("dim", "x"))
    return x.groupBy("dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_NEAR = f"""{_N}, a AS (SELECT query_id, id, round(-sqrt(d2), 6) AS s FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM a),
nn AS (SELECT query_id, id, -s AS distance, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM k WHERE id <> query_id)"""
_EN = f"""{_N}, a AS (SELECT query_id, id, round(0.5 + 0.5 * dp / (nv * nq), 6) AS s FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM a),
en AS (SELECT query_id AS engram, id, s AS weight FROM (SELECT *, avg(s) OVER (PARTITION BY query_id) AS m, count(*) OVER (PARTITION BY query_id) AS n FROM k WHERE rank <= 20) WHERE n >= 2 AND m >= 0.6)"""
SQL = {
    "tension_topology": f"""WITH {_NEAR}, t AS (SELECT query_id, 0.6::DOUBLE * (stddev_pop(cos(phase)) + stddev_pop(sin(phase))) + 0.4::DOUBLE * stddev_pop(CAST(salience AS DOUBLE)) AS t FROM nn JOIN n USING (id) WHERE place <= 10 GROUP BY query_id)
        SELECT query_id, round(t, 5) AS tension, round(1 / (1 + exp(-(t - 0.15::DOUBLE) / 0.15::DOUBLE)), 5) AS gate FROM t""",
    "field_health": f"""WITH {_NEAR}, x AS (SELECT distance FROM nn WHERE place = 1), m AS (SELECT quantile_cont(distance, 0.5) AS m FROM x),
        hh AS (SELECT count(*) AS asked, count(*) FILTER (distance > m * 1.75::DOUBLE) AS dead, avg(CAST(distance > 2 AS DOUBLE)) AS f, avg(distance) AS mean FROM x, m)
        SELECT asked, dead, round(f, 6) AS fragmented, round(mean, 6) AS mean, CASE WHEN mean < 0.05 OR f > 0.8 THEN 'critical' WHEN dead > 0.3 * asked OR f > 0.6 THEN 'degraded' ELSE 'healthy' END AS state FROM hh""",
    "merge_candidates": f"""WITH {_NEAR}, c AS (SELECT nn.query_id, nn.id, distance, abs(CAST(n.phase AS DOUBLE) - q.qphase) % 6.283185307179586 AS g FROM nn JOIN n ON n.id = nn.id JOIN q ON q.query_id = nn.query_id WHERE distance < 2.5)
        SELECT query_id, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS k FROM c WHERE least(g, 6.283185307179586 - g) > 1) WHERE k = 1""",
    "engram_members": f"WITH {_EN} SELECT engram, id, round(weight * pow(0.998::DOUBLE, 100), 6) AS weight FROM en",
    "engram_centroids": f"""WITH {_EN}, x AS (SELECT engram, weight, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM en JOIN n USING (id))
        SELECT engram, CAST(dim AS INT) AS dim, round(sum(weight * x) / sum(weight), 6) AS value FROM x GROUP BY ALL""",
    "reinforce_step": f"""WITH {_N}, h AS (SELECT query_id, id, v, list_transform(qv, lambda x: x * 0.5) AS hv FROM p),
        s AS (SELECT *, round(exp(-pow(list_distance(v, hv), 2) / 2), 6) AS score FROM h), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s)
        SELECT query_id, CASE WHEN score > 0.3 THEN id END AS id, CASE WHEN score > 0.3 THEN 'reinforce' ELSE 'insert' END AS action,
          round(CASE WHEN score > 0.3 THEN sqrt(list_sum(list_transform(list_zip(v, hv), lambda z: pow(z[1] + 0.02 * (z[2] - z[1]), 2)))) ELSE sqrt(list_inner_product(hv, hv)) END, 5) AS norm FROM b WHERE k = 1""",
    "field_position": "SELECT CAST(dim AS INT) AS dim, round(avg(x), 6) AS mean FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY dim",
    "dp_clip": f"WITH {_N} SELECT id, round(least(sqrt(list_inner_product(v, v)), 0.5), 6) AS norm FROM n",
}

# the same fields with every node asking: the sampled set of _N taken whole
_ASKS = " WHERE id % 100 = 0"
_ALL = _NEAR.replace(_ASKS, "")
SQL |= {
    "tension_topology_all": SQL["tension_topology"].replace(_ASKS, ""),
    "merge_candidates_all": SQL["merge_candidates"].replace(_ASKS, ""),
    "dead_zones": f"WITH {_ALL}, x AS (SELECT query_id, distance FROM nn WHERE place = 1), m AS (SELECT quantile_cont(distance, 0.5) AS m FROM x) SELECT query_id AS id, distance FROM x, m WHERE distance > m * 1.75::DOUBLE",
    "field_health_all": f"""WITH {_ALL}, x AS (SELECT distance FROM nn WHERE place = 1), m AS (SELECT quantile_cont(distance, 0.5) AS m FROM x), w AS (SELECT avg(sqrt(d2)) AS mean FROM p WHERE id <> query_id),
        hh AS (SELECT count(*) AS nodes, count(*) FILTER (distance > m * 1.75::DOUBLE) AS dead, avg(CAST(distance > 2 AS DOUBLE)) AS f FROM x, m)
        SELECT nodes, dead, round(f, 6) AS fragmented, round(mean, 6) AS mean_pairwise, mean < 0.05 AS hyperconverged, CASE WHEN mean < 0.05 OR f > 0.8 THEN 'critical' WHEN dead > 0.3 * nodes OR f > 0.6 THEN 'degraded' ELSE 'stable' END AS state FROM hh, w""",
}
