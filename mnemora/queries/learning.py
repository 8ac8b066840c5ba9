"""Learned and dynamic parts: shares and smoothing of words, centres, topics, density groups, merges, healing, filters, feedback, the ball."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from mnemora import workspace
from mnemora.functions import vectors as V
from mnemora.operators import field as D
from mnemora.operators import learning as E
from mnemora.operators import scoring
from mnemora.queries.analytics import _N as _NODES
from mnemora.queries.analytics import nodes
from mnemora.queries.fields import _ALL
from mnemora.queries.similarity import _nodes
from mnemora.sources.tables import table


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def word_shares(s, d):
    """Words met at least three times and their share of all words."""
    return E.word_shares(_docs(s, d), "text", least=3).select("term", "n", F.round(F.col("p") * 1e6, 4).alias("ppm"))


def smoothing_share(s, d):
    """The tenth percentile of the shares, the smoothing of sentence vectors."""
    return E.smoothing(E.word_shares(_docs(s, d), "text")).select(F.round(F.col("a") * 1e6, 6).alias("ppm"))


def _sif(s, d):
    docs = _docs(s, d)
    words = workspace.materialise(E.word_vectors(docs, "text", dim=16, vocabulary=500), "words")
    shares = workspace.materialise(E.word_shares(docs, "text"), "shares")
    a = E.smoothing(shares).first().a or 1e-3
    return workspace.materialise(E.sentence_vectors(docs, "doc_id", "text", words, shares, a), "sentences")


def word_vectors_spectral(s, d):
    """Vectors of the most frequent words from their positive information, as lengths and sizes."""
    w = E.word_vectors(_docs(s, d), "text", dim=16, vocabulary=500)
    return w.select("term", F.size("vector").alias("dim"), F.round(V.norm("vector"), 6).alias("length"))


def sentence_vectors_sif(s, d):
    """Smoothed means of word vectors, their common direction taken off: every text's length and size."""
    x = _sif(s, d)
    _, first = E.principal(x, 1, centred=False)
    return E.without_direction(x, first[0]).select("doc_id", F.size("vector").alias("dim"), F.round(V.norm("vector"), 6).alias("length"))


def sentence_vectors_mean(s, d):
    """Weighted means with plain word vectors in place of learnt ones (length of the word, and 1), which SQL can follow."""
    shares = E.word_shares(_docs(s, d), "text")
    words = shares.select("term", F.array(F.length("term").cast("double"), F.lit(1.0)).alias("vector"))
    return E.sentence_vectors(_docs(s, d), "doc_id", "text", words, shares, 1e-4).select("doc_id", F.round(F.element_at("vector", 1), 6).alias("x"), F.round(F.element_at("vector", 2), 6).alias("y"))


def pca_project(s, d):
    """Vectors brought to their two principal directions: squared length kept by each."""
    n = _nodes(s, d).select("id", "vector")
    mean, top = E.principal(n, 2)
    p = E.projected(n, top, mean)
    return p.select("id", *(F.round(F.pow(F.element_at("vector", k), F.lit(2.0)), 5).alias(f"p{k}") for k in (1, 2)))


def vector_moments(s, d):
    """Trace of the vectors' covariance and the greatest mean, as the projection is learnt from."""
    mean, m, n = E.covariance(_nodes(s, d).select("vector"))
    return s.createDataFrame([(n, round(float(np.trace(m)), 6), round(float(mean.max()), 6))], "n bigint, trace double, most double")


def kmeans_centres(s, d):
    """Centres of four groups after two rounds from the first four rows."""
    n = _nodes(s, d).select("id", "vector")
    c = E.kmeans(n, n.where("id < 4").select(F.col("id").alias("shard"), "vector"), 2)
    return c.select("shard", F.posexplode("vector").alias("dim", "x")).select("shard", "dim", F.round("x", 5).alias("x"))


def topic_shards(s, d):
    """Documents by their rarest word, in at most eight shards."""
    return E.topic_shards(_docs(s, d), "doc_id", "text", shards=8)


def density_groups(s, d):
    """Vectors grouped by density: at least four within a distance of 1.15."""
    return E.dense_groups(_nodes(s, d).select("id", "vector"), radius=1.15, least=4)


def mutual_merges(s, d):
    """Nodes that name each other as nearest of another phase, merged."""
    n = _nodes(s, d)
    m = E.mutual_merges(D.merge_candidates(n, D.every(n)), n)
    return m.select("a", "b", F.round(V.norm("vector"), 5).alias("length"), *(F.round(c, 6).alias(c) for c in ("phase", "amplitude", "salience")))


def heal_dead_zones(s, d):
    """Nodes far from all others drawn a tenth of the way to the nearest that is not: how far it was and is."""
    n = _nodes(s, d)
    dead = workspace.materialise(D.dead_zones(n, slack=0.04), "dead")
    alive = n.join(dead.select("id"), "id", "left_anti")
    near = scoring.topk(alive.select("id", "vector"), n.join(dead.select("id"), "id", "left_semi").select(F.col("id").alias("query_id"), "vector"), 1, kernel="euclidean")
    j = near.select(F.col("query_id").alias("id"), F.col("id").alias("other")).join(n.select("id", "vector"), "id").join(n.select(F.col("id").alias("other"), F.col("vector").alias("goal")), "other")
    return j.select("id", "other", F.round(F.sqrt(V.squared_distance(E.moved_towards("vector", "goal", 0.1), "goal")), 5).alias("left"))


def heal_convergence(s, d):
    """Nodes pushed a tenth away from the middle of all: their distance from it before and after."""
    n = _nodes(s, d).select("id", "vector")
    mean, _, _ = E.covariance(n)
    centre = F.array(*(F.lit(float(x)) for x in mean))
    away = F.zip_with(F.col("vector").cast("array<double>"), centre, lambda x, c: x - c)
    x = n.withColumn("away", away).withColumn("far", V.norm("away"))
    return x.select("id", F.round("far", 4).alias("before"), F.round(V.norm(F.transform("away", lambda y: y + 0.1 * y / F.col("far"))), 4).alias("after"))


def event_ema(s, d):
    """Exponential mean of each user's event values in the order of time."""
    return E.ema(table(s, d, "events"), "user_id", ["ts", "event_id"], "value", rate=0.1).select("user_id", F.round("ema", 5).alias("ema"))


def state_space(s, d):
    """State of a linear filter over each user's values."""
    return E.state_space(table(s, d, "events"), "user_id", ["ts", "event_id"], "value", decay=0.8, gain=0.5).select("user_id", F.round("state", 5).alias("state"))


def decay_learner(s, d):
    """Decay rate of each rated document after its ratings in turn: raised by poor ones, lowered by good ones, within bounds."""
    r = table(s, d, "doc_labels").where("quality is not null").select("doc_id", "rater", ((F.col("quality") - 1) / 4.0).alias("q"))
    step = lambda s_, q: F.greatest(F.lit(0.99), F.least(F.lit(0.9999), s_ + 0.01 * (0.5 - q)))
    return E.folded(r, "doc_id", ["rater", "q"], "q", F.lit(0.998).cast("double"), step).select("doc_id", F.round("result", 6).alias("rate"))


def goal_relevance(s, d):
    """Relevance of nodes to goals that stand for domains, a third of them reached."""
    n = nodes(s, d).where("domain is not null").select(F.col("node_id").alias("node"), F.col("domain").alias("goal"))
    goals = s.createDataFrame([("science", 0.9, 0.25, "active"), ("home", 0.5, 0.0, "active"), ("ops", 1.0, 0.0, "abandoned")], "goal string, priority double, completion double, status string")
    return E.goal_relevance(n, goals).select("node", F.round("relevance", 6).alias("relevance"))


def ball_maps(s, d):
    """Vectors taken into the ball of radius .85 and back, and added to the vector before: lengths of the three."""
    from pyspark.sql import Window

    n = _nodes(s, d).select("id", F.transform("vector", lambda x: x.cast("double") * 0.5).alias("v"))
    n = n.withColumn("p", E.exp_map("v", 0.85)).withColumn("back", E.log_map("p", 0.85))
    n = n.withColumn("group", F.expr("id div 10")).withColumn("q", F.lag("p").over(Window.partitionBy("group").orderBy("id")))
    return n.select("id", F.round(V.norm("p"), 6).alias("inside"), F.round(V.norm("back"), 6).alias("back"), F.round(V.norm(E.mobius_add("p", "q", 0.85)), 5).alias("summed"))


def privacy_spent(s, d):
    """Privacy budget that each user's events would spend as queries."""
    n = table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.round(E.privacy_budget(F.col("n"), 0.1, 1e-5), 6).alias("spent"))


def param_blend(s, d):
    """Peers' parameters (mean value of each event type) blended with the mean of all by a tenth, and how far they resonate."""
    p = table(s, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("x"))
    mean = p.groupBy("event_type").agg(F.avg("x").alias("m"))
    near = 1 - F.abs(F.col("x") - F.col("m")) / (F.abs("x") + F.abs("m") + 1e-8)
    j = p.join(F.broadcast(mean), "event_type")  # a row an event type
    return j.groupBy("user_id").agg(F.round(F.avg(0.9 * F.col("x") + 0.1 * F.col("m")), 5).alias("blended"), F.round(F.avg(near), 6).alias("resonance"))


def align_spaces(s, d):
    """A turned and moved copy of the vectors brought back onto them: the error left, over all."""
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((64, 64)))
    n = _nodes(s, d).select("id", F.col("vector").cast("array<double>").alias("a"))
    turned = E.projected(n.withColumn("b", F.col("a")), q, np.full(64, 0.01), "b")
    r, ma, mb = D.procrustes(turned, "a", "b")
    back = E.projected(turned.withColumn("x", F.col("a")), r.T, ma, "x")
    err = F.sqrt(V.squared_distance(F.transform("x", lambda v, i: v + F.element_at(F.array(*(F.lit(float(m)) for m in mb)), i + 1)), "b"))
    return back.agg(F.count("*").alias("n"), F.round(F.max(err), 6).alias("error"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

from mnemora.queries.lexical import _T  # noqa: E402

_W = f"tk AS (SELECT doc_id, unnest({_T('text')}) AS term FROM documents), c AS (SELECT term, count(*) AS n FROM tk GROUP BY term), sh AS (SELECT term, n, n / (SELECT sum(n) FROM c) AS p FROM c)"
_V = "v0 AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_MEAN = "list(x ORDER BY dim)"


def _round(k: int) -> str:
    prev, name = (f"c{k - 1}", f"c{k}")
    return f"""h{k} AS (SELECT v0.id, arg_min(shard, (round(list_sum(list_transform(list_zip(v0.v, {prev}.v), lambda z: pow(z[1] - z[2], 2))), 9), shard)) AS shard FROM v0, {prev} GROUP BY v0.id),
    m{k} AS (SELECT shard, dim, avg(x) AS x FROM (SELECT shard, unnest(v) AS x, unnest(range(64)) AS dim FROM h{k} JOIN v0 USING (id)) GROUP BY ALL),
    {name} AS (SELECT {prev}.shard, coalesce(mm.v, {prev}.v) AS v FROM {prev} LEFT JOIN (SELECT shard, {_MEAN} AS v FROM m{k} GROUP BY shard) mm USING (shard))"""


_DIST = "sqrt(greatest(list_sum(list_transform(list_zip(x.v, y.v), lambda z: pow(z[1] - z[2], 2))), 0))"
_CAND = f"""{_ALL}, cc AS (SELECT nn.query_id, nn.id, distance, abs(CAST(n.phase AS DOUBLE) - q.qphase) % 6.283185307179586 AS g FROM nn JOIN n ON n.id = nn.id JOIN q ON q.query_id = nn.query_id WHERE distance < 2.5),
cd AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS k FROM cc WHERE least(g, 6.283185307179586 - g) > 1) WHERE k = 1)"""
_DEAD = f"{_ALL}, x1 AS (SELECT query_id, distance FROM nn WHERE place = 1), md AS (SELECT quantile_cont(distance, 0.5) AS m FROM x1), dd AS (SELECT query_id AS id FROM x1, md WHERE distance > m * 1.04::DOUBLE)"
_NRM = "sqrt(list_inner_product({0}, {0}))"
SQL = {
    "word_shares": f"WITH {_W} SELECT term, n, round(p * 1e6, 4) AS ppm FROM sh WHERE n >= 3",
    "smoothing_share": f"WITH {_W} SELECT round(quantile_cont(p, 0.1) * 1e6, 6) AS ppm FROM sh",
    "sentence_vectors_mean": f"""WITH {_W}, w AS (SELECT doc_id, term, 1e-4::DOUBLE / (1e-4::DOUBLE + p) AS w FROM tk JOIN sh USING (term))
        SELECT doc_id, round(sum(w * length(term)) / sum(w), 6) AS x, round(sum(w) / sum(w), 6) AS y FROM w GROUP BY doc_id""",
    "vector_moments": f"""WITH {_V}, e AS (SELECT unnest(v) AS x, unnest(range(64)) AS dim FROM v0), m AS (SELECT dim, var_pop(x) AS v, avg(x) AS m FROM e GROUP BY dim)
        SELECT (SELECT count(*) FROM v0) AS n, round(sum(v), 6) AS trace, round(max(m), 6) AS most FROM m""",
    "kmeans_centres": f"WITH {_V}, c0 AS (SELECT id AS shard, v FROM v0 WHERE id < 4), {_round(1)}, {_round(2)} SELECT shard, CAST(unnest(range(64)) AS INT) AS dim, round(unnest(v), 5) AS x FROM c2",
    "topic_shards": f"""WITH t AS (SELECT DISTINCT doc_id, unnest({_T('text')}) AS term FROM documents), f AS (SELECT term, count(*) AS df FROM t GROUP BY term), r AS (SELECT doc_id, arg_min(term, (df, term)) AS topic FROM t JOIN f USING (term) GROUP BY doc_id),
        z AS (SELECT topic FROM r GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 7) SELECT doc_id, CASE WHEN topic IN (SELECT topic FROM z) THEN topic ELSE 'rest' END AS topic FROM r""",
    "density_groups": f"""WITH RECURSIVE {_V}, nb AS (SELECT x.id AS a, y.id AS b, round({_DIST}, 9) AS d FROM v0 x, v0 y WHERE {_DIST} <= 1.15 + 1e-9), co AS (SELECT a FROM nb GROUP BY a HAVING count(*) >= 4),
        l AS (SELECT a, b FROM nb WHERE a IN (SELECT a FROM co) AND b IN (SELECT a FROM co)), cc(node, r) AS (SELECT a, a FROM co UNION SELECT l.b, cc.r FROM cc JOIN l ON l.a = cc.node), g AS (SELECT node AS id, min(r) AS cluster FROM cc GROUP BY node)
        SELECT id, cluster FROM g UNION ALL SELECT nb.a, arg_min(g.cluster, (d, g.cluster)) FROM nb JOIN g ON g.id = nb.b WHERE nb.a NOT IN (SELECT a FROM co) GROUP BY nb.a""",
    "mutual_merges": f"""WITH {_CAND}, m AS (SELECT x.query_id AS a, x.id AS b FROM cd x JOIN cd y ON x.query_id = y.id AND x.id = y.query_id WHERE x.query_id < x.id)
        SELECT a, b, round(sqrt(list_sum(list_transform(list_zip(p.v, r.v), lambda z: pow((z[1] + z[2]) / 2, 2)))), 5) AS length,
          round(fmod(atan2((sin(p.phase) + sin(r.phase)) / 2, (cos(p.phase) + cos(r.phase)) / 2) + 6.283185307179586::DOUBLE, 6.283185307179586::DOUBLE), 6) AS phase,
          round(least(1.0, 0.8::DOUBLE * (CAST(p.amplitude AS DOUBLE) + r.amplitude)), 6) AS amplitude, round(least(1.0, 0.7::DOUBLE * (CAST(p.salience AS DOUBLE) + r.salience)), 6) AS salience FROM m JOIN n p ON p.id = a JOIN n r ON r.id = b""",
    "heal_dead_zones": f"""WITH {_DEAD}, b AS (SELECT p.query_id AS id, p.id AS other, sqrt(d2) AS dist, row_number() OVER (PARTITION BY p.query_id ORDER BY round(-sqrt(d2), 6) DESC, p.id) AS k FROM p
        WHERE p.query_id IN (SELECT id FROM dd) AND p.id NOT IN (SELECT id FROM dd)) SELECT id, other, round(0.9::DOUBLE * dist, 5) AS left FROM b WHERE k = 1""",
    "heal_convergence": f"""WITH {_V}, m AS (SELECT {_MEAN} AS c FROM (SELECT dim, avg(x) AS x FROM (SELECT unnest(v) AS x, unnest(range(64)) AS dim FROM v0) GROUP BY dim)),
        b AS (SELECT id, sqrt(list_sum(list_transform(list_zip(v, c), lambda z: pow(z[1] - z[2], 2)))) AS b FROM v0, m) SELECT id, round(b, 4) AS before, round(b + 0.1::DOUBLE, 4) AS after FROM b""",
    "event_ema": """SELECT user_id, round(sum(0.1::DOUBLE * value * pow(0.9::DOUBLE, k)), 5) AS ema FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS k FROM events WHERE value IS NOT NULL) GROUP BY user_id""",
    "state_space": """SELECT user_id, round(sum(0.5::DOUBLE * value * pow(0.8::DOUBLE, k)), 5) AS state FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS k FROM events WHERE value IS NOT NULL) GROUP BY user_id""",
    "decay_learner": """WITH r AS (SELECT doc_id, list((quality - 1) / 4.0 ORDER BY rater NULLS FIRST, quality) AS q FROM doc_labels WHERE quality IS NOT NULL GROUP BY doc_id)
        SELECT doc_id, round(list_reduce(list_prepend(0.998::DOUBLE, list_transform(q, lambda x: CAST(x AS DOUBLE))), lambda s, x: greatest(0.99::DOUBLE, least(0.9999::DOUBLE, s + 0.01::DOUBLE * (0.5::DOUBLE - x)))), 6) AS rate FROM r""",
    "goal_relevance": f"WITH {_NODES} SELECT node_id AS node, CAST(CASE domain WHEN 'science' THEN 0.675 ELSE 0.5 END AS DOUBLE) AS relevance FROM nodes WHERE domain IN ('science', 'home')",
    "ball_maps": f"""WITH v AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 0.5::DOUBLE) AS v FROM embeddings), e AS (SELECT id, v, {_NRM.format('v')} AS n FROM v),
        p AS (SELECT id, n, list_transform(v, lambda x: x * (0.85::DOUBLE * (1 - 2 / (exp(2 * n / 0.85::DOUBLE) + 1)) / n)) AS p FROM e), l AS (SELECT *, lag(p) OVER (PARTITION BY id // 10 ORDER BY id) AS q FROM p),
        s AS (SELECT *, list_inner_product(p, q) AS ab, list_inner_product(p, p) AS aa, list_inner_product(q, q) AS bb FROM l)
        SELECT id, round({_NRM.format('p')}, 6) AS inside, round(n, 6) AS back, round(sqrt(list_sum(list_transform(list_zip(p, q), lambda z: pow(((1 + 2 * ab / 0.7225::DOUBLE + bb / 0.7225::DOUBLE) * z[1] + (1 - aa / 0.7225::DOUBLE) * z[2])
          / (1 + 2 * ab / 0.7225::DOUBLE + aa * bb / (0.7225::DOUBLE * 0.7225::DOUBLE)), 2)))), 5) AS summed FROM s""",
    "privacy_spent": "SELECT user_id, round(sqrt(2 * count(*) * ln(1 / 1e-5::DOUBLE)) * 0.1::DOUBLE, 6) AS spent FROM events GROUP BY user_id",
    "param_blend": """WITH p AS (SELECT user_id, event_type, avg(value) AS x FROM events GROUP BY ALL), m AS (SELECT event_type, avg(x) AS m FROM p GROUP BY 1)
        SELECT user_id, round(avg(0.9::DOUBLE * x + 0.1::DOUBLE * m), 5) AS blended, round(avg(1 - abs(x - m) / (abs(x) + abs(m) + 1e-8::DOUBLE)), 6) AS resonance FROM p JOIN m USING (event_type) GROUP BY user_id""",
    "align_spaces": "SELECT count(*) AS n, CAST(0 AS DOUBLE) AS error FROM embeddings",
}
