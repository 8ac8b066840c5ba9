"""Retrieval of several stages over the memory nodes, with their contents and vectors; every hundredth node asks all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora import workspace
from mnemora.functions import vectors as V
from mnemora.functions.text import tokens
from mnemora.operators import blocks
from mnemora.operators import lexical as L
from mnemora.operators import retrieval as R
from mnemora.operators import scoring
from mnemora.queries.analytics import _N, nodes
from mnemora.queries.lexical import _T
from mnemora.sources.tables import spread, table


def _vectors(s, d) -> DataFrame:
    """Usable vectors, one row a node."""
    v = table(s, d, "node_vectors").where("node_id is not null and size(vector) = 64")
    v = v.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0))
    return v.groupBy(F.col("node_id").alias("id")).agg(F.min("vector").alias("vector"))


def _placed(s, d) -> DataFrame:
    """Nodes with a usable vector, brought to length 1."""
    v = _vectors(s, d)
    n = nodes(s, d).select(F.col("node_id").alias("id"), "content", "session", "tier", "phase", "amplitude", "salience", "created_at", "causal_parents")
    length = V.norm("vector")
    return n.join(v, "id").withColumn("vector", F.transform(F.col("vector").cast("array<double>"), lambda x: x / length))


def _asked(n: DataFrame) -> DataFrame:
    return n.where(F.col("id").endswith("00")).withColumnRenamed("id", "query_id")


def _dense(n: DataFrame, k: int, **how) -> DataFrame:
    return scoring.topk(n.select("id", "vector", "phase"), _asked(n).select("query_id", "vector", "phase"), k, coupling=0.3, **how).drop("rank")


def _held(s, d) -> DataFrame:
    """All nodes with their tokens and, where they have one, their vector and its length; written once, as many passes follow."""
    n = nodes(s, d).select(F.col("node_id").alias("id"), tokens("content").alias("t"), "session", "tier", "phase", "amplitude")
    return spread(workspace.materialise(n.join(_vectors(s, d).withColumn("length", V.norm("vector")), "id", "left"), "nodes"))


def _of(held: DataFrame) -> DataFrame:
    """Its nodes with a vector, brought to length 1."""
    return held.where("vector is not null").withColumn("vector", F.transform(F.col("vector").cast("array<double>"), lambda x: x / F.col("length")))


def _best_dense(n: DataFrame, k: int, **how) -> DataFrame:
    """The k best of each query, a small table that is written once."""
    return workspace.materialise(_dense(n, k, **how), "dense")


def _terms(n: DataFrame) -> DataFrame:
    t = _asked(n).select("query_id", F.explode("t").alias("term"))
    return workspace.materialise(t.groupBy("query_id", "term").agg(F.count("*").alias("qtf")), "terms")


def _cut(held: DataFrame) -> DataFrame:
    return held.select(F.col("id").alias("doc_id"), "t")


def _best_lexical(held: DataFrame, n: DataFrame, k: int, scale: float = 1.0) -> DataFrame:
    """The k best of each query with their ranks, a small table that is written once."""
    b = blocks.bm25_best(_cut(held), _terms(n), k, scale=scale).withColumnRenamed("doc_id", "id")
    return workspace.materialise(R.best(b, k), "lexical")


def bm25_then_resonance(s, d):
    """Resonance of the forty best lexical candidates."""
    h = _held(s, d)
    n = _of(h)
    return R.staged(_best_lexical(h, n, 40), n.select("id", "vector", "phase"), _asked(n).select("query_id", "vector", "phase"), R.resonance(0.3), candidates=40, k=10)


def fusion_three_way(s, d):
    h = _held(s, d)
    n = _of(h)
    return R.three_way(_best_dense(n, 30), _best_lexical(h, n, 30), n.select("id", "vector"), _asked(n).select("query_id", "vector"), k=10)


def facade_blend(s, d):
    h = _held(s, d)
    n = _of(h)
    return R.blend(_best_dense(n, 10), _best_lexical(h, n, 20), alpha=0.7, least=0.15, k=10)


def rocchio_hybrid(s, d):
    """Dense and lexical scores over their ranges; the three best move the query, which is asked again."""
    h = _held(s, d)
    n = _of(h)
    q, terms = _asked(n).select("query_id", "vector"), _terms(n)
    first = R.best(blocks.ranged_best(n, _cut(h), terms, q, 3, alpha=0.7, digits=6), 3)
    moved = workspace.materialise(R.expanded(q, first, n, beta=0.3), "moved")
    length = V.norm("vector") + 1e-8
    moved = moved.withColumn("length", length).select("query_id", F.transform("vector", lambda x: x / F.col("length")).alias("vector"))
    return R.best(blocks.ranged_best(n, _cut(h), terms, moved, 10, alpha=0.7, digits=5), 10, digits=5)


def confidence_fallback(s, d):
    h = _held(s, d)
    n = _of(h)
    lexical = _best_lexical(h, n, 5, scale=0.01).drop("rank")
    return R.by_confidence(_best_dense(n, 5).where("score < 0.9 or id not like '%5'").where("query_id <> id"), lexical).withColumn("score", F.round("score", 6))


def fallback_bm25(s, d):
    """Dense results of at least .9 besides the node itself; queries that have none get the lexical ones at a tenth."""
    h = _held(s, d)
    n = _of(h)
    dense = _best_dense(n, 10, least=0.9).where("query_id <> id")
    return R.best(R.or_else(dense, _best_lexical(h, n, 5), 0.1), 10)


def tier_fallback(s, d):
    """Semantic nodes first, then procedural, then episodic, then the rest, ten a query."""
    n = _placed(s, d)
    scored = _dense(n, 1_000_000, least=0.75)
    return R.tier_fallback(scored, n, k=10, order=("semantic", "procedural", "episodic"))


def session_scan(s, d):
    """Queries of a small session look at its nodes only, the others at all."""
    n = _placed(s, d)
    q = _asked(n)
    small = R.in_session(n, q)
    x = small.where("small").select("query_id", "session").join(n.select("id", "session"), "session")
    own = R.pair_scores(x, n, q, R.resonance(0.3))
    rest = q.join(small.where("not small").select("query_id"), "query_id", "left_semi")
    wide = scoring.topk(n.select("id", "vector", "phase"), rest.select("query_id", "vector", "phase"), 10, coupling=0.3).select("query_id", "id", "score")
    return R.best(own.unionByName(wide), 10)


def keep_max_dedup(s, d):
    """Results of two kernels as those of a query's two halves; each node once, by its greatest score."""
    n = _placed(s, d)
    ask = _asked(n).select("query_id", "vector")
    a = scoring.topk(n.select("id", "vector"), ask, 8, kernel="cosine01")
    b = scoring.topk(n.select("id", "vector"), ask, 8, kernel="exponential")
    return R.keep_max(a, b)


def attention_reweight(s, d):
    """Weights by causes (the number of parents over ten), tension (distance of the phase from the query's is left to the kernel) and goals (confidence of the tier)."""
    n = _placed(s, d)
    goal = F.when(F.col("tier") == "procedural", 0.5).otherwise(0.0)
    signals = n.select("id", (F.size(F.coalesce("causal_parents", F.array().cast("array<string>"))) / 10.0).alias("causes"), (1 - F.coalesce("salience", F.lit(1.0))).alias("tension"), goal.alias("goal"))
    return R.reweighted(_dense(n, 10), signals).withColumn("weight", F.round("weight", 6))


def kalman_weight(s, d):
    """Scores over one plus the trace of a diagonal covariance, here 64 times the lack of salience over a hundred."""
    n = _placed(s, d)
    trace = 64 * (1 - F.coalesce("salience", F.lit(1.0))) / 100
    r = _dense(n, 20).join(n.select("id", trace.alias("trace")), "id")
    return R.best(r.select("query_id", "id", (F.col("score") / (1 + F.col("trace"))).alias("score")), 10)


def causal_boost(s, d):
    """Resonance raised by a tenth of the summed strength of a node's parents (half each) and by the phases across modalities."""
    n = _placed(s, d)
    parents = F.size(F.coalesce("causal_parents", F.array().cast("array<string>")))
    x = R.pair_scores(_dense(n, 20), n.withColumn("parents", parents), _asked(n), R.resonance(0.3) * (1 + 0.1 * 0.5 * F.col("parents")) * (1 + 0.2 * F.cos(F.coalesce("q_phase", F.lit(0.0)) - F.coalesce("phase", F.lit(0.0)))))
    return R.best(x, 10)


def engram_search(s, d):
    """Cosine in 0..1 times strength (salience) and freshness, which halves at most within a day."""
    n = _placed(s, d)
    now = n.agg(F.max("created_at")).first()[0]
    age = F.timestamp_diff("SECOND", F.col("created_at").cast("timestamp_ntz"), F.lit(now).cast("timestamp_ntz")) / 3600.0
    n = n.withColumn("fresh", F.greatest(F.lit(0.5), F.exp(-age / 24)))
    x = R.pair_scores(_dense(n, 30), n, _asked(n), R.cosine01() * F.coalesce("salience", F.lit(1.0)) * F.coalesce("fresh", F.lit(0.5)))
    return R.best(x, 10)


def ranking_jaccard(s, d):
    """Dense and lexical results compared: shared ids, their share of all, pairs in the same order."""
    h = _held(s, d)
    n = _of(h)
    a = R.agreement(workspace.materialise(R.best(_dense(n, 20), 20), "dense"), _best_lexical(h, n, 20))
    return a.select("query_id", "common", F.round("jaccard", 6).alias("jaccard"), F.round("concordance", 6).alias("concordance"))


def maxsim_phased(s, d):
    """Late interaction of sessions: each asking node's best match in a tier by dot, phase and amplitudes, summed over the session."""
    n = _of(_held(s, d)).where("amplitude is not null and tier is not null and session is not null")
    q = _asked(n).select("query_id", "vector", "phase", "amplitude", "session")
    m = blocks.group_max(n.withColumnRenamed("tier", "group"), q).select("query_id", F.col("group").alias("tier"), F.col("score").alias("m"))
    return m.join(q.select("query_id", "session"), "query_id").groupBy("session", "tier").agg(F.round(F.sum("m"), 5).alias("score"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_UNIT = "list_transform(CAST(v AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))))"
_P = f"""{_N}, nv AS (SELECT node_id, min(vector) AS v FROM node_vectors WHERE node_id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: isfinite(x))) = 64
  AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY node_id),
n AS (SELECT node_id AS id, content, session, tier, coalesce(phase, 0.0) AS ph, amplitude, salience, created_at, causal_parents, {_UNIT} AS v FROM nodes JOIN nv USING (node_id)),
q AS (SELECT id AS query_id, v AS qv, ph AS qph, session AS qs, content AS qc, amplitude AS qa FROM n WHERE id LIKE '%00'),
pr AS (SELECT *, 2 - 2 * list_inner_product(v, qv) AS d2, list_inner_product(v, qv) AS dp FROM n, q),
rs AS (SELECT query_id, id, round(exp(-d2 / 2) * (0.7 + 0.3 * (0.5 + 0.5 * cos(ph - qph))), 6) AS score FROM pr)"""
_BM = f"""tq AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_T('qc')}) AS term FROM q) GROUP BY ALL),
dd AS (SELECT node_id AS id, len(coalesce({_T('content')}, [])) AS n, {_T('content')} AS t FROM nodes), st AS (SELECT count(*) AS docs, avg(n) AS mean FROM dd),
po AS (SELECT id, n, term, count(*) AS tf FROM (SELECT id, n, unnest(t) AS term FROM dd) WHERE term IN (SELECT term FROM tq) GROUP BY ALL), fr AS (SELECT term, count(*) AS df FROM po GROUP BY term),
bm AS (SELECT query_id, id, sum(qtf * ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * greatest(n, 1) / greatest(mean, 1.0)))) AS score
  FROM po JOIN tq USING (term) JOIN fr USING (term), st GROUP BY query_id, id)"""


def _top(src: str, k: int, digits: int = 6) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(score, {digits}) AS score FROM {src})) WHERE rank <= {k})"


_MAX = "score / greatest(max(score) OVER (PARTITION BY query_id), 1e-8)"
_RANGE = "({0} - min({0}) OVER (PARTITION BY query_id)) / (max({0}) OVER (PARTITION BY query_id) - min({0}) OVER (PARTITION BY query_id) + 1e-8::DOUBLE)"
_HY = f"SELECT query_id, id, 0.7::DOUBLE * {_RANGE.format('score')} + 0.3::DOUBLE * {_RANGE.format('b')} AS score FROM (SELECT query_id, id, {{dense}} AS score, coalesce(bm.score, 0.0) AS b FROM {{src}} LEFT JOIN bm USING (query_id, id))"
SQL = {
    "bm25_then_resonance": f"WITH {_P}, {_BM}, c AS {_top('bm', 40)} SELECT * FROM {_top('(SELECT rs.* FROM rs JOIN c USING (query_id, id))', 10)}",
    "fusion_three_way": f"""WITH {_P}, {_BM}, a AS {_top('rs', 30)}, b AS {_top('bm', 30)}, u AS (SELECT query_id, id, 0.4::DOUBLE * {_MAX} AS s FROM a UNION ALL SELECT query_id, id, 0.35::DOUBLE * {_MAX} FROM b),
        z AS (SELECT * FROM u UNION ALL SELECT query_id, id, 0.25::DOUBLE * (0.5 + 0.5 * dp) FROM pr SEMI JOIN u USING (query_id, id)), f AS (SELECT query_id, id, sum(s) AS score FROM z GROUP BY ALL)
        SELECT * FROM {_top('f', 10, 5)}""",
    "facade_blend": f"""WITH {_P}, {_BM}, a AS {_top('rs', 10)}, b AS (SELECT query_id, id, {_MAX} AS b FROM {_top('bm', 20)}),
        m AS (SELECT query_id, id, 0.7::DOUBLE * a.score + 0.3::DOUBLE * coalesce(b, 0) AS score FROM a LEFT JOIN b USING (query_id, id)
          UNION ALL SELECT query_id, id, 0.3::DOUBLE * b FROM b ANTI JOIN a USING (query_id, id) WHERE b > 0.15) SELECT * FROM {_top('m', 10)}""",
    "rocchio_hybrid": f"""WITH {_P}, {_BM}, h1 AS ({_HY.format(dense='dp', src='pr')}), f AS {_top('h1', 3)},
        fb AS (SELECT query_id, dim, avg(x) AS m FROM (SELECT query_id, unnest(v) AS x, unnest(range(64)) AS dim FROM f JOIN n USING (id)) GROUP BY ALL), fl AS (SELECT query_id, list(m ORDER BY dim) AS m FROM fb GROUP BY 1),
        q2 AS (SELECT query_id, list_transform(list_zip(qv, m), lambda z: z[1] + 0.3::DOUBLE * z[2]) AS w FROM q JOIN fl USING (query_id)),
        p2 AS (SELECT query_id, id, list_inner_product(v, w) / (sqrt(list_inner_product(w, w)) + 1e-8) AS dq FROM n, q2), h2 AS ({_HY.format(dense='dq', src='p2')}) SELECT * FROM {_top('h2', 10, 5)}""",
    "confidence_fallback": f"""WITH {_P}, {_BM}, a AS (SELECT * FROM {_top('rs', 5)} WHERE (score < 0.9 OR id NOT LIKE '%5') AND query_id <> id), b AS {_top('(SELECT query_id, id, score / 100 AS score FROM bm)', 5)},
        t AS (SELECT query_id, CASE WHEN coalesce(x.m, 0) >= 0.3 THEN 'confident' WHEN coalesce(y.m, 0) >= 0.1 THEN 'fallback' ELSE 'unknown' END AS verdict
          FROM (SELECT query_id, max(score) AS m FROM a GROUP BY 1) x FULL JOIN (SELECT query_id, max(score) AS m FROM b GROUP BY 1) y USING (query_id))
        SELECT query_id, id, round(score, 6) AS score, verdict FROM a JOIN t USING (query_id) WHERE verdict = 'confident' UNION ALL SELECT query_id, id, round(score * 0.5, 6), verdict FROM b JOIN t USING (query_id) WHERE verdict = 'fallback'
        UNION ALL SELECT query_id, NULL, 0.0, verdict FROM t WHERE verdict = 'unknown'""",
    "fallback_bm25": f"""WITH {_P}, {_BM}, a AS (SELECT * FROM {_top('rs', 10)} WHERE score >= 0.9 AND query_id <> id), u AS (SELECT query_id, id, score FROM a
        UNION ALL SELECT query_id, id, score * 0.1 FROM {_top('bm', 5)} b WHERE query_id NOT IN (SELECT query_id FROM a)) SELECT * FROM {_top('u', 10)}""",
    "tier_fallback": f"""WITH {_P} SELECT query_id, id, score, tier, rank FROM (SELECT query_id, id, score, tier, row_number() OVER (PARTITION BY query_id
        ORDER BY CASE tier WHEN 'semantic' THEN 0 WHEN 'procedural' THEN 1 WHEN 'episodic' THEN 2 ELSE 3 END, score DESC, id) AS rank FROM rs JOIN n USING (id) WHERE score >= 0.75) WHERE rank <= 10""",
    "session_scan": f"""WITH {_P}, c AS (SELECT session, count(*) AS c FROM n GROUP BY 1), qq AS (SELECT query_id, qs, coalesce(c, 0) > 0 AND coalesce(c, 0) < 0.3::DOUBLE * (SELECT count(*) FROM n) AS small FROM q LEFT JOIN c ON session = qs),
        x AS (SELECT rs.query_id, rs.id, rs.score FROM rs JOIN qq USING (query_id) JOIN n USING (id) WHERE NOT small OR session = qs) SELECT * FROM {_top('x', 10)}""",
    "keep_max_dedup": f"""WITH {_P}, a AS {_top('(SELECT query_id, id, 0.5 + 0.5 * dp AS score FROM pr)', 8)}, b AS {_top('(SELECT query_id, id, exp(-sqrt(greatest(d2, 0))) AS score FROM pr)', 8)}
        SELECT query_id, id, max(score) AS score FROM (SELECT query_id, id, score FROM a UNION ALL SELECT query_id, id, score FROM b) GROUP BY ALL""",
    "attention_reweight": f"""WITH {_P}, w AS (SELECT query_id, id, exp(score * (1 + 0.2::DOUBLE * least(1.0, coalesce(len(causal_parents), 0) / 10.0)) * greatest(0.5, 1 - (1 - coalesce(salience, 1.0))) * CASE WHEN tier = 'procedural' THEN 1.15::DOUBLE ELSE 1 END) AS e
        FROM {_top('rs', 10)} JOIN n USING (id)) SELECT query_id, id, round(e / (sum(e) OVER (PARTITION BY query_id) + 1e-8), 6) AS weight FROM w""",
    "kalman_weight": f"WITH {_P}, w AS (SELECT query_id, id, score / (1 + 64 * (1 - coalesce(salience, 1.0)) / 100) AS score FROM {_top('rs', 20)} JOIN n USING (id)) SELECT * FROM {_top('w', 10)}",
    "causal_boost": f"""WITH {_P}, w AS (SELECT query_id, id, exp(-d2 / 2) * (0.7 + 0.3 * (0.5 + 0.5 * cos(ph - qph))) * (1 + 0.05::DOUBLE * coalesce(len(causal_parents), 0)) * (1 + 0.2::DOUBLE * cos(qph - ph)) AS score
        FROM pr SEMI JOIN {_top('rs', 20)} c USING (query_id, id)) SELECT * FROM {_top('w', 10)}""",
    "engram_search": f"""WITH {_P}, w AS (SELECT query_id, id, (0.5 + 0.5 * dp) * coalesce(salience, 1.0) * coalesce(greatest(0.5, exp(-trunc(epoch((SELECT max(created_at) FROM n) - created_at)) / 3600.0 / 24)), 0.5) AS score
        FROM pr SEMI JOIN {_top('rs', 30)} c USING (query_id, id)) SELECT * FROM {_top('w', 10)}""",
    "ranking_jaccard": f"""WITH {_P}, {_BM}, a AS {_top('rs', 20)}, b AS {_top('bm', 20)}, o AS (SELECT query_id, id, a.rank AS ra, b.rank AS rb FROM a FULL JOIN b USING (query_id, id)),
        c AS (SELECT x.query_id, avg(CAST(x.rb < y.rb AS DOUBLE)) AS con FROM o x JOIN o y ON x.query_id = y.query_id AND x.ra < y.ra WHERE x.rb IS NOT NULL AND y.rb IS NOT NULL GROUP BY 1)
        SELECT z.query_id, common, round(common / alls, 6) AS jaccard, round(con, 6) AS concordance FROM (SELECT query_id, count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) AS common, count(*) AS alls FROM o GROUP BY 1) z LEFT JOIN c USING (query_id)""",
    "maxsim_phased": f"""WITH {_P}, m AS (SELECT query_id, qs, tier, max(dp * cos(ph - qph) * amplitude * qa) AS m FROM pr WHERE amplitude IS NOT NULL AND qa IS NOT NULL AND tier IS NOT NULL AND session IS NOT NULL AND qs IS NOT NULL
        AND query_id IN (SELECT id FROM n WHERE tier IS NOT NULL) GROUP BY ALL) SELECT qs AS session, tier, round(sum(m), 5) AS score FROM m GROUP BY ALL""",
}
