"""Causal and similarity graphs of the memory nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemora import workspace
from mnemora.operators import graph as G
from mnemora.operators.lexical import small
from mnemora.queries.analytics import _N, nodes
from mnemora.sources.tables import table

def _seed():
    return F.col("node_id").endswith("00")


def _edges(s, d):
    return G.edges_of(nodes(s, d))


def causal_edges(s, d):
    return _edges(s, d)


def out_degree(s, d):
    return G.degrees(_edges(s, d))


def causal_bfs3(s, d):
    seeds = nodes(s, d).where(_seed()).select(F.col("node_id").alias("node"), F.lit(1.0).alias("score"))
    return G.spread_activation(_edges(s, d), seeds, hops=3).select("node", F.round("score", 6).alias("score"), "depth")


def descendants(s, d):
    seeds = nodes(s, d).where(_seed()).select(F.col("node_id").alias("node"))
    return G.reachable(_edges(s, d), seeds)


def graph_components(s, d):
    return G.components(_edges(s, d))


def betti_numbers(s, d):
    """Components and independent cycles of the graph: b1 = edges - nodes + b0."""
    e = _edges(s, d)
    undirected = e.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct().agg(F.count("*").alias("e"))
    c = G.components(e).agg(F.count("*").alias("v"), F.countDistinct("component").alias("b0"))
    return c.crossJoin(undirected).select("b0", (F.col("e") - F.col("v") + F.col("b0")).alias("b1"))


def v_structures(s, d):
    return G.colliders(_edges(s, d))


def common_children(s, d):
    e = _edges(s, d)
    p = e.alias("x").join(e.alias("y"), (F.col("x.target") == F.col("y.target")) & (F.col("x.source") < F.col("y.source")))
    return p.groupBy(F.col("x.source").alias("a"), F.col("y.source").alias("b")).agg(F.count("*").alias("n")).where("n >= 2")


def causal_integrity(s, d):
    """Parents that are no node, and edges of a node to itself."""
    n = nodes(s, d).select("node_id", F.explode("causal_parents").alias("p"))
    loop = n.where("node_id = p").select("node_id", "p", F.lit("loop").alias("fault"))
    gone = n.join(nodes(s, d).select(F.col("node_id").alias("p")), "p", "left_anti").select("node_id", "p", F.lit("missing").alias("fault"))
    return loop.unionByName(gone)


def chi2_skeleton(s, d):
    """Event types that a user has on the same day more or less often than by chance."""
    day = table(s, d, "events").select("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("item")).distinct()
    singles = day.groupBy("item").agg(F.count("*").alias("n"))
    x, y = day.alias("x"), day.alias("y")
    # a user has at most as many rows a day as there are types
    pairs = x.join(y, (F.col("x.user_id") == F.col("y.user_id")) & (F.col("x.day") == F.col("y.day")) & (F.col("x.item") < F.col("y.item")))
    pairs = pairs.groupBy(F.col("x.item").alias("a"), F.col("y.item").alias("b")).agg(F.count("*").alias("n"))
    total = day.select("user_id", "day").distinct().count()
    return G.independence(pairs, singles, total).select("a", "b", F.round("chi2", 4).alias("chi2"))


def basket_overlap(s, d):
    """Orders whose part sets agree in at least .7, as for groups of nodes active together."""
    l = table(s, d, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_partkey").alias("item"))  # noqa: E741
    return G.overlap_pairs(l).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def trust_consensus(s, d):
    """Ratings of a document weighted by the raters' squared agreement with the majority."""
    r = table(s, d, "doc_labels").where("quality is not null").select("doc_id", "rater", "quality")
    mean = r.groupBy("doc_id").agg(F.avg("quality").alias("m"))
    rep = workspace.materialise(r.join(mean, "doc_id").groupBy("rater").agg((1 / (1 + F.avg(F.abs(F.col("quality") - F.col("m"))))).alias("rep")), "raters")
    w = F.col("rep") * F.col("rep")
    return r.join(small(rep), "rater").groupBy("doc_id").agg(F.round(F.sum(w * F.col("quality")) / F.sum(w), 6).alias("consensus"))


def forward_chaining(s, d):
    """Event types as facts by their share, and what three rules derive from them."""
    e = table(s, d, "events").groupBy(F.col("event_type").alias("item")).agg(F.least(F.lit(1.0), 0.6 + F.count("*") / F.lit(1e4)).alias("conf"))
    rules = s.createDataFrame([(1, "interest", ["view", "click"], 0.95), (2, "customer", ["interest", "purchase"], 0.97), (3, "loyal", ["customer", "nothing"], 1.0)], "rule int, head string, body array<string>, weight double")
    return G.forward_chain(e, rules).select("item", F.round("conf", 6).alias("conf"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_E = f"{_N}, ee AS (SELECT DISTINCT source, target FROM (SELECT unnest(causal_parents) AS source, node_id AS target FROM nodes) WHERE source IS NOT NULL AND source <> target), uu AS (SELECT source, target FROM ee UNION SELECT target, source FROM ee)"
_R = "WITH RECURSIVE"
_COMP = f"{_E}, vv AS (SELECT DISTINCT source AS node FROM uu), cc(node, r) AS (SELECT node, node FROM vv UNION SELECT u.target, cc.r FROM cc JOIN uu u ON u.source = cc.node), co AS (SELECT node, min(r) AS component FROM cc GROUP BY node)"
SQL = {
    "causal_edges": f"WITH {_E} SELECT * FROM ee",
    "out_degree": f"WITH {_E} SELECT node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT source AS node, 0 AS i, 1 AS o FROM ee UNION ALL SELECT target, 1, 0 FROM ee) GROUP BY node",
    "causal_bfs3": f"""WITH {_E}, l0 AS (SELECT node_id AS node, 1.0::DOUBLE AS score, 0 AS depth FROM nodes WHERE node_id LIKE '%00'),
        l1 AS (SELECT target AS node, max(score * 0.25) AS score, 1 AS depth FROM l0 JOIN uu ON source = node WHERE target NOT IN (SELECT node FROM l0) AND score * 0.25 > 0.01 GROUP BY target),
        l2 AS (SELECT target AS node, max(score * 0.125) AS score, 2 AS depth FROM l1 JOIN uu ON source = node WHERE target NOT IN (SELECT node FROM l0 UNION SELECT node FROM l1) AND score * 0.125 > 0.01 GROUP BY target),
        l3 AS (SELECT target AS node, max(score * 0.0625) AS score, 3 AS depth FROM l2 JOIN uu ON source = node WHERE target NOT IN (SELECT node FROM l0 UNION SELECT node FROM l1 UNION SELECT node FROM l2) AND score * 0.0625 > 0.01 GROUP BY target)
        SELECT node, round(score, 6) AS score, depth FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)""",
    "descendants": f"{_R} {_E}, rr(root, node, depth) AS (SELECT node_id, node_id, 0 FROM nodes WHERE node_id LIKE '%00' UNION SELECT root, target, depth + 1 FROM rr JOIN ee ON source = node WHERE depth < 50) SELECT root, node, min(depth) AS depth FROM rr WHERE depth > 0 AND node <> root GROUP BY root, node",
    "graph_components": f"{_R} {_COMP} SELECT * FROM co",
    "betti_numbers": f"{_R} {_COMP} SELECT (SELECT count(DISTINCT component) FROM co) AS b0, (SELECT count(*) FROM uu) // 2 - (SELECT count(*) FROM co) + (SELECT count(DISTINCT component) FROM co) AS b1",
    "v_structures": f"WITH {_E} SELECT x.source AS a, y.source AS b, x.target FROM ee x JOIN ee y ON x.target = y.target AND x.source < y.source WHERE NOT EXISTS (SELECT 1 FROM uu WHERE uu.source = x.source AND uu.target = y.source)",
    "common_children": f"WITH {_E} SELECT x.source AS a, y.source AS b, count(*) AS n FROM ee x JOIN ee y ON x.target = y.target AND x.source < y.source GROUP BY ALL HAVING count(*) >= 2",
    "causal_integrity": f"""WITH {_N}, p AS (SELECT node_id, unnest(causal_parents) AS p FROM nodes) SELECT node_id, p, 'loop' AS fault FROM p WHERE p = node_id
        UNION ALL SELECT node_id, p, 'missing' FROM p WHERE p IS NULL OR p NOT IN (SELECT node_id FROM nodes)""",
    "chi2_skeleton": """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type AS item FROM events), s AS (SELECT item, count(*) AS n FROM d GROUP BY item), t AS (SELECT count(*) AS t FROM (SELECT DISTINCT user_id, day FROM d)),
        p AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM d x JOIN d y ON x.user_id = y.user_id AND x.day = y.day AND x.item < y.item GROUP BY ALL),
        c AS (SELECT p.*, sa.n AS na, sb.n AS nb, sa.n * sb.n / t AS e FROM p JOIN s sa ON sa.item = a JOIN s sb ON sb.item = b, t)
        SELECT a, b, round(pow(n - e, 2) / e, 4) AS chi2 FROM c WHERE n >= 2 AND na >= 3 AND nb >= 3 AND e >= 5 AND pow(n - e, 2) / e >= 3.84""",
    "basket_overlap": """WITH m AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS i FROM lineitem), z AS (SELECT g, count(*) AS n FROM m GROUP BY g),
        p AS (SELECT x.g AS a, y.g AS b, count(*) AS c FROM m x JOIN m y ON x.i = y.i AND x.g < y.g GROUP BY ALL)
        SELECT a, b, round(c / (za.n + zb.n - c), 6) AS jaccard FROM p JOIN z za ON za.g = a JOIN z zb ON zb.g = b WHERE c / (za.n + zb.n - c) >= 0.7 - 1e-9""",
    "trust_consensus": """WITH r AS (SELECT doc_id, rater, quality FROM doc_labels WHERE quality IS NOT NULL), m AS (SELECT doc_id, avg(quality) AS m FROM r GROUP BY doc_id),
        p AS (SELECT rater, 1 / (1 + avg(abs(quality - m))) AS rep FROM r JOIN m USING (doc_id) GROUP BY rater) SELECT doc_id, round(sum(rep * rep * quality) / sum(rep * rep), 6) AS consensus FROM r JOIN p USING (rater) GROUP BY doc_id""",
    "forward_chaining": """WITH f AS (SELECT event_type AS item, least(1.0, 0.6::DOUBLE + count(*) / 1e4) AS conf FROM events GROUP BY 1), k AS (SELECT * FROM f WHERE conf >= 0.65),
        i AS (SELECT 'interest' AS item, 0.95::DOUBLE * min(conf) AS conf FROM k WHERE item IN ('view', 'click') HAVING count(*) = 2 AND 0.95::DOUBLE * min(conf) >= 0.65),
        c AS (SELECT 'customer' AS item, 0.97::DOUBLE * min(conf) AS conf FROM (SELECT * FROM k UNION ALL SELECT * FROM i) WHERE item IN ('interest', 'purchase') HAVING count(*) = 2 AND 0.97::DOUBLE * min(conf) >= 0.65)
        SELECT item, round(conf, 6) AS conf FROM (SELECT * FROM k UNION ALL SELECT * FROM i UNION ALL SELECT * FROM c)""",
}
