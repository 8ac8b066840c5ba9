"""Causal questions, rules, engrams and trust over the memory graph and the events; nodes whose id ends in 0 ask where a query set is needed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemora.operators import field as D
from mnemora.operators import graph as G
from mnemora.operators import retrieval as R
from mnemora.operators import scoring
from mnemora.queries.analytics import nodes
from mnemora.queries.fields import _EN
from mnemora.queries.graphs import _E, _R
from mnemora.queries.retrieval import _P, _dense, _placed, _top
from mnemora.queries.similarity import _asked, _nodes
from mnemora.sources.tables import table


def _edges(s, d):
    return G.edges_of(nodes(s, d))


def _seeds(s, d):
    return nodes(s, d).where(F.col("node_id").endswith("0")).select(F.col("node_id").alias("node"))


def ancestors(s, d):
    """Everything that leads to an asking node, with its least distance."""
    return G.reachable(G.reversed_(_edges(s, d)), _seeds(s, d))


def adjustment_sets(s, d):
    return G.adjustment_sets(_edges(s, d), _seeds(s, d))


def front_doors(s, d):
    return G.front_doors(_edges(s, d), _seeds(s, d))


def _observations(s, d):
    """Event types met by a user within an hour: (item, n), (a, b, n) both ways, and the number of user hours."""
    o = table(s, d, "events").select("user_id", F.date_trunc("hour", "ts").alias("h"), F.col("event_type").alias("item")).distinct()
    singles = o.groupBy("item").agg(F.count("*").alias("n"))
    x, y = o.alias("x"), o.alias("y")
    # a user has at most as many rows an hour as there are types
    both = x.join(y, (F.col("x.user_id") == F.col("y.user_id")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.item") != F.col("y.item")))
    joint = both.groupBy(F.col("x.item").alias("a"), F.col("y.item").alias("b")).agg(F.count("*").alias("n"))
    return singles, joint, o.select("user_id", "h").distinct().count()


def _strengths(s):
    rows = [("view", "purchase", 0.4), ("click", "purchase", 0.6), ("signup", "purchase", 0.05), ("view", "signup", 0.3), ("error", "signup", 0.2)]
    return s.createDataFrame(rows, "cause string, effect string, strength double")


def _types(s, d):
    return table(s, d, "events").select(F.col("event_type").alias("node")).distinct()


def do_probability(s, d):
    """Of every pair of event types: what setting the one does to the other."""
    singles, joint, _ = _observations(s, d)
    t = _types(s, d)
    pairs = t.select(F.col("node").alias("cause")).join(F.broadcast(t.select(F.col("node").alias("effect"))), F.col("cause") != F.col("effect"))  # five types
    return G.do_probability(pairs, _strengths(s), singles, joint).select("cause", "effect", F.round("p", 6).alias("p"))


def counterfactual(s, d):
    """Of every event type: the better of two interventions."""
    set_ = s.createDataFrame([("view",), ("error",)], "node string")
    return G.counterfactual(do_probability(s, d), _types(s, d), set_)


def contradictions(s, d):
    """Causes of one effect that users have in the same hour less often than by chance."""
    singles, joint, total = _observations(s, d)
    return G.contradictions(_strengths(s), singles, joint, total).withColumn("ratio", F.round("ratio", 6))


def _strength_of(e):
    return e.select(F.col("source").alias("cause"), F.col("target").alias("effect"), (F.pmod(F.length("source") + F.substring("target", -2, 2).cast("int"), F.lit(10)) / 10.0).alias("strength"))


def unsafe_merges(s, d):
    """Linked nodes and fellow causes as candidates of merges: what speaks against each."""
    e = _edges(s, d)
    linked = e.where(F.col("source").endswith("0")).select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    fellows = G.colliders(e).where(F.col("target").endswith("0")).select("a", "b")
    pairs = linked.unionByName(fellows).distinct()
    opposed = fellows.where(F.col("a").endswith("5"))
    return G.unsafe_merges(pairs, e, _strength_of(e), opposed)


def causal_augmented(s, d):
    """Dense results raised by three tenths of what the three best carry along two hops of causes and effects."""
    n = _placed(s, d)
    first = R.best(_dense(n, 10), 10)
    seeds = first.where("rank <= 3").select("query_id", F.col("id").alias("node"), "score")
    bonus = G.carried_bonus(_edges(s, d), seeds).join(nodes(s, d).select(F.col("node_id").alias("node")), "node")
    both = first.select("query_id", "id", "score").join(bonus.withColumnRenamed("node", "id"), ["query_id", "id"], "full_outer")
    return R.best(both.select("query_id", "id", (F.coalesce("score", F.lit(0.0)) + 0.3 * F.coalesce("bonus", F.lit(0.0))).alias("score")), 10)


def rule_conflicts(s, d):
    """Rules of labels: head by the type, body by the hour of an event, weight by the user; those that conflict."""
    e = table(s, d, "events").where("event_id % 40 = 0")  # the rules of this rule base, one of forty events each
    r = e.select(F.col("event_id").alias("rule"), F.col("event_type").alias("head"), F.array(F.concat(F.lit("hour "), F.hour("ts")), F.concat(F.lit("user "), F.col("user_id") % 7)).alias("body"), (F.col("value") % 1).alias("weight"))
    return G.conflicts(r)


def rule_extraction(s, d):
    """Nodes firm enough to be rules, at most two hundred, which is the feature: semantic or procedural, confident, salient; weight of the three."""
    n = nodes(s, d).where("tier in ('semantic', 'procedural') and confidence >= 0.5 and salience is not null")
    w = 0.5 * F.col("confidence") + 0.3 * F.col("salience") + 0.2 * F.least(F.lit(1.0), F.size(F.coalesce("causal_parents", F.array().cast("array<string>"))) / 5.0)
    return n.select("node_id", F.round(w, 6).alias("weight")).orderBy(F.desc("weight"), "node_id").limit(200)


def _engrams(s, d):
    n = _nodes(s, d)
    return n, D.engrams(scoring.topk(n.select("id", "vector"), _asked(n), 20, kernel="cosine01"))


def engram_expand(s, d):
    """Nodes of all engrams by the strongest engram they are in: its mean weight times theirs and their salience, twenty best."""
    n, e = _engrams(s, d)
    score = e.groupBy("engram").agg(F.avg("weight").alias("strength"))
    first = Window.partitionBy("id").orderBy(F.desc("strength"), "engram")
    x = e.join(score, "engram").withColumn("strength", F.round("strength", 6)).withColumn("place", F.row_number().over(first)).where("place = 1").join(n.select("id", "salience"), "id")
    x = x.select("id", "engram", F.round(F.col("strength") * F.col("weight") * F.col("salience"), 6).alias("score"))
    return x.orderBy(F.desc("score"), "id").limit(20)


def engram_complete(s, d):
    """Engrams of which a query of every third node holds at least a third: their members and the share met."""
    _, e = _engrams(s, d)
    met = F.avg((F.col("id") % 3 == 0).cast("double"))
    share = e.groupBy("engram").agg(met.alias("share")).where("share >= 0.33")
    return e.join(share, "engram").select("engram", "id", F.round("share", 6).alias("share"))


def engram_merge(s, d):
    """Members of engrams that agree in seven tenths or more, under the lesser engram, each by its greatest weight."""
    _, e = _engrams(s, d)
    pairs = G.overlap_pairs(e.select(F.col("engram").alias("group"), F.col("id").alias("item")), least=0.3).select("a", "b")
    into = pairs.groupBy(F.col("b").alias("engram")).agg(F.min("a").alias("into"))
    m = e.join(into, "engram", "left").select(F.coalesce("into", "engram").alias("engram"), "id", "weight")
    return m.groupBy("engram", "id").agg(F.max("weight").alias("weight"))


def byzantine_filter(s, d):
    """Raters whose ratings lie on average more than one from the other raters' mean of the document."""
    r = table(s, d, "doc_labels").where("quality is not null and rater is not null").select("doc_id", "rater", "quality").distinct()
    by_doc = r.groupBy("doc_id").agg(F.sum("quality").alias("s"), F.count("*").alias("n"))
    off = r.join(by_doc, "doc_id").where("n > 1").groupBy("rater").agg(F.count("*").alias("ratings"), F.avg(F.abs(F.col("quality") - (F.col("s") - F.col("quality")) / (F.col("n") - 1))).alias("off"))
    return off.select("rater", "ratings", F.round("off", 6).alias("off"), (F.col("off") > 1).alias("faulty"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_OBS = """o AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS h, event_type AS item FROM events), s1 AS (SELECT item, count(*) AS n FROM o GROUP BY item),
jj AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM o x JOIN o y ON x.user_id = y.user_id AND x.h = y.h AND x.item <> y.item GROUP BY ALL), tt AS (SELECT count(*) AS t FROM (SELECT DISTINCT user_id, h FROM o)),
st(cause, effect, strength) AS (VALUES ('view', 'purchase', 0.4::DOUBLE), ('click', 'purchase', 0.6), ('signup', 'purchase', 0.05), ('view', 'signup', 0.3), ('error', 'signup', 0.2)),
ty AS (SELECT DISTINCT event_type AS node FROM events),
dp AS (SELECT x.node AS cause, y.node AS effect, round(coalesce(strength, CASE WHEN coalesce(s1.n, 0) < 3 THEN 0.5 ELSE least(1.0, coalesce(jj.n, 0) / s1.n) END), 6) AS p FROM ty x JOIN ty y ON x.node <> y.node
  LEFT JOIN st ON st.cause = x.node AND st.effect = y.node LEFT JOIN s1 ON s1.item = x.node LEFT JOIN jj ON jj.a = x.node AND jj.b = y.node)"""
_UP = f"{_E}, rr(root, node, depth) AS (SELECT node_id, node_id, 0 FROM nodes WHERE node_id LIKE '%0' UNION SELECT root, {{near}}, depth + 1 FROM rr JOIN ee ON {{far}} = node WHERE depth < 60)"
_MERGE = f"""{_E}, fe AS (SELECT x.source AS a, y.source AS b FROM ee x JOIN ee y ON x.target = y.target AND x.source < y.source WHERE x.target LIKE '%0' AND NOT EXISTS (SELECT 1 FROM uu WHERE uu.source = x.source AND uu.target = y.source)),
pp AS (SELECT least(source, target) AS a, greatest(source, target) AS b FROM ee WHERE source LIKE '%0' UNION SELECT a, b FROM fe), sg AS (SELECT source, target, ((length(source) + CAST(right(target, 2) AS INT)) % 10) / 10.0 AS s FROM ee),
rr(root, node) AS (SELECT source, target FROM ee UNION SELECT rr.root, ee.target FROM rr JOIN ee ON ee.source = rr.node)"""
SQL = {
    "ancestors": f"{_R} {_UP.format(near='ee.source', far='ee.target')} SELECT root, node, min(depth) AS depth FROM rr WHERE node <> root GROUP BY root, node",
    "adjustment_sets": f"{_R} {_UP.format(near='ee.target', far='ee.source')} SELECT DISTINCT target AS node, source AS parent FROM ee WHERE target LIKE '%0' AND NOT EXISTS (SELECT 1 FROM rr WHERE rr.root = ee.target AND rr.node = ee.source AND depth > 0)",
    "front_doors": f"WITH {_E} SELECT x.source AS cause, y.target AS effect, count(*) AS mediators FROM ee x JOIN ee y ON x.target = y.source WHERE x.source LIKE '%0' AND x.source <> y.target GROUP BY ALL",
    "do_probability": f"WITH {_OBS} SELECT * FROM dp",
    "counterfactual": f"""WITH {_OBS}, i AS (SELECT effect, arg_min(cause, (-p, cause)) AS c, max(p) AS p FROM dp WHERE cause IN ('view', 'error') AND p > 0 GROUP BY effect)
        SELECT node AS target, CASE WHEN node IN ('view', 'error') THEN node ELSE c END AS by, CASE WHEN node IN ('view', 'error') THEN 1.0 ELSE coalesce(p, 0.5) END AS p FROM ty LEFT JOIN i ON i.effect = node""",
    "contradictions": f"""WITH {_OBS}, z AS (SELECT x.cause AS a, y.cause AS b, x.effect, coalesce(jj.n, 0) / (sa.n * sb.n / t) AS ratio FROM st x JOIN st y ON x.effect = y.effect AND x.cause < y.cause JOIN s1 sa ON sa.item = x.cause
        JOIN s1 sb ON sb.item = y.cause LEFT JOIN jj ON jj.a = x.cause AND jj.b = y.cause, tt WHERE x.strength > 0.1 AND y.strength > 0.1) SELECT a, b, effect, round(ratio, 6) AS ratio FROM z WHERE ratio < 0.7""",
    "unsafe_merges": f"""{_R} {_MERGE} SELECT a, b, 'causal relationship' AS reason FROM pp WHERE EXISTS (SELECT 1 FROM uu WHERE source = a AND target = b)
        UNION ALL SELECT a, b, 'causal path' FROM pp WHERE EXISTS (SELECT 1 FROM rr WHERE (root = a AND node = b) OR (root = b AND node = a))
        UNION ALL SELECT DISTINCT a, b, 'opposing effects' FROM pp JOIN sg x ON x.source = a JOIN sg y ON y.source = b AND y.target = x.target WHERE abs(x.s - y.s) > 0.4
        UNION ALL SELECT a, b, 'contradiction' FROM (SELECT DISTINCT a, b FROM fe WHERE a LIKE '%5')""",
    "causal_augmented": f"""WITH {_P}, ee AS (SELECT DISTINCT source, target FROM (SELECT unnest(causal_parents) AS source, node_id AS target FROM nodes) WHERE source IS NOT NULL AND source <> target), uu AS (SELECT source, target FROM ee UNION SELECT target, source FROM ee),
        f AS {_top('rs', 10)}, l1 AS (SELECT query_id, target AS node, sum(score) * 0.5 AS s FROM f JOIN uu ON source = id WHERE rank <= 3 GROUP BY ALL), l2 AS (SELECT query_id, target AS node, sum(s) * 0.25 AS s FROM l1 JOIN uu ON source = node GROUP BY ALL),
        b AS (SELECT query_id, node AS id, sum(s) AS bonus FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) JOIN nodes ON node_id = node GROUP BY ALL),
        z AS (SELECT query_id, id, coalesce(score, 0) + 0.3::DOUBLE * coalesce(bonus, 0) AS score FROM f FULL JOIN b USING (query_id, id)) SELECT * FROM {_top('z', 10)}""",
    "rule_conflicts": """WITH r AS (SELECT event_id AS rule, event_type AS head, list_sort(['hour ' || hour(ts), 'user ' || (user_id % 7)]) AS body, value % 1 AS weight FROM events WHERE event_id % 40 = 0)
        SELECT x.rule AS a, y.rule AS b FROM r x JOIN r y ON x.head = y.head AND x.body = y.body AND x.rule < y.rule WHERE abs(x.weight - y.weight) > 0.3""",
    "rule_extraction": f"""WITH {_E} SELECT node_id, round(0.5::DOUBLE * confidence + 0.3::DOUBLE * salience + 0.2::DOUBLE * least(1.0, coalesce(len(causal_parents), 0) / 5.0), 6) AS weight FROM nodes
        WHERE tier IN ('semantic', 'procedural') AND confidence >= 0.5 AND salience IS NOT NULL ORDER BY weight DESC, node_id LIMIT 200""",
    "engram_expand": f"""WITH {_EN}, g AS (SELECT engram, round(avg(weight), 6) AS strength FROM en GROUP BY engram), x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY strength DESC, engram) AS place FROM en JOIN g USING (engram))
        SELECT id, engram, round(strength * weight * salience, 6) AS score FROM x JOIN n USING (id) WHERE place = 1 ORDER BY score DESC, id LIMIT 20""",
    "engram_complete": f"WITH {_EN}, g AS (SELECT engram, avg(CAST(id % 3 = 0 AS DOUBLE)) AS share FROM en GROUP BY engram) SELECT engram, id, round(share, 6) AS share FROM en JOIN g USING (engram) WHERE share >= 0.33",
    "engram_merge": f"""WITH {_EN}, z AS (SELECT x.engram AS a, y.engram AS b, count(*) AS c FROM en x JOIN en y ON x.id = y.id AND x.engram < y.engram GROUP BY ALL), m AS (SELECT b AS engram, min(a) AS into_ FROM z WHERE c / (40.0 - c) >= 0.3 - 1e-9 GROUP BY b)
        SELECT coalesce(into_, engram) AS engram, id, max(weight) AS weight FROM en LEFT JOIN m USING (engram) GROUP BY ALL""",
    "byzantine_filter": """WITH r AS (SELECT DISTINCT doc_id, rater, quality FROM doc_labels WHERE quality IS NOT NULL AND rater IS NOT NULL), b AS (SELECT doc_id, sum(quality) AS s, count(*) AS n FROM r GROUP BY doc_id)
        SELECT rater, count(*) AS ratings, round(avg(abs(quality - (s - quality) / (n - 1))), 6) AS off, avg(abs(quality - (s - quality) / (n - 1))) > 1 AS faulty FROM r JOIN b USING (doc_id) WHERE n > 1 GROUP BY rater""",
}
