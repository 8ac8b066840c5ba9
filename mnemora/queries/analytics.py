"""Event and node analytics, and changes of the node table, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora.functions import vectors as V
from mnemora.functions.times import micros
from mnemora.operators import analytics as A
from mnemora.operators import mutations as M
from mnemora.sources.tables import table


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """memory_nodes, one row a node: of repeated rows the one of greatest salience."""
    n = table(spark, d, "memory_nodes").where("node_id is not null")
    w = Window.partitionBy("node_id").orderBy(F.desc_nulls_last("salience"), "phase", "amplitude")
    return n.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def _events(spark, d):
    return table(spark, d, "events")


def _now(spark, d):
    return F.lit(table(spark, d, "memory_nodes").agg(F.max(micros("created_at"))).first()[0])


def event_counts(s, d):
    return _events(s, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def events_hourly(s, d):
    return _events(s, d).groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour"), "event_type").agg(F.count("*").alias("n"))


def events_query(s, d):
    """Events of a type since a time, newest first, with their parsed properties."""
    e = _events(s, d).where((F.col("event_type") == "click") & (F.col("ts") >= F.lit("2024-01-15").cast("timestamp")))
    return e.select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def sessions_distinct(s, d):
    return _events(s, d).groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


def sessions_gap30(s, d):
    """Sessions of the events table by the same operator as problem 5."""
    from mnemora.operators import sessions as S

    e = _events(s, d).select(F.col("event_id").cast("string").alias("id"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', ts)").alias("event_ms"), F.col("user_id").cast("string").alias("actor"))
    m = S.merge(S.pieces(e))
    return m.select("actor", "start_ms", "end_ms", "events")


def conversions_once(s, d):
    e = _events(s, d).where("event_type = 'purchase'").select("user_id", F.to_date("ts").cast("string").alias("day"), "ts", "event_id")
    return A.once_per(e, ["user_id", "day"], ["ts", "event_id"]).select("user_id", "day", "event_id")


def funnel(s, d):
    """Users by the furthest step reached in order: view, click, purchase."""
    first = lambda k: F.min(F.when(F.col("event_type") == k, F.col("ts")))
    u = _events(s, d).groupBy("user_id").agg(first("view").alias("a"), first("click").alias("b"), first("purchase").alias("c"))
    step = F.when(F.col("a").isNull(), 0).when(F.col("b").isNull() | (F.col("b") < F.col("a")), 1).when(F.col("c").isNull() | (F.col("c") < F.col("b")), 2).otherwise(3)
    return u.groupBy(step.alias("step")).agg(F.count("*").alias("users"))


def latency_percentiles(s, d):
    return A.percentiles(_events(s, d), ["event_type"], "value")


def p95_nearest_index(s, d):
    return A.nearest_p95(_events(s, d), "event_type", "value")


def cost_summary(s, d):
    rates = F.create_map(*(F.lit(x) for kv in {"view": 0.5, "click": 0.02, "purchase": 0.3}.items() for x in kv))
    cost = F.coalesce(F.try_element_at(rates, F.col("event_type")), F.lit(0.01)) * (1 + F.col("value") / 1000.0)
    return _events(s, d).groupBy("event_type").agg(F.round(F.sum(cost), 4).alias("total"), F.round(F.avg(cost), 6).alias("mean"))


def rate_counts(s, d):
    """Greatest number of events a user had within a minute, an hour and a day."""
    e = _events(s, d).select("user_id", "ts")
    for name, sec in (("minute", 60), ("hour", 3600), ("day", 86400)):
        e = A.trailing_counts(e, "user_id", "ts", sec).withColumnRenamed("n", name)
    return e.groupBy("user_id").agg(*(F.max(k).alias(k) for k in ("minute", "hour", "day")))


def rate_limited(s, d):
    return A.trailing_counts(_events(s, d), "user_id", "ts", 3600).where("n > 2").select("event_id", "n")


def ab_results(s, d):
    return _events(s, d).groupBy(A.variant(F.col("user_id").cast("string"), 3).alias("variant"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def variant_assign(s, d):
    return _events(s, d).select("user_id").distinct().select("user_id", A.variant(F.col("user_id").cast("string"), 7).alias("variant"))


def entropy_norm(s, d):
    return A.normalised_entropy(_events(s, d), "user_id", "event_type")


def tension_spikes(s, d):
    return A.spikes(_events(s, d), "event_type", ["ts", "event_id"], "value", threshold=2.0).select("event_id", F.round("z", 5).alias("z"))


def adaptive_threshold(s, d):
    t = A.trailing_mean_threshold(_events(s, d), "event_type", ["ts", "event_id"], "value")
    return t.where("threshold is not null").select("event_id", F.round("threshold", 5).alias("threshold"))


def forgetting_bins(s, d):
    return A.salience_bins(nodes(s, d))


def tier_distribution(s, d):
    return A.distribution(nodes(s, d), "tier")


def domain_stats(s, d):
    return A.distribution(nodes(s, d), "domain")


def node_lifecycle(s, d):
    return A.lifecycle(nodes(s, d), "created_at", _now(s, d))


def tenant_rollup(s, d):
    n = nodes(s, d)
    return n.rollup("session", "tier").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def session_summary(s, d):
    """Count, first and last time and the tiers of each session."""
    n = nodes(s, d).where("session is not null").groupBy("session")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return n.agg(F.count("*").alias("n"), at(F.min("created_at")).alias("first"), at(F.max("created_at")).alias("last"), F.array_join(F.sort_array(F.collect_set("tier")), ",").alias("tiers"))


def kuramoto_order(s, d):
    return nodes(s, d).groupBy("domain").agg(F.round(V.kuramoto_order("phase"), 6).alias("order"))


def circular_mean(s, d):
    return nodes(s, d).groupBy("tier").agg(F.round(V.circular_mean("phase"), 5).alias("mean"))


def kuramoto_step(s, d):
    """One Euler step of each node's phase towards its domain's, from two sums: no node meets another."""
    n = nodes(s, d).where("phase is not null and domain is not null").select("node_id", "domain", "phase")
    sums = n.groupBy("domain").agg(F.sum(F.sin("phase")).alias("sn"), F.sum(F.cos("phase")).alias("cs"), F.count("*").alias("n"))
    pull = F.cos("phase") * F.col("sn") - F.sin("phase") * F.col("cs")
    return n.join(F.broadcast(sums), "domain").select("node_id", F.round(F.pmod(F.col("phase") + 0.01 * (0.5 / F.col("n")) * pull, F.lit(6.283185307179586)), 6).alias("phase"))


def tier_coherence(s, d):
    t = nodes(s, d).groupBy("tier").agg((1 - F.stddev_pop("amplitude")).alias("c"))
    return t.agg(F.round(F.avg("c"), 6).alias("coherence"))


def lyapunov(s, d):
    """Energy of each day's nodes and its change from the day before."""
    day = F.to_date("created_at").cast("string").alias("day")
    n = nodes(s, d).groupBy(day).agg(F.avg(1 - F.col("confidence")).alias("t"), F.avg((F.col("state") == "disputed").cast("double")).alias("c"), F.count("*").alias("all"))
    # entropy of the day's tiers over the greatest possible of four
    tiers = nodes(s, d).groupBy(day, "tier").agg(F.count("*").alias("k")).join(n.select(F.col("day").alias("of"), "all"), F.col("day").eqNullSafe(F.col("of")))
    h = tiers.groupBy("of").agg(F.sum(-F.col("k") / F.col("all") * F.log2(F.col("k") / F.col("all"))).alias("h"))
    n = n.join(h, F.col("day").eqNullSafe(F.col("of")))
    v = 0.4 * F.col("t") * F.col("t") + 0.3 * F.col("h") / 2 + 0.2 * F.col("c")
    return n.select("day", v.alias("v")).select("day", F.round("v", 6).alias("v"), F.round(F.col("v") - F.lag("v").over(Window.orderBy("day")), 6).alias("dv"))


def kurtosis(s, d):
    k = nodes(s, d).groupBy("domain").agg(F.count("salience").alias("n"), F.kurtosis("salience").alias("k"))
    return k.select("domain", F.round(F.when(F.col("n") < 4, 3.0).otherwise(F.col("k") + 3), 5).alias("kurtosis"))


def field_state(s, d):
    n = nodes(s, d)
    avg = lambda c: F.round(F.avg(c), 6).alias(c)
    return n.agg(F.count("*").alias("n"), avg("phase"), avg("amplitude"), avg("salience"), avg("confidence"))


def feedback_last20(s, d):
    """Mean quality of the last twenty ratings of each rater, by document."""
    r = table(s, d, "doc_labels").where("quality is not null")
    return A.last_n(r, "rater", [F.desc("doc_id"), F.col("quality"), F.col("toxic")], 20).groupBy("rater").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean"))


def feedback_bands(s, d):
    q = F.col("quality")
    band = F.when(q >= 4, "good").when(q >= 3, "fair").otherwise("poor")
    return table(s, d, "doc_labels").where("quality is not null").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean"))


def salience_feedback(s, d):
    """Salience after the ratings of each document are applied in order, clipped at every step."""
    r = table(s, d, "doc_labels").where("quality is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rater", "quality"))).alias("r"))
    step = lambda x, y: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x + 0.1 * (y["quality"] / 5.0 - 0.5)))
    return r.select("doc_id", F.round(F.aggregate("r", F.lit(0.98), step), 6).alias("salience"))


def decay_closed_form(s, d):
    rate = F.when(F.col("tier") == "episodic", 0.992).when(F.col("tier") == "procedural", 1.0).otherwise(0.999)
    n = M.decay(nodes(s, d), rate, F.lit(100))
    return n.select("node_id", F.round("amplitude", 6).alias("amplitude"), F.round("salience", 6).alias("salience"))


def dead_nodes(s, d):
    return nodes(s, d).where("amplitude < 0.05 or salience < 0.025").select("node_id")


def dead_nodes_strict(s, d):
    """Nodes under half of the greatest amplitude or a quarter of the greatest salience."""
    return nodes(s, d).where("amplitude < 0.5 or salience < 0.25").select("node_id")


def capacity_prune(s, d):
    return M.beyond_capacity(nodes(s, d), 500).select("node_id")


def tier_policy_prune(s, d):
    policy = s.createDataFrame([("episodic", 24.0, 0.3, 0.6), ("semantic", 168.0, 0.1, 0.4), ("procedural", 336.0, 0.05, 0.3)], "tier string, max_hours double, min_salience double, min_amplitude double")
    return M.prunable(nodes(s, d), policy, "created_at", _now(s, d)).select("node_id")


def retention_union(s, d):
    n = nodes(s, d).select("node_id", "created_at")
    return M.expired(n, "node_id", "created_at", cutoff=F.lit("2025-01-05").cast("timestamp"), keep=600).select("node_id")


def tier_placement(s, d):
    a = table(s, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("hits"), F.max("o_orderdate").alias("last"))
    return M.tiers(a, 100, 200)


def snapshot_diff(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    old = o.where("o_orderkey % 7 <> 0")
    new = o.where("o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus")))
    return M.snapshot_diff(old, new, "o_orderkey", ["o_orderstatus", "price"])


def as_of_state(s, d):
    v = table(s, d, "orders").select("o_custkey", micros("o_orderdate").alias("version"), "o_orderkey", "o_orderstatus")
    v = v.withColumn("version", F.col("version") * 10 + F.pmod("o_orderkey", F.lit(10)))
    return M.as_of(v.where("version < 8000000000000000"), "o_custkey", "version", 8_000_000_000_000_000).select("o_custkey", "version", "o_orderstatus")


def change_history(s, d):
    v = table(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("version"), "o_orderstatus")
    h = M.history(v, "o_custkey", "version", "o_orderstatus")
    return h.select("o_custkey", "version", "before", "o_orderstatus")


def upsert_latest(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return M.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey", "o_orderkey")


def delete_nodes(s, d):
    n = nodes(s, d)
    return M.delete(n, n.where("state = 'deprecated'"), "node_id").groupBy("state").agg(F.count("*").alias("n"))


def valid_at(s, d):
    """Nodes valid at a time by their valid_from, null meaning always."""
    return nodes(s, d).where("valid_from is null or valid_from <= timestamp '2025-01-10'").groupBy("domain").agg(F.count("*").alias("n"))


def node_checksum(s, d):
    return M.checksum(nodes(s, d).select("node_id", "tier", "state"), ["node_id", "tier", "state"])


def health_report(s, d):
    n = nodes(s, d)
    bad = F.isnan("phase") | F.isnan("amplitude") | F.isnan("salience")
    return n.agg(F.count("*").alias("nodes"), F.count_if(F.col("content").isNull() | (F.trim("content") == "")).alias("blank"), F.count_if(F.coalesce(bad, F.lit(False))).alias("broken"), F.count_if(F.col("state") == "disputed").alias("disputed"), F.round(F.avg("confidence"), 6).alias("confidence"))


def low_confidence(s, d):
    return nodes(s, d).where("confidence < 0.3").select("node_id", F.round(F.coalesce("salience", F.lit(0.0)) * 0.5, 7).alias("salience"))


def refresh_boost(s, d):
    """Salience of the nodes touched on the last day raised by a tenth, at most to 1."""
    n, now = nodes(s, d), _now(s, d)
    touched = n.where(micros("created_at") >= now - 86_400_000_000)
    return touched.select("node_id", F.round(F.least(F.lit(1.0), F.col("salience") * 1.1), 6).alias("salience"))


def clv_ranks(s, d):
    """Customers by spend within their nation, first five: a rank cut before the shuffle."""
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spend"))
    c = o.join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("c_nationkey").orderBy(F.desc(F.round("spend", 2)), "c_custkey")
    return c.withColumn("place", F.row_number().over(w)).where("place <= 5").select("c_nationkey", "c_custkey", F.round("spend", 2).alias("spend"), "place")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_") and k != "nodes"}

_N = "nodes AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY salience DESC NULLS LAST, phase NULLS FIRST, amplitude NULLS FIRST) AS rn FROM memory_nodes WHERE node_id IS NOT NULL) WHERE rn = 1)"
_NOW = "(SELECT max(created_at) FROM memory_nodes)"

def _hash(m: int) -> str:
    parts = "0::BIGINT"
    for k in range(4):
        parts = f"(({parts}) * 4294967296 + CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), {8 * k + 1}, 8)) AS BIGINT)) % {m}"
    return parts


_TRAIL = "count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {n}000000 - 1 PRECEDING AND CURRENT ROW)"

SQL = {
    "event_counts": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
    "events_hourly": "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
    "events_query": "SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CAST(props->>'$.k' AS INT) AS k FROM events WHERE event_type = 'click' AND ts >= '2024-01-15'",
    "sessions_distinct": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY ALL",
    "sessions_gap30": """WITH g AS (SELECT *, (epoch_us(ts) // 1000) AS ms, CASE WHEN (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER w <= 1800000 THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000))),
        k AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ms, f DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT CAST(user_id AS VARCHAR) AS actor, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS events FROM k GROUP BY user_id, k""",
    "conversions_once": "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL",
    "funnel": """WITH u AS (SELECT user_id, min(ts) FILTER (event_type = 'view') AS a, min(ts) FILTER (event_type = 'click') AS b, min(ts) FILTER (event_type = 'purchase') AS c FROM events GROUP BY user_id)
        SELECT CASE WHEN a IS NULL THEN 0 WHEN b IS NULL OR b < a THEN 1 WHEN c IS NULL OR c < b THEN 2 ELSE 3 END AS step, count(*) AS users FROM u GROUP BY ALL""",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, .5), 6) AS p50, round(quantile_cont(value, .95), 6) AS p95, round(quantile_cont(value, .99), 6) AS p99 FROM events GROUP BY ALL",
    "p95_nearest_index": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, list_sort(list(value))[CAST(floor(count(value) * 0.95) AS BIGINT) + 1] AS p95, max(value) AS most FROM events WHERE value IS NOT NULL GROUP BY ALL",
    "cost_summary": """WITH c AS (SELECT event_type, CASE event_type WHEN 'view' THEN 0.5::DOUBLE WHEN 'click' THEN 0.02 WHEN 'purchase' THEN 0.3 ELSE 0.01 END * (1 + value / 1000) AS c FROM events)
        SELECT event_type, round(sum(c), 4) AS total, round(avg(c), 6) AS mean FROM c GROUP BY ALL""",
    "rate_counts": f"WITH c AS (SELECT user_id, {_TRAIL.format(n=60)} AS a, {_TRAIL.format(n=3600)} AS b, {_TRAIL.format(n=86400)} AS c FROM events) SELECT user_id, max(a) AS minute, max(b) AS hour, max(c) AS day FROM c GROUP BY user_id",
    "rate_limited": f"SELECT * FROM (SELECT event_id, {_TRAIL.format(n=3600)} AS n FROM events) WHERE n > 2",
    "ab_results": f"SELECT {_hash(3)} AS variant, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
    "variant_assign": f"SELECT DISTINCT user_id, {_hash(7)} AS variant FROM events",
    "entropy_norm": """WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY user_id) AS p FROM c)
        SELECT user_id, round(CASE WHEN count(*) >= 3 THEN sum(-p * log2(p + 1e-10)) / log2(count(*)) END, 6) AS entropy FROM p GROUP BY user_id""",
    "tension_spikes": """WITH w AS (SELECT event_id, value, count(value) OVER w AS seen, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM events
        WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))
        SELECT event_id, round(abs(value - m) / sd, 5) AS z FROM w WHERE seen >= 10 AND abs(value - m) / sd > 2""",
    "adaptive_threshold": """WITH w AS (SELECT event_id, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM events
        WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
        SELECT event_id, round(greatest(0.01, m + 0.5 * sd), 5) AS threshold FROM w WHERE n >= 5""",
    "forgetting_bins": f"""WITH {_N}, b AS (SELECT CASE WHEN salience > 0.7 THEN 'critical' WHEN salience > 0.4 THEN 'high' WHEN salience > 0.1 THEN 'medium' ELSE 'low' END AS bin FROM nodes)
        SELECT k.bin, count(b.bin) AS n, round(100.0 * count(b.bin) / greatest((SELECT count(*) FROM b), 1), 1) AS pct FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) k(bin) LEFT JOIN b ON b.bin = k.bin GROUP BY k.bin""",
    "tier_distribution": f"WITH {_N} SELECT tier, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM nodes), 2) AS pct FROM nodes GROUP BY tier",
    "domain_stats": f"WITH {_N} SELECT domain, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM nodes), 2) AS pct FROM nodes GROUP BY domain",
    "node_lifecycle": f"""WITH {_N}, h AS (SELECT (epoch_us({_NOW}) - epoch_us(created_at)) / 3.6e9 AS h FROM nodes WHERE created_at IS NOT NULL)
        SELECT round(avg(h), 1) AS avg_h, round(quantile_cont(h, .5), 1) AS median_h, round(min(h), 1) AS min_h, round(max(h), 1) AS max_h FROM h""",
    "tenant_rollup": f"WITH {_N} SELECT session, tier, count(*) AS n, CAST(grouping(session, tier) AS INT) AS level FROM nodes GROUP BY ROLLUP (session, tier)",
    "session_summary": f"""WITH {_N} SELECT session, count(*) AS n, strftime(min(created_at), '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(max(created_at), '%Y-%m-%d %H:%M:%S.%f') AS last,
        array_to_string(list_sort(list(DISTINCT tier) FILTER (tier IS NOT NULL)), ',') AS tiers FROM nodes WHERE session IS NOT NULL GROUP BY session""",
    "kuramoto_order": f"WITH {_N} SELECT domain, round(sqrt(pow(avg(cos(phase)), 2) + pow(avg(sin(phase)), 2)), 6) AS \"order\" FROM nodes GROUP BY domain",
    "circular_mean": f"WITH {_N}, a AS (SELECT tier, atan2(avg(sin(phase)), avg(cos(phase))) AS a FROM nodes GROUP BY tier) SELECT tier, round(CASE WHEN a < 0 THEN a + 6.283185307179586 ELSE a END, 5) AS mean FROM a",
    "kuramoto_step": f"""WITH {_N}, s AS (SELECT domain, sum(sin(phase)) AS sn, sum(cos(phase)) AS cs, count(*) AS n FROM nodes WHERE phase IS NOT NULL AND domain IS NOT NULL GROUP BY domain),
        x AS (SELECT node_id, phase + 0.01::DOUBLE * (0.5::DOUBLE / n) * (cos(phase) * sn - sin(phase) * cs) AS x FROM nodes JOIN s USING (domain) WHERE phase IS NOT NULL)
        SELECT node_id, round(x - floor(x / 6.283185307179586) * 6.283185307179586, 6) AS phase FROM x""",
    "tier_coherence": f"WITH {_N} SELECT round(avg(c), 6) AS coherence FROM (SELECT 1 - stddev_pop(amplitude) AS c FROM nodes GROUP BY tier)",
    "lyapunov": f"""WITH {_N}, n AS (SELECT *, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day FROM nodes), k AS (SELECT day, tier, count(*) AS k FROM n GROUP BY ALL), h AS (SELECT day, sum(-p * log2(p)) AS h FROM (SELECT day, k / sum(k) OVER (PARTITION BY day) AS p FROM k) GROUP BY day),
        a AS (SELECT day, 0.4::DOUBLE * pow(avg(1 - confidence), 2) + 0.2::DOUBLE * avg(CAST(state = 'disputed' AS DOUBLE)) AS v FROM n GROUP BY day), v AS (SELECT a.day, a.v + 0.3::DOUBLE * h / 2 AS v FROM a JOIN h ON a.day IS NOT DISTINCT FROM h.day)
        SELECT day, round(v, 6) AS v, round(v - lag(v) OVER (ORDER BY day NULLS FIRST), 6) AS dv FROM v""",
    "kurtosis": f"WITH {_N} SELECT domain, round(CASE WHEN count(salience) < 4 THEN 3.0 ELSE kurtosis_pop(salience) + 3 END, 5) AS kurtosis FROM nodes GROUP BY domain",
    "field_state": f"WITH {_N} SELECT count(*) AS n, round(avg(phase), 6) AS phase, round(avg(amplitude), 6) AS amplitude, round(avg(salience), 6) AS salience, round(avg(confidence), 6) AS confidence FROM nodes",
    "feedback_last20": """SELECT rater, count(*) AS n, round(avg(quality), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY rater ORDER BY doc_id DESC, quality, toxic) AS k
        FROM doc_labels WHERE quality IS NOT NULL) WHERE k <= 20 GROUP BY rater""",
    "feedback_bands": "SELECT CASE WHEN quality >= 4 THEN 'good' WHEN quality >= 3 THEN 'fair' ELSE 'poor' END AS band, count(*) AS n, round(avg(quality), 6) AS mean FROM doc_labels WHERE quality IS NOT NULL GROUP BY ALL",
    "salience_feedback": """WITH r AS (SELECT doc_id, list(quality ORDER BY rater, quality) AS r FROM doc_labels WHERE quality IS NOT NULL GROUP BY doc_id)
        SELECT doc_id, round(list_reduce(list_prepend(0.98::DOUBLE, list_transform(r, lambda y: CAST(y AS DOUBLE))), lambda x, y: greatest(0.0, least(1.0, x + 0.1::DOUBLE * (y / 5.0 - 0.5)))), 6) AS salience FROM r""",
    "decay_closed_form": f"""WITH {_N}, f AS (SELECT *, pow(CASE tier WHEN 'episodic' THEN 0.992::DOUBLE WHEN 'procedural' THEN 1.0 ELSE 0.999 END, 100) AS f FROM nodes)
        SELECT node_id, round(greatest(0.05, least(1.0, amplitude * f)), 6) AS amplitude, round(greatest(0.025, least(1.0, salience * f)), 6) AS salience FROM f""",
    "dead_nodes": f"WITH {_N} SELECT node_id FROM nodes WHERE amplitude < 0.05 OR salience < 0.025",
    "dead_nodes_strict": f"WITH {_N} SELECT node_id FROM nodes WHERE amplitude < 0.5 OR salience < 0.25",
    "capacity_prune": f"WITH {_N} SELECT node_id FROM (SELECT node_id, row_number() OVER (ORDER BY coalesce(salience * amplitude, 0) DESC, node_id) AS k FROM nodes) WHERE k > 500",
    "tier_policy_prune": f"""WITH {_N}, p(tier, h, s, a) AS (VALUES ('episodic', 24, 0.3, 0.6), ('semantic', 168, 0.1, 0.4), ('procedural', 336, 0.05, 0.3))
        SELECT node_id FROM nodes JOIN p USING (tier) WHERE (epoch_us({_NOW}) - epoch_us(created_at)) / 3.6e9 >= h AND salience <= s AND amplitude <= a""",
    "retention_union": f"""WITH {_N} SELECT node_id FROM (SELECT node_id, created_at, row_number() OVER (ORDER BY created_at DESC NULLS LAST, node_id) AS k FROM nodes WHERE created_at IS NOT NULL) WHERE created_at < '2025-01-05' OR k > 600""",
    "tier_placement": """WITH a AS (SELECT o_custkey AS key, count(*) AS hits, max(o_orderdate) AS last FROM orders GROUP BY 1), h AS (SELECT *, row_number() OVER (ORDER BY hits DESC, key) AS k FROM a),
        w AS (SELECT *, row_number() OVER (PARTITION BY k > 100 ORDER BY last DESC, key) AS j FROM h) SELECT key, CASE WHEN k <= 100 THEN 'hot' WHEN j <= 200 THEN 'warm' ELSE 'cold' END AS tier FROM w""",
    "snapshot_diff": """WITH o AS (SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderkey % 7 <> 0), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 5 <> 0)
        SELECT * FROM (SELECT o_orderkey, CASE WHEN o.s IS NULL THEN 'added' WHEN n.s IS NULL THEN 'removed' WHEN o.s <> n.s THEN 'changed' END AS status FROM o FULL JOIN n USING (o_orderkey)) WHERE status IS NOT NULL""",
    "as_of_state": """WITH v AS (SELECT o_custkey, epoch_us(o_orderdate) * 10 + o_orderkey % 10 AS version, o_orderkey, o_orderstatus FROM orders)
        SELECT o_custkey, max(version) AS version, arg_max(o_orderstatus, (version, o_orderkey)) AS o_orderstatus FROM v WHERE version < 8000000000000000 GROUP BY o_custkey""",
    "change_history": """SELECT * FROM (SELECT o_custkey, o_orderkey AS version, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, o_orderstatus FROM orders) WHERE before IS DISTINCT FROM o_orderstatus""",
    "upsert_latest": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey",
    "delete_nodes": f"WITH {_N} SELECT state, count(*) AS n FROM nodes WHERE state IS DISTINCT FROM 'deprecated' GROUP BY state",
    "valid_at": f"WITH {_N} SELECT domain, count(*) AS n FROM nodes WHERE valid_from IS NULL OR valid_from <= TIMESTAMP '2025-01-10' GROUP BY domain",
    "node_checksum": f"""WITH {_N} SELECT count(*) AS rows, CAST(sum(CAST(('0x' || substr(sha256(concat_ws(chr(1), coalesce(node_id, chr(0)), coalesce(tier, chr(0)), coalesce(state, chr(0)))), 1, 12)) AS BIGINT)) AS VARCHAR) AS digest FROM nodes""",
    "health_report": f"""WITH {_N} SELECT count(*) AS nodes, count(*) FILTER (content IS NULL OR trim(content) = '') AS blank, count(*) FILTER (isnan(phase) OR isnan(amplitude) OR isnan(salience)) AS broken,
        count(*) FILTER (state = 'disputed') AS disputed, round(avg(confidence), 6) AS confidence FROM nodes""",
    "low_confidence": f"WITH {_N} SELECT node_id, round(coalesce(salience, 0) * 0.5::DOUBLE, 7) AS salience FROM nodes WHERE confidence < 0.3",
    "refresh_boost": f"WITH {_N} SELECT node_id, round(least(1.0, salience * 1.1::DOUBLE), 6) AS salience FROM nodes WHERE created_at >= {_NOW} - INTERVAL 1 DAY",
    "clv_ranks": """WITH c AS (SELECT c_nationkey, c_custkey, round(sum(o_totalprice), 2) AS spend FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY spend DESC, c_custkey) AS place FROM c) WHERE place <= 5""",
}
