"""The staged pipeline, its plans and metrics, imports, exports and the streaming forms run over files."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemora import workspace
from mnemora.operators import scoring
from mnemora.plans import pipeline as P
from mnemora.queries import similarity as S
from mnemora.queries.analytics import _N, nodes
from mnemora.queries.similarity import _top, _G, _PHASE, _WEIGHT
from mnemora.sources.tables import spread, table, wrapped_texts
from mnemora.streaming import events as st


def plan_skip(s, d):
    return P.plan(table(s, d, "eval_items"), "item_id", "query")


def plan_skip_top3(s, d):
    return P.plan(table(s, d, "eval_items"), "item_id", "query", top_k=3)


def pipeline_retrieve(s, d):
    """retrieve, calibrate and explain composed to one plan."""
    p = P.Pipeline().add("retrieve", lambda n: scoring.topk(n, S._asked(n), 5, coupling=0.3)).add("calibrate", lambda r: r.where("score >= 0.05")).add("explain", P.explain)
    return p.transform(S._nodes(s, d))


def _calls(s, d):
    stage = F.element_at(F.array(*map(F.lit, P.STAGES)), (F.pmod(F.col("event_id"), F.lit(6)) + 1).cast("int"))
    return table(s, d, "events").select(stage.alias("stage"), F.col("value").alias("latency_ms"), (F.col("event_id") % 17 == 0).alias("failed"))


def stage_costs(s, d):
    c = _calls(s, d).withColumn("cost", P.stage_cost(F.col("stage"), F.col("latency_ms")))
    return c.groupBy("stage").agg(F.round(F.sum("cost"), 4).alias("total"), F.round(F.avg("cost"), 6).alias("mean"))


def stage_health(s, d):
    return P.health(_calls(s, d), {"embed": 50.0, "retrieve": 200.0})


def export_roundtrip(s, d):
    """Nodes written as JSON lines and read back."""
    path = workspace.new_dir(s, "export")
    nodes(s, d).select("node_id", "tier", "salience").write.json(path)
    return s.read.schema("node_id string, tier string, salience double").json(path)


def export_markdown(s, d):
    """One line of each tier: its nodes of greatest salience, five at most, which is the report's feature."""
    from pyspark.sql import Window

    w = Window.partitionBy("tier").orderBy(F.desc("salience"), "node_id")
    n = nodes(s, d).withColumn("place", F.row_number().over(w)).where("place <= 5")
    line = F.format_string("- %s (%.3f)", "node_id", "salience")
    return n.groupBy("tier").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]), "\n").alias("markdown"))


def import_records(s, d):
    """Documents of the source json_import taken apart to their JSON records; ``import_records_all`` takes every wrapped document."""
    docs = table(s, d, "documents").where("source = 'json_import' and text is not null").select("doc_id", F.try_parse_json("text").alias("v"))
    rows = docs.select("doc_id", F.explode(F.coalesce(F.try_variant_get("v", "$.records", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))).alias("r"))
    return rows.select("doc_id", F.try_variant_get("r", "$.text", "string").alias("text")).groupBy("doc_id").agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("chars"))


def import_records_all(s, d):
    """JSON and CSV wrapped documents of any source taken apart to their records."""
    docs = spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(wrapped_texts("text")).alias("text"))
    return docs.groupBy("doc_id").agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("chars"))


def _stream(s, d, make, mode: str):
    """Run a streaming query over the events file to its end, into files that are read back."""
    source = table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    path, out, check = (workspace.new_dir(s, k) for k in ("stream-in", "stream-out", "stream-state"))
    source.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    df = make(st.file_stream(s, path, source.schema))
    if mode == "append":
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    else:
        df.writeStream.foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(out)).outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(df.schema).parquet(out)


def stream_hourly(s, d):
    """Hours counted by a stream with a watermark; complete mode gives them all."""
    c = _stream(s, d, lambda e: st.hourly_counts(e).select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n"), "complete")
    return c


def stream_once(s, d):
    return _stream(s, d, lambda e: st.once(e.where("event_type = 'purchase'"), ["event_id"]).select("event_id", "user_id"), "append")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

from mnemora.queries.lexical import _KIND  # noqa: E402

_ROUTE = f"CASE {_KIND} WHEN 'factual' THEN 'fast' WHEN 'ambiguous' THEN 'standard' ELSE 'deep' END"
_NW = "len(list_filter(regexp_split_to_array(query, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))"


def _plan(low: bool) -> str:
    cal = "CASE WHEN route = 'fast' THEN 'fast_route_skip:calibrate'" + (" ELSE 'low_top_k' END" if low else " END")
    return f"""WITH r AS (SELECT item_id, {_ROUTE} AS route, {_NW} AS n FROM eval_items),
    k AS (SELECT *, CASE WHEN route = 'fast' THEN 'fast_route_skip:rerank' END AS a, {cal} AS b, CASE WHEN n <= 10 THEN 'short_query' END AS c FROM r)
    SELECT item_id, route, concat_ws(',', 'embed', 'route', 'retrieve', CASE WHEN a IS NULL THEN 'rerank' END, CASE WHEN b IS NULL THEN 'calibrate' END, CASE WHEN c IS NULL THEN 'explain' END) AS stages,
      concat_ws(',', a, b, c) AS skipped, CAST(round(16.1 + CASE WHEN a IS NULL THEN 8 ELSE 0 END + CASE WHEN b IS NULL THEN 0.5 ELSE 0 END + CASE WHEN c IS NULL THEN 2 ELSE 0 END, 3) AS DOUBLE) AS latency_ms,
      CAST(round(0.36 + CASE WHEN a IS NULL THEN 0.2 ELSE 0 END + CASE WHEN b IS NULL THEN 0.02 ELSE 0 END + CASE WHEN c IS NULL THEN 0.08 ELSE 0 END, 6) AS DOUBLE) AS cost FROM k"""


_CALLS = "m AS (SELECT (['embed', 'route', 'retrieve', 'rerank', 'calibrate', 'explain'])[event_id % 6 + 1] AS stage, value AS latency_ms, event_id % 17 = 0 AS failed FROM events)"
SQL = {
    "plan_skip": _plan(False),
    "plan_skip_top3": _plan(True),
    "pipeline_retrieve": _top(f"{_G} * {_PHASE} * {_WEIGHT}", tail="""SELECT query_id, id, score, rank, 'rank ' || rank || '; score ' || printf('%.3f', score) || '; ' ||
        CASE WHEN score >= 0.8 THEN 'strong match' WHEN score >= 0.3 THEN 'partial match' ELSE 'weak match' END AS why FROM r WHERE rank <= 5 AND score >= 0.05"""),
    "stage_costs": f"""WITH {_CALLS}, c AS (SELECT stage, CASE stage WHEN 'embed' THEN 0.5::DOUBLE WHEN 'route' THEN 0.01 WHEN 'retrieve' THEN 0.02 WHEN 'rerank' THEN 0.3 WHEN 'calibrate' THEN 0.01 ELSE 0.15 END * (1 + latency_ms / 1000) AS c FROM m)
        SELECT stage, round(sum(c), 4) AS total, round(avg(c), 6) AS mean FROM c GROUP BY stage""",
    "stage_health": f"""WITH {_CALLS}, h AS (SELECT stage, count(*) AS calls, quantile_cont(latency_ms, 0.95) AS p95, avg(CAST(failed AS DOUBLE)) AS errors FROM m GROUP BY stage)
        SELECT stage, calls, round(p95, 3) AS p95, round(errors, 6) AS errors, CASE WHEN errors > 0.1 THEN 'failing' WHEN p95 > CASE stage WHEN 'embed' THEN 50 WHEN 'retrieve' THEN 200 ELSE 1e12 END THEN 'slow' ELSE 'healthy' END AS status FROM h""",
    "export_roundtrip": f"WITH {_N} SELECT node_id, tier, salience FROM nodes",
    "export_markdown": f"""WITH {_N}, r AS (SELECT tier, node_id, salience, row_number() OVER (PARTITION BY tier ORDER BY salience DESC, node_id) AS k FROM nodes)
        SELECT tier, string_agg('- ' || node_id || ' (' || printf('%.3f', salience) || ')', chr(10) ORDER BY k) AS markdown FROM r WHERE k <= 5 GROUP BY tier""",
    "import_records": """WITH j AS (SELECT doc_id, CAST(text AS JSON) AS v FROM documents WHERE source = 'json_import' AND text IS NOT NULL AND json_valid(text)),
        r AS (SELECT doc_id, unnest(CAST(CASE WHEN json_type(v) = 'ARRAY' THEN v ELSE v->'$.records' END AS JSON[])) AS r FROM j) SELECT doc_id, count(*) AS records, CAST(sum(length(r->>'$.text')) AS BIGINT) AS chars FROM r GROUP BY doc_id""",
    "import_records_all": """WITH j AS (SELECT doc_id, CAST(text AS JSON) AS v FROM documents WHERE json_valid(text)),
        r AS (SELECT doc_id, unnest(CAST(CASE WHEN json_type(v) = 'ARRAY' THEN v ELSE v->'$.records' END AS JSON[]))->>'$.text' AS t FROM j),
        c AS (SELECT doc_id, unnest(regexp_extract_all(substr(text, strpos(text, chr(10)) + 1), '(?m)^[^,\n]*,("(?:[^"]|"")*"|[^"\n]*)$', 1)) AS f FROM documents WHERE starts_with(text, 'id,text' || chr(10))),
        a AS (SELECT * FROM r UNION ALL SELECT doc_id, CASE WHEN starts_with(f, '"') THEN replace(substr(f, 2, length(f) - 2), '""', '"') ELSE f END FROM c)
        SELECT doc_id, count(*) AS records, CAST(sum(length(t)) AS BIGINT) AS chars FROM a GROUP BY doc_id""",
    "stream_hourly": "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_once": "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'",
}
