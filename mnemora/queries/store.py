"""The node store: pages, intake, dumps, timelines, versions and backups over the memory nodes and their companions."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemora import workspace
from mnemora.functions import text as T
from mnemora.operators import graph as G
from mnemora.operators import store as O
from mnemora.operators.wal_replay import parse_changes
from mnemora.queries.analytics import _N, nodes
from mnemora.sources import tables as src
from mnemora.sources.tables import table


def list_nodes(s, d):
    """The second page of fifty nodes by id."""
    return O.page(nodes(s, d).select("node_id", "tier", "session"), "node_id", offset=50, limit=50)


def get_node(s, d):
    return nodes(s, d).where("node_id = 'm000000042'").select("node_id", "tier", "modality", F.round("salience", 6).alias("salience"), F.length("content").alias("chars"))


def wal_since(s, d):
    """Changes after a clock: (clock, origin, kind) of the readable rows, each once."""
    return parse_changes(table(s, d, "wal")).where("clock > 100").select("clock", "origin", "kind").distinct()


def audit_query(s, d):
    """The newest hundred actions of a kind, with who did them."""
    a = table(s, d, "events").select("event_id", "ts", F.col("user_id").alias("actor"), F.col("event_type").alias("action"))
    return O.newest(a, "ts", "event_id", 100, action="purchase").select("event_id", "actor", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


def metrics_read_all(s, d):
    """Metric lines in a current file and rotated ones, read together."""
    path = workspace.new_dir(s, "metrics")
    e = table(s, d, "events").select("event_id", "event_type", "value")
    for k in range(3):
        e.where(F.pmod("event_id", F.lit(3)) == k).write.json(f"{path}/log.{k}")
    read = s.read.schema("event_id bigint, event_type string, value double").json(f"{path}/log.*")
    return read.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def tiered_read(s, d):
    """Nodes written to a folder a tier; a read of given ids finds them in whichever it is, by its partition."""
    path = workspace.new_dir(s, "tiers")
    place = F.when(F.col("salience") > 0.7, "hot").when(F.col("salience") > 0.3, "warm").otherwise("cold")
    nodes(s, d).select("node_id", "salience", place.alias("place")).write.partitionBy("place").parquet(path)
    wanted = nodes(s, d).where(F.col("node_id").endswith("7")).select("node_id")
    return s.read.parquet(path).join(wanted, "node_id", "left_semi").select("node_id", "place")


def add_nodes_batch(s, d):
    """Vectors taken in as a batch: lengths brought to 1."""
    rows = table(s, d, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("node_id"), F.lit("text of a vector").alias("text"), F.col("embedding").alias("vector"), F.element_at(F.array(*map(F.lit, ("text", "code", "vision", "smell"))), (F.pmod("vec_id", F.lit(4)) + 1).cast("int")).alias("modality"))
    n = O.ingest(rows, now=1000.0, normalise=True)
    return n.select("node_id", "modality", *(F.round(c, 6).alias(c) for c in ("salience", "amplitude", "phase")))


def add_node(s, d):
    """Nodes of contents and vectors as single calls take them in: lengths kept, injected instructions left out."""
    v = table(s, d, "node_vectors").where("node_id is not null and size(vector) = 64").groupBy("node_id").agg(F.min("vector").alias("vector"))
    v = v.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = nodes(s, d).select("node_id", F.col("content").alias("text"), "modality").join(v, "node_id")
    return O.ingest(rows, now=500.0, normalise=False).select("node_id", *(F.round(c, 6).alias(c) for c in ("salience", "amplitude", "phase")))


def save_context(s, d):
    """User turns with the answers behind them as nodes: emotion, tags, role, tier."""
    return O.conversation_nodes(O.turns(table(s, d, "chat_messages"))).select("msg_id", "session", "emotion", F.array_join("tags", ",").alias("tags"), "role", "tier")


def update_node(s, d):
    """Tier and confidence of every tenth node replaced, null confidences keeping the old one."""
    n = nodes(s, d).select("node_id", "tier", "confidence")
    change = n.where(F.col("node_id").endswith("0")).select("node_id", F.lit("revised").alias("tier"), F.when(F.col("node_id").endswith("00"), 0.5).alias("confidence"))
    return O.patched(n, change, "node_id", ["tier", "confidence"])


def ump_export(s, d):
    """Head of a portable dump: sizes, tiers and modalities."""
    n = nodes(s, d)
    return O.topology(n, G.edges_of(n))


_DUMPED = ["content", "tier", "session"]


def ump_import(s, d):
    """A dump written and read again, some digests broken on the way: what comes back, and whether it is valid."""
    path = workspace.new_dir(s, "dump")
    broken = F.when(F.col("node_id").endswith("3"), F.lit("0")).otherwise(F.col("sha256"))
    O.dump(nodes(s, d), "node_id", _DUMPED).withColumn("sha256", broken).write.json(path)
    back = O.load(s.read.schema("record string, sha256 string").json(path), "node_id string, content string, tier string, session string")
    return back.select("node_id", "tier", "session", F.length("content").alias("chars"), "valid")


def ump_validate(s, d):
    """Valid and broken records of the dump."""
    return ump_import(s, d).groupBy("valid").agg(F.count("*").alias("n"))


def delta_apply(s, d):
    """The orders of a year turned into those of the next by a delta, which gives exactly these."""
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    old = o.where("o_orderkey % 5 <> 0").withColumn("price", F.when(F.col("o_orderkey") % 7 == 0, 0.0).otherwise(F.col("price")))
    new = o.where("o_orderkey % 11 <> 0")
    cols = ["o_orderstatus", "price"]
    return O.apply_delta(old, O.delta(old, new, "o_orderkey", cols), "o_orderkey", cols)


def delta_sizes(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    old = o.where("o_orderkey % 5 <> 0").withColumn("price", F.when(F.col("o_orderkey") % 7 == 0, 0.0).otherwise(F.col("price")))
    return O.delta(old, o.where("o_orderkey % 11 <> 0"), "o_orderkey", ["o_orderstatus", "price"]).groupBy("op").agg(F.count("*").alias("n"))


def timeline_events(s, d):
    """Procedural nodes of one month."""
    t = O.timeline(nodes(s, d), "created_at", tier="procedural", start=F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"), end=F.lit("2025-01-31 00:00:00").cast("timestamp_ntz"))
    return t.select("node_id", "session", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def timeline_markdown(s, d):
    """A document for each session, as its digest and length."""
    m = O.timeline_markdown(O.timeline(nodes(s, d), "created_at").where("session is not null"), "created_at", "session", "content")
    return m.select("session", F.length("markdown").alias("chars"), F.md5("markdown").alias("md5"))


def export_text(s, d):
    """Lines of text and JSON of every node with a content, of each tier one digest over the sorted lines."""
    n = nodes(s, d).where("content is not null")
    line = F.format_string("[%s] %s", F.coalesce("tier", F.lit("semantic")), "content")
    return n.groupBy("tier").agg(F.count("*").alias("n"), F.sum(F.length(line)).alias("chars"))


def backup_rotate(s, d):
    """Orders as backups of their customers: those beyond the newest three."""
    o = table(s, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return O.outdated(o, "o_custkey", "o_orderdate", "o_orderkey", 3).select("o_custkey", "o_orderkey")


def session_roundtrip(s, d):
    """Sessions saved in a folder each and one loaded again."""
    path = workspace.new_dir(s, "saved")
    nodes(s, d).where("session is not null").select("node_id", "session", "tier").write.partitionBy("session").parquet(path)
    big = nodes(s, d).where("session is not null").groupBy("session").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "session").limit(1)
    return s.read.parquet(path).join(F.broadcast(big.select("session")), "session", "left_semi").select("node_id", "session", "tier")


def version_rollback(s, d):
    """Customers' last order at the end of an early version."""
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    v = O.versions(o, "o_custkey", "o_orderkey", ["o_orderstatus", "o_orderpriority"], 1000)
    return O.rolled_back(v, "o_custkey", "o_orderkey", ["o_orderstatus", "o_orderpriority"], 3)


def version_diff(s, d):
    """Changes of each version after the second up to the fifth, by status."""
    v = O.versions(table(s, d, "orders"), "o_custkey", "o_orderkey", ["o_orderstatus"], 1000)
    return v.where("version > 2 and version <= 5").groupBy("version", "o_orderstatus").agg(F.count("*").alias("n"))


def import_json_files(s, d):
    """Records written as JSON files of three shapes and imported again, with an error for those without a text."""
    path = workspace.new_dir(s, "json")
    r = table(s, d, "rubq_records").select("rec_id", F.struct(F.col("rec_id"), F.col("context").alias("text"), F.col("topic")).alias("r"))
    shape = r.withColumn("file", F.floor(F.col("rec_id") / 50)).groupBy("file").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rec_id", "r"))), lambda x: x["r"])).alias("list"))
    whole = F.when(F.col("file") % 2 == 0, F.col("list")).otherwise(F.concat(F.lit('{"records":'), "list", F.lit("}")))
    # a file a row: a text file of one line each
    shape.select(whole.alias("value"), F.col("file").cast("string").alias("file")).write.partitionBy("file").text(path)
    got = src.import_json(s, f"{path}/*")
    return got.select(F.get_json_object("metadata", "$.rec_id").cast("bigint").alias("rec_id"), F.length("text").alias("chars"), "error")


def import_csv_files(s, d):
    """Records written as CSV with a header, quotes and line breaks within values, and imported again."""
    path = workspace.new_dir(s, "csv")
    table(s, d, "rubq_records").select("rec_id", F.col("query").alias("text"), "topic").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    got = src.import_csv(s, path)
    return got.select(F.get_json_object("metadata", "$.rec_id").cast("bigint").alias("rec_id"), F.length("text").alias("chars"), "error")


def import_text_files(s, d):
    """Contexts written as text files and cut to overlapping chunks of words: chunks and words in all."""
    path = workspace.new_dir(s, "text")
    table(s, d, "eval_items").select(F.regexp_replace("context", r"\s+", " ").alias("value"), F.col("item_id").cast("string").alias("item")).write.partitionBy("item").text(path)
    got = src.import_text(s, f"{path}/*", size=20, overlap=5)
    return got.select(F.regexp_extract("path", r"item=(\d+)", 1).cast("bigint").alias("item_id"), "chunk", F.size(T.words("text")).alias("words"))


def import_counts(s, d):
    """Messages imported by role: counts, and the first ten errors of those without a text."""
    m = table(s, d, "chat_messages").select("msg_id", "role", "content").distinct()
    rows = m.select("role", F.col("msg_id").alias("position"), F.when(F.trim(F.coalesce("content", F.lit(""))) == "", "empty text").alias("error"))
    return O.import_report(rows, ["role"]).select("role", "imported", "failed", F.array_join("errors", "; ").alias("errors"))


def vector_integrity(s, d):
    """Node vectors that can't be used, by what is wrong with them."""
    return O.integrity(table(s, d, "node_vectors").distinct(), "node_id", "vector", 64)


def vector_healing(s, d):
    """Vectors with a value that is not finite, after these are set to 0: their length."""
    from mnemora.functions import vectors as V

    v = table(s, d, "node_vectors").select("node_id", "vector").distinct()
    bad = v.where(F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return bad.withColumn("vector", O.healed(bad, "vector")).select("node_id", F.round(V.norm("vector"), 4).alias("length"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

from mnemora.queries.lexical import _CLEAN, _WORDS, _any, _case  # noqa: E402

_LEN = "sqrt(list_inner_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[])))"
_OFF = "CASE modality WHEN 'code' THEN 0.7::DOUBLE WHEN 'metrics' THEN 1.4 WHEN 'audio' THEN 2.1 WHEN 'vision' THEN 2.8 ELSE 0 END"
_2PI = "6.283185307179586::DOUBLE"
_PHASE = f"fmod(fmod({{}}::DOUBLE, {_2PI}) + {_OFF}, {_2PI})"
_FINITE = "len(list_filter({0}, lambda x: isfinite(x))) = len({0})"
_DUMP = "nodes"
_OLD = "o AS (SELECT o_orderkey, o_orderstatus, o_totalprice AS price FROM orders), old AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE price END AS price FROM o WHERE o_orderkey % 5 <> 0), new AS (SELECT * FROM o WHERE o_orderkey % 11 <> 0)"
_STATE_SQL = """s AS (SELECT clock, origin, CASE WHEN json_valid(mutation) THEN CAST(mutation AS JSON) END AS v FROM wal WHERE clock IS NOT NULL AND origin IS NOT NULL)"""
_TAGLIST = "[" + ", ".join(f"CASE WHEN {_any('b', n)} THEN '{k}' END" for k, n in T.TAGS) + "]"
SQL = {
    "list_nodes": f"WITH {_N} SELECT node_id, tier, session FROM nodes ORDER BY node_id LIMIT 50 OFFSET 50",
    "get_node": f"WITH {_N} SELECT node_id, tier, modality, round(salience, 6) AS salience, CAST(length(content) AS INT) AS chars FROM nodes WHERE node_id = 'm000000042'",
    "wal_since": f"""WITH {_STATE_SQL} SELECT DISTINCT clock, origin, CASE WHEN op IN ('add','add_node','create','insert') THEN 'add' WHEN op IN ('update','update_node','patch') THEN 'update' WHEN op IN ('delete','delete_node','remove') THEN 'delete' END AS kind
        FROM (SELECT clock, origin, lower(trim(coalesce(v->>'$.op', v->>'$.action'))) AS op FROM s WHERE v IS NOT NULL AND clock > 100)""",
    "audit_query": "SELECT event_id, user_id AS actor, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 100",
    "metrics_read_all": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type",
    "tiered_read": f"WITH {_N} SELECT node_id, CASE WHEN salience > 0.7 THEN 'hot' WHEN salience > 0.3 THEN 'warm' ELSE 'cold' END AS place FROM nodes WHERE node_id LIKE '%7'",
    "add_nodes_batch": f"""SELECT 'v' || vec_id AS node_id, modality, round(greatest(0.3, least(1.0, 1 / 20.0)), 6) AS salience, round(greatest(0.5, least(1.0, 1 / 15.0)), 6) AS amplitude, round({_PHASE.format(10.0)}, 6) AS phase
        FROM (SELECT vec_id, (['text', 'code', 'vision', 'smell'])[vec_id % 4 + 1] AS modality FROM embeddings)""",
    "add_node": f"""WITH {_N}, nv AS (SELECT node_id, min(vector) AS v FROM node_vectors WHERE node_id IS NOT NULL AND len(vector) = 64 GROUP BY node_id),
        x AS (SELECT node_id, content AS text, modality, {_LEN} AS l FROM nodes JOIN nv USING (node_id) WHERE {_FINITE.format('v')})
        SELECT node_id, round(greatest(0.3, least(1.0, l / 20)), 6) AS salience, round(greatest(0.5, least(1.0, l / 15)), 6) AS amplitude, round({_PHASE.format(5.0)}, 6) AS phase
        FROM x WHERE text IS NULL OR NOT (length(text) > 10000 OR {" OR ".join(f"regexp_matches({_CLEAN}, '{p}')" for p in T.INJECTIONS)})""",
    "save_context": f"""WITH m AS (SELECT DISTINCT session_id, turn, msg_id, role, content FROM chat_messages WHERE content IS NOT NULL AND session_id IS NOT NULL AND role IN ('user', 'assistant')),
        l AS (SELECT *, lead(role) OVER w AS nr, lead(content) OVER w AS nc FROM m WINDOW w AS (PARTITION BY session_id ORDER BY turn, msg_id, content)),
        p AS (SELECT msg_id, session_id AS session, content AS i, CASE WHEN nr = 'assistant' THEN nc ELSE '' END AS o FROM l WHERE role = 'user'), q AS (SELECT *, i || ' ' || o AS b FROM p)
        SELECT msg_id, session, {_case('i', T.EMOTIONS, 'neutral')} AS emotion, array_to_string(list_filter({_TAGLIST}, lambda x: x IS NOT NULL)[1:5], ',') AS tags, CASE WHEN trim(o) <> '' THEN 'assistant' ELSE 'user' END AS role, 'episodic' AS tier FROM q""",
    "update_node": f"WITH {_N} SELECT node_id, CASE WHEN node_id LIKE '%0' THEN 'revised' ELSE tier END AS tier, CASE WHEN node_id LIKE '%00' THEN 0.5 ELSE confidence END AS confidence FROM nodes",
    "ump_export": f"""WITH {_N}, e AS (SELECT DISTINCT source, target FROM (SELECT unnest(causal_parents) AS source, node_id AS target FROM nodes) WHERE source IS NOT NULL AND source <> target),
        t AS (SELECT coalesce(tier, 'none') AS k, count(*) AS n FROM nodes GROUP BY 1), m AS (SELECT coalesce(modality, 'none') AS k, count(*) AS n FROM nodes GROUP BY 1)
        SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT '{{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}}' FROM t) AS tiers, (SELECT '{{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}}' FROM m) AS modalitys""",
    "ump_import": f"WITH {_N} SELECT node_id, tier, session, CAST(length(content) AS INT) AS chars, node_id NOT LIKE '%3' AS valid FROM nodes",
    "ump_validate": f"WITH {_N} SELECT node_id NOT LIKE '%3' AS valid, count(*) AS n FROM nodes GROUP BY 1",
    "delta_apply": f"WITH {_OLD} SELECT * FROM new",
    "delta_sizes": f"""WITH {_OLD} SELECT * FROM (SELECT 'put' AS op, count(*) AS n FROM new LEFT JOIN old USING (o_orderkey) WHERE old.price IS DISTINCT FROM new.price OR old.o_orderstatus IS DISTINCT FROM new.o_orderstatus
        UNION ALL SELECT 'remove', count(*) FROM old ANTI JOIN new USING (o_orderkey)) WHERE n > 0""",
    "timeline_events": f"WITH {_N} SELECT node_id, session, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS at FROM nodes WHERE tier = 'procedural' AND created_at BETWEEN TIMESTAMP '2025-01-01' AND TIMESTAMP '2025-01-31'",
    "timeline_markdown": f"""WITH {_N}, m AS (SELECT session, '# Timeline' || chr(10) || chr(10) || string_agg('## ' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || ' (' || coalesce(tier, 'semantic') || ')' || chr(10) || coalesce(content, '') || chr(10), chr(10) ORDER BY created_at, node_id) AS m
        FROM nodes WHERE session IS NOT NULL AND created_at IS NOT NULL GROUP BY session) SELECT session, CAST(length(m) AS INT) AS chars, md5(m) AS md5 FROM m""",
    "export_text": f"WITH {_N} SELECT tier, count(*) AS n, CAST(sum(length('[' || coalesce(tier, 'semantic') || '] ' || content)) AS BIGINT) AS chars FROM nodes WHERE content IS NOT NULL GROUP BY tier",
    "backup_rotate": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k > 3",
    "session_roundtrip": f"WITH {_N} SELECT node_id, session, tier FROM nodes WHERE session = (SELECT session FROM nodes WHERE session IS NOT NULL GROUP BY session ORDER BY count(*) DESC, session LIMIT 1)",
    "version_rollback": "SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders WHERE o_orderkey // 1000 + 1 <= 3 GROUP BY o_custkey",
    "version_diff": "SELECT o_orderkey // 1000 + 1 AS version, o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey // 1000 + 1 BETWEEN 3 AND 5 GROUP BY ALL",
    "import_json_files": "SELECT rec_id, CAST(length(context) AS INT) AS chars, CASE WHEN trim(coalesce(context, '')) = '' THEN 'empty text' END AS error FROM rubq_records",
    "import_csv_files": "SELECT rec_id, CAST(length(query) AS INT) AS chars, CASE WHEN trim(coalesce(query, '')) = '' THEN 'empty text' END AS error FROM rubq_records",
    "import_text_files": f"""WITH w AS (SELECT item_id, {_WORDS.format(c='context')} AS w FROM eval_items), c AS (SELECT item_id, w, unnest(range(0, len(w), 15)) AS i FROM w)
        SELECT item_id, CAST(i // 15 AS INT) AS chunk, CAST(len(w[i + 1 : i + 20]) AS INT) AS words FROM c""",
    "import_counts": """WITH m AS (SELECT DISTINCT msg_id, role, content FROM chat_messages), e AS (SELECT *, CASE WHEN trim(coalesce(content, '')) = '' THEN 'empty text' END AS error FROM m),
        f AS (SELECT role, string_agg(msg_id || ': ' || error, '; ' ORDER BY msg_id) AS errors FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY msg_id) AS k FROM e WHERE error IS NOT NULL) WHERE k <= 10 GROUP BY role)
        SELECT e.role, count(*) FILTER (error IS NULL) AS imported, count(*) FILTER (error IS NOT NULL) AS failed, coalesce(any_value(errors), '') AS errors FROM e LEFT JOIN f ON e.role = f.role GROUP BY e.role""",
    "vector_integrity": f"""SELECT * FROM (SELECT node_id, CASE WHEN vector IS NULL THEN 'missing' WHEN len(vector) <> 64 THEN 'length' WHEN NOT ({_FINITE.format('vector')}) THEN 'not finite' WHEN len(list_filter(vector, lambda x: x <> 0)) = 0 THEN 'zero' END AS fault
        FROM (SELECT DISTINCT * FROM node_vectors)) WHERE fault IS NOT NULL""",
    "vector_healing": f"""SELECT node_id, round(sqrt(list_inner_product(h, h)), 4) AS length FROM (SELECT node_id, list_transform(vector, lambda x: CASE WHEN isfinite(x) THEN CAST(x AS DOUBLE) ELSE 0 END) AS h
        FROM (SELECT DISTINCT node_id, vector FROM node_vectors) WHERE NOT ({_FINITE.format('vector')}))""",
}
