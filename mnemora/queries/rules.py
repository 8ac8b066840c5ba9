"""Rules over questions, answers and contexts, evaluation of answers, and summaries of events and feedback."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemora.functions import rules as U
from mnemora.functions import text as T
from mnemora.operators import analytics as A
from mnemora.operators import lexical as L
from mnemora.operators import ranks
from mnemora.queries.analytics import _N, nodes
from mnemora.sources.tables import table

#: A short list of stop words (fixed values); callers pass their own.
STOP = ("the", "and", "for", "that", "this", "with", "from", "was", "are", "что", "как", "это", "для", "не")


def _items(s, d):
    return table(s, d, "eval_items")


def intent_classify(s, d):
    return _items(s, d).select("item_id", U.intent("query").alias("intent"))


def strategy_classify(s, d):
    return _items(s, d).select("item_id", U.strategy("query").alias("strategy"))


def query_decompose(s, d):
    q = F.when(F.col("item_id") % 5 == 0, F.concat(F.lit("Compare "), "topic", F.lit(" to "), "dataset", F.lit("?"))).when(F.col("item_id") % 5 == 1, F.concat("query", F.lit(" and "), "answer")).otherwise(F.col("query"))
    return _items(s, d).select("item_id", F.posexplode(U.decompose(q)).alias("part", "question"))


def query_rewrite(s, d):
    """Questions with up to three words of over three characters that their context has and they have not, in the order of the words."""
    words = lambda c: F.array_distinct(T.words(F.lower(c)))
    more = F.slice(F.array_sort(F.filter(F.array_except(words("context"), words("query")), lambda w: F.length(w) > 3)), 1, 3)
    return _items(s, d).select("item_id", F.when(F.size(more) > 0, F.concat("query", F.lit(" ("), F.array_join(more, " "), F.lit(")"))).otherwise(F.col("query")).alias("rewritten"))


def query_expand_context(s, d):
    """Three most frequent content words of a question's topic that it has not itself."""
    e = _items(s, d).where("topic is not null")
    words = e.select("topic", F.explode(U.tokens_plain("context", STOP)).alias("term")).groupBy("topic", "term").agg(F.count("*").alias("n"))
    own = e.select("item_id", "topic", F.array_distinct(U.tokens_plain("query", STOP)).alias("own"))
    j = own.join(words, "topic").where(~F.array_contains("own", F.col("term")))
    w = Window.partitionBy("item_id").orderBy(F.desc("n"), "term")
    return j.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("item_id", "term", "n", "rank")


def tokenize_plain(s, d):
    t = table(s, d, "documents").select("doc_id", U.tokens_plain("text", STOP).alias("t"))
    return t.select("doc_id", F.size(F.coalesce("t", F.array().cast("array<string>"))).alias("n"), F.md5(F.array_join(F.coalesce("t", F.array().cast("array<string>")), " ")).alias("md5"))


def tokenize_wide(s, d):
    t = table(s, d, "documents").select("doc_id", U.tokens_wide("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("md5"))


def bm25_every(s, d):
    """Scores of all documents, those without a shared word included: how many of each question are 0, and the mean."""
    docs, asked = table(s, d, "documents").select("doc_id", "text"), _items(s, d).where("item_id % 100 = 0").select("item_id", "query")
    b = L.bm25_all(docs, asked, doc_key="doc_id", doc_text="text", query_key="item_id", query_text="query")
    return b.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") == 0).alias("none"), F.round(F.avg("score"), 5).alias("mean"))


def semantic_phase(s, d):
    """Phase of each node from its session, first words and modality."""
    n = nodes(s, d).select("node_id", U.phase_key("session", "content", "modality", STOP).alias("key"))
    return n.select("node_id", F.round(U.phase_of("key"), 3).alias("phase"))


def tag_index(s, d):
    """Nodes of each tag: how many, and the first and the last of them."""
    n = nodes(s, d).where("content is not null").select("node_id", F.explode(T.tags("content")).alias("tag"))
    return n.groupBy("tag").agg(F.count("*").alias("n"), F.min("node_id").alias("first"), F.max("node_id").alias("last"))


def role_relevance(s, d):
    """The two most relevant roles for each asking node: its own 1, the default .5, others .1."""
    roles = nodes(s, d).where("role is not null").select(F.col("role").alias("shard")).distinct()
    asked = nodes(s, d).where(F.col("node_id").endswith("00")).select("node_id", "role")
    r = F.when(F.col("role") == F.col("shard"), 1.0).when(F.col("shard") == "default", 0.5).otherwise(0.1)
    j = asked.crossJoin(L.small(roles)).withColumn("relevance", r)  # a row a role
    w = Window.partitionBy("node_id").orderBy(F.desc("relevance"), "shard")
    return j.withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("node_id", "shard", "relevance", "rank")


def context_format(s, d):
    """Contexts of sessions as weighed lines, by salience, ten at most, which is the format's limit: as digests."""
    w = Window.partitionBy("session").orderBy(F.desc("salience"), "node_id")
    n = nodes(s, d).where("session is not null and salience is not null").withColumn("place", F.row_number().over(w)).where("place <= 10")
    line = U.attention_line("salience", "salience", "tier", "content")
    c = n.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]), "\n").alias("c"))
    return c.select("session", F.length("c").alias("chars"), F.md5("c").alias("md5"))


def context_parse(s, d):
    """Contexts of three weighed lines read back, and of plain lines."""
    n = nodes(s, d).where("content is not null and trim(content) <> '' and salience is not null and tier is not null").where(~F.col("content").contains("[ATTN"))
    one = U.attention_line("salience", "salience", "tier", F.trim(F.regexp_replace("content", r"\s+", " ")))
    both = F.when(F.col("node_id").endswith("5"), F.regexp_replace("content", r"\s*\n\s*", "\n")).otherwise(F.concat(one, F.lit("\n"), one))
    p = n.select("node_id", F.explode(U.attention_parts(both)).alias("p"))
    return p.groupBy("node_id").agg(F.count("*").alias("parts"), F.round(F.sum("p.weight"), 4).alias("weight"), F.sum(F.length("p.text")).alias("chars"))


def sanitize(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.md5(U.sanitised("text", 1000)).alias("md5"))


def answer_eval(s, d):
    """Answers of the records, by the query as the answer given: words met, named in the context, and made up; over all by topic."""
    words = lambda c: F.filter(F.array_distinct(T.words(F.lower(F.coalesce(F.col(c), F.lit(""))))), lambda w: F.length(w) > 3)
    e = table(s, d, "rubq_records").select("topic", words("answer").alias("e"), words("query").alias("a"), F.lower(F.coalesce("context", F.lit(""))).alias("c"))
    e = e.withColumn("cw", F.array_distinct(T.words("c")))
    exact = F.when((F.size("e") > 0) & (F.size("a") > 0), F.size(F.array_intersect("e", "a")) / F.size("e")).otherwise(0.0)
    named = F.exists("e", lambda w: F.col("c").contains(w))
    made_up = F.size(F.array_except(F.array_except("a", "cw"), "e")) / F.greatest(F.size("a"), F.lit(1))
    return e.groupBy("topic").agg(F.count("*").alias("n"), F.round(F.avg(exact), 5).alias("exact"), F.round(F.avg(named.cast("double")), 5).alias("named"), F.round(F.avg(made_up), 5).alias("made_up"))


def rag_metrics(s, d):
    """Six measures of each record's answer and context, and their weighted sum."""
    tok = lambda c: F.array_distinct(T.tokens(c))
    e = table(s, d, "rubq_records").select("rec_id", tok("query").alias("q"), tok("answer").alias("a"), tok("context").alias("c"), F.lower(F.coalesce("context", F.lit(""))).alias("low"), F.lower(F.coalesce("answer", F.lit(""))).alias("ans"), "topic")
    share = lambda x, y: F.when(F.size(x) == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.lit(1)))
    relevance = F.when((F.size("q") == 0) | (F.size("a") == 0), 0.0).otherwise(share("q", "a"))
    faithful = F.when(F.size("a") == 0, 0.0).when(F.size("c") == 0, 0.5).otherwise(share("a", "c"))
    temporal = T.any_of("low", U.TEMPORAL).cast("double")
    causal = F.when(F.col("topic").isNull(), 0.5).otherwise((F.col("ans").contains(F.lower("topic"))).cast("double"))
    parts = [share("q", "c"), share("a", "c"), relevance, faithful, causal, temporal]
    names = ["precision", "recall", "relevance", "faithful", "causal", "temporal"]
    total = sum((p * w for p, w in zip(parts[1:], (0.15, 0.2, 0.2, 0.15, 0.1))), parts[0] * 0.2)
    return e.select("rec_id", *(F.round(p, 6).alias(n) for p, n in zip(parts, names)), F.round(total, 6).alias("overall"))


def rag_trend(s, d):
    """Mean of the last ten records' relevance and of the ten before, by topic."""
    r = rag_metrics(s, d).join(table(s, d, "rubq_records").select("rec_id", "topic"), "rec_id")
    w = Window.partitionBy("topic").orderBy(F.desc("rec_id"))
    r = r.withColumn("place", F.row_number().over(w)).where("place <= 20")
    return r.groupBy("topic").agg(F.round(F.avg(F.when(F.col("place") <= 10, F.col("overall"))), 5).alias("recent"), F.round(F.avg(F.when(F.col("place") > 10, F.col("overall"))), 5).alias("older"))


def entropy_state(s, d):
    """State of each user's mix of events: noisy, stagnant or normal, by the entropy over the greatest possible."""
    e = A.normalised_entropy(table(s, d, "events"), "user_id", "event_type")
    return e.select("user_id", F.when(F.col("entropy") > 0.98, "noisy").when(F.col("entropy") < 0.95, "stagnant").otherwise("normal").alias("state"))


def metrics_summary(s, d):
    """Event types as stages: count, mean, median, p95 by index, most, errors and values over 20 as degraded."""
    e = table(s, d, "events")
    base = A.nearest_p95(e, "event_type", "value").join(A.percentiles(e, ["event_type"], "value").select("event_type", F.col("p50").alias("median")), "event_type")
    bad = e.groupBy("event_type").agg(F.count_if(F.col("event_id") % 17 == 0).alias("errors"), F.count_if(F.col("value") > 20).alias("degraded"))
    return base.join(bad, "event_type")


def latency_recent(s, d):
    """p50, p95 and p99 of the last thousand values of each event type."""
    e = ranks.running(table(s, d, "events").where("value is not null").select("event_type", "ts", "event_id", "value"), ["event_type"], [F.desc("ts"), F.desc("event_id")])
    return A.percentiles(e.where("place <= 1000"), ["event_type"], "value")


def feedback_recent(s, d):
    """Mean of all ratings and of the last hundred, by rater."""
    r = ranks.running(table(s, d, "doc_labels").where("quality is not null").select("rater", "doc_id", "quality"), ["rater"], [F.desc("doc_id"), "quality"])
    return r.groupBy("rater").agg(F.round(F.avg("quality"), 6).alias("mean"), F.round(F.avg(F.when(F.col("place") <= 100, F.col("quality"))), 6).alias("recent"))


def conversion_stats(s, d):
    """Purchases by day and the share of the day's users that made one."""
    e = table(s, d, "events").select(F.to_date("ts").cast("string").alias("day"), "user_id", (F.col("event_type") == "purchase").alias("bought"))
    u = e.groupBy("day", "user_id").agg(F.count_if("bought").alias("n"))
    return u.groupBy("day").agg(F.sum("n").alias("conversions"), F.round(F.avg((F.col("n") > 0).cast("double")), 6).alias("rate"))


def retrieval_report(s, d):
    """One row on all events: how many, users, mean value, share of errors."""
    return table(s, d, "events").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 5).alias("mean"), F.round(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("errors"))


def repeats_window(s, d):
    """Documents whose words agree by over .95 with one of the fifty before them in their source."""
    c = table(s, d, "documents").where("text is not null and source is not null").select(F.col("source").alias("session"), "doc_id", F.array_sort(F.array_distinct(T.tokens("text"))).alias("w")).where("size(w) > 0")
    p = ranks.running(c, ["session"], ["doc_id"])
    # documents of equal word sets meet by the set, near ones by a word among the first of the rare ends of both
    x, y = p.alias("x"), p.select("session", F.col("doc_id").alias("other"), F.col("place").alias("before"), F.col("w").alias("v")).alias("y")
    prefix = lambda c: F.slice(c, 1, F.size(c) - F.ceil(F.size(c) * 0.95).cast("int") + 1)
    a = x.withColumn("token", F.explode(prefix("w")))
    b = y.withColumn("token", F.explode(prefix("v"))).withColumn("block", F.floor(F.col("before") / 50))
    a = a.withColumn("block", F.explode(F.array(F.floor(F.col("place") / 50), F.floor(F.col("place") / 50) - 1)))
    j = a.join(b, ["session", "token", "block"]).where("before < place and before >= place - 50")
    same = F.size(F.array_intersect("w", "v")) / F.size(F.array_union("w", "v"))
    return j.where(same > 0.95).select("doc_id").distinct()


def strength_integrity(s, d):
    """Causal edges of a node to itself or of a strength outside 0 and 1, here made of the ends of the ids."""
    e = nodes(s, d).select("node_id", F.explode("causal_parents").alias("parent")).where("parent is not null").distinct()
    e = e.withColumn("strength", (F.substring("node_id", -2, 2).cast("int") - 3) / 95.0)
    fault = F.when(F.col("node_id") == F.col("parent"), "loop").when(~F.col("strength").between(0, 1), "strength")
    return e.select("node_id", "parent", fault.alias("fault")).where("fault is not null")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

from mnemora.queries.lexical import _BASE, _T, _WORDS, _any, _case  # noqa: E402
from mnemora.queries.analytics import _hash  # noqa: E402

_STOPS = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"
_B = "list_filter(" + _WORDS.format(c="regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_ \\t\\n\\x0B\\f\\r]', ' ', 'g')") + f", lambda w: length(w) > 2 AND w NOT IN {_STOPS})"
_BT = lambda c: _B.replace("{c}", c).replace("{{", "{").replace("}}", "}")
_INTENT = "CASE WHEN query IS NULL THEN 'exploratory' " + " ".join(f"WHEN regexp_matches(lower(query), '{p}') THEN '{k}'" for k, p in U.INTENTS) + " ELSE 'exploratory' END"
_LW = lambda c: f"list_filter(list_distinct({_WORDS.format(c='lower(coalesce(' + c + ', chr(32)))')}), lambda w: length(w) > 3)"
_CTRL = "regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"
_LINE = "'[ATTN:' || printf('%.2f', salience) || '][SAL:' || printf('%.2f', salience) || '][TIER:' || coalesce(tier, 'semantic') || '] ' || coalesce(content, '')"
_WS = "'[ \\t\\n\\x0B\\f\\r]+'"
_RAG = f"""r AS (SELECT rec_id, topic, list_distinct(coalesce({_T('query')}, [])) AS q, list_distinct(coalesce({_T('answer')}, [])) AS a, list_distinct(coalesce({_T('context')}, [])) AS c, lower(coalesce(context, '')) AS low, lower(coalesce(answer, '')) AS ans FROM rubq_records),
m AS (SELECT rec_id, topic, CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, c)) / len(q) END AS p, CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, c)) / len(a) END AS r, CASE WHEN len(q) = 0 OR len(a) = 0 THEN 0 ELSE len(list_intersect(q, a)) / len(q) END AS v,
  CASE WHEN len(a) = 0 THEN 0 WHEN len(c) = 0 THEN 0.5 ELSE len(list_intersect(a, c)) / len(a) END AS f, CASE WHEN topic IS NULL THEN 0.5 ELSE CAST(contains(ans, lower(topic)) AS DOUBLE) END AS k, CAST({_any('low', U.TEMPORAL)} AS DOUBLE) AS t FROM r),
g AS (SELECT rec_id, topic, round(p, 6) AS precision, round(r, 6) AS recall, round(v, 6) AS relevance, round(f, 6) AS faithful, CAST(round(k, 6) AS DOUBLE) AS causal, round(t, 6) AS temporal,
  round(p * 0.2::DOUBLE + r * 0.15::DOUBLE + v * 0.2::DOUBLE + f * 0.2::DOUBLE + k * 0.15::DOUBLE + t * 0.1::DOUBLE, 6) AS overall FROM m)"""
SQL = {
    "intent_classify": f"SELECT item_id, {_INTENT} AS intent FROM eval_items",
    "strategy_classify": "WITH s AS (SELECT item_id, " + ", ".join("(" + " + ".join(f"CAST(regexp_matches(lower(coalesce(query, '')), '{p}') AS INT)" for p in ps) + f") AS n{k}" for k, (_, ps) in enumerate(U.STRATEGIES))
        + " FROM eval_items) SELECT item_id, CASE WHEN greatest(n0, n1, n2, n3) = 0 THEN 'factual' " + " ".join(f"WHEN n{k} = greatest(n0, n1, n2, n3) THEN '{name}'" for k, (name, _) in enumerate(U.STRATEGIES)) + " END AS strategy FROM s",
    "query_decompose": f"""WITH q AS (SELECT item_id, trim(CASE WHEN item_id % 5 = 0 THEN 'Compare ' || topic || ' to ' || dataset || '?' WHEN item_id % 5 = 1 THEN query || ' and ' || answer ELSE query END) AS t FROM eval_items),
        p AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '(?i){U.PARTING}'), lambda x: trim(x)), lambda x: length(x) > 8) AS parts FROM q WHERE t IS NOT NULL AND t <> ''),
        o AS (SELECT item_id, CASE WHEN regexp_matches(lower(t), '{U.WHOLE}') THEN [t] WHEN regexp_matches(t, '{U.COMPARED}') THEN ['What is ' || trim(regexp_extract(t, '{U.COMPARED}', 1)) || '?', 'What is ' || trim(regexp_extract(t, '{U.COMPARED}', 2)) || '?']
          WHEN regexp_matches(t, '{U.DIFFERENCE}') THEN ['What is ' || trim(regexp_extract(t, '{U.DIFFERENCE}', 1)) || '?', 'What is ' || trim(regexp_extract(t, '{U.DIFFERENCE}', 2)) || '?'] WHEN len(parts) >= 2 THEN parts ELSE [t] END AS l FROM p)
        SELECT item_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS part, unnest(l) AS question FROM o""",
    "query_rewrite": f"""WITH w AS (SELECT item_id, query, {_WORDS.format(c='lower(context)')} AS c, {_WORDS.format(c='lower(query)')} AS q FROM eval_items),
        m AS (SELECT item_id, query, list_sort(list_filter(list_distinct(c), lambda x: length(x) > 3 AND NOT list_contains(q, x)))[1:3] AS m FROM w) SELECT item_id, CASE WHEN len(m) > 0 THEN query || ' (' || array_to_string(m, ' ') || ')' ELSE query END AS rewritten FROM m""",
    "query_expand_context": f"""WITH t AS (SELECT topic, term, count(*) AS n FROM (SELECT topic, unnest({_BT('context')}) AS term FROM eval_items WHERE topic IS NOT NULL) GROUP BY ALL), o AS (SELECT item_id, topic, {_BT('query')} AS own FROM eval_items WHERE topic IS NOT NULL),
        r AS (SELECT item_id, term, n, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, term) AS rank FROM o JOIN t USING (topic) WHERE NOT list_contains(own, term)) SELECT * FROM r WHERE rank <= 3""",
    "tokenize_plain": f"WITH t AS (SELECT doc_id, coalesce({_BT('text')}, []) AS t FROM documents) SELECT doc_id, CAST(len(t) AS INT) AS n, md5(array_to_string(t, ' ')) AS md5 FROM t",
    "tokenize_wide": """WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(regexp_replace(lower(text), '([\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{ac00}-\\x{d7af}])', ' \\1 ', 'g'), '[\\p{L}\\p{N}]+'), []) AS t FROM documents)
        SELECT doc_id, CAST(len(t) AS INT) AS n, md5(array_to_string(t, ' ')) AS md5 FROM t""",
    "bm25_every": f"WITH {_BASE}, e AS (SELECT query_id, doc_id, coalesce(score, 0) AS score FROM (SELECT DISTINCT item_id AS query_id FROM eval_items WHERE item_id % 100 = 0) CROSS JOIN documents LEFT JOIN bm USING (query_id, doc_id)) SELECT query_id, count(*) AS n, count(*) FILTER (score = 0) AS none, round(avg(score), 5) AS mean FROM e GROUP BY query_id",
    "semantic_phase": f"""WITH {_N}, w AS (SELECT node_id, session, modality, list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_'']+'), lambda x: length(x) > 2 AND x NOT IN {_STOPS}) AS w FROM nodes),
        u AS (SELECT *, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:3], '_') AS k FROM w),
        x AS (SELECT node_id, concat_ws('|', CASE WHEN coalesce(session, '') <> '' THEN 's:' || session END, CASE WHEN coalesce(k, '') <> '' THEN 'w:' || k END, 'm:' || coalesce(modality, 'text')) AS user_id FROM u)
        SELECT node_id, round({_hash(6283)} / 1000.0, 3) AS phase FROM x""",
    "tag_index": f"""WITH {_N}, t AS (SELECT node_id, unnest(list_filter([{", ".join(f"CASE WHEN {_any('content', n)} THEN '{k}' END" for k, n in T.TAGS)}], lambda x: x IS NOT NULL)[1:5]) AS tag FROM nodes WHERE content IS NOT NULL)
        SELECT tag, count(*) AS n, min(node_id) AS first, max(node_id) AS last FROM t GROUP BY tag""",
    "role_relevance": f"""WITH {_N}, r AS (SELECT DISTINCT role AS shard FROM nodes WHERE role IS NOT NULL), j AS (SELECT node_id, shard, CAST(CASE WHEN role = shard THEN 1.0 WHEN shard = 'default' THEN 0.5 ELSE 0.1 END AS DOUBLE) AS relevance FROM nodes, r WHERE node_id LIKE '%00')
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY relevance DESC, shard) AS rank FROM j) WHERE rank <= 2""",
    "context_format": f"""WITH {_N}, p AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY salience DESC, node_id) AS k FROM nodes WHERE session IS NOT NULL AND salience IS NOT NULL), c AS (SELECT session, string_agg({_LINE}, chr(10) ORDER BY k) AS c FROM p WHERE k <= 10 GROUP BY session)
        SELECT session, CAST(length(c) AS INT) AS chars, md5(c) AS md5 FROM c""",
    "context_parse": f"""WITH {_N}, n AS (SELECT node_id, salience, content FROM nodes WHERE content IS NOT NULL AND trim(content) <> '' AND salience IS NOT NULL AND tier IS NOT NULL AND NOT contains(content, '[ATTN')),
        l AS (SELECT node_id, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM n WHERE node_id LIKE '%5')
        SELECT node_id, 2 AS parts, round(2 * CAST(printf('%.2f', salience) AS DOUBLE), 4) AS weight, CAST(2 * length(trim(regexp_replace(content, {_WS}, ' ', 'g'))) AS BIGINT) AS chars FROM n WHERE node_id NOT LIKE '%5' AND trim(content) <> ''
        UNION ALL SELECT node_id, len(l), round(list_sum(list_transform(range(1, len(l) + 1), lambda i: 1.0::DOUBLE / i)), 4), CAST(list_sum(list_transform(l, lambda x: length(x))) AS BIGINT) FROM l WHERE len(l) > 0""",
    "sanitize": f"SELECT doc_id, md5(substr(trim({_CTRL}), 1, 1000)) AS md5 FROM documents WHERE text IS NOT NULL",
    "answer_eval": f"""WITH r AS (SELECT topic, {_LW('answer')} AS e, {_LW('query')} AS a, lower(coalesce(context, '')) AS c FROM rubq_records), w AS (SELECT *, {_WORDS.format(c='c')} AS cw FROM r)
        SELECT topic, count(*) AS n, round(avg(CASE WHEN len(e) > 0 AND len(a) > 0 THEN len(list_intersect(e, a)) / len(e) ELSE 0 END), 5) AS exact, round(avg(CAST(len(list_filter(e, lambda x: contains(c, x))) > 0 AS DOUBLE)), 5) AS named,
          round(avg(len(list_filter(a, lambda x: NOT list_contains(cw, x) AND NOT list_contains(e, x))) / greatest(len(a), 1)), 5) AS made_up FROM w GROUP BY topic""",
    "rag_metrics": f"WITH {_RAG} SELECT * EXCLUDE (topic) FROM g",
    "rag_trend": f"""WITH {_RAG}, k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY rec_id DESC) AS place FROM g) SELECT topic, round(avg(overall) FILTER (place <= 10), 5) AS recent, round(avg(overall) FILTER (place > 10 AND place <= 20), 5) AS older FROM k GROUP BY topic""",
    "entropy_state": """WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY user_id) AS p FROM c),
        h AS (SELECT user_id, CASE WHEN count(*) >= 3 THEN round(sum(-p * log2(p + 1e-10::DOUBLE)) / log2(count(*)), 6) END AS e FROM p GROUP BY user_id) SELECT user_id, CASE WHEN e > 0.98 THEN 'noisy' WHEN e < 0.95 THEN 'stagnant' ELSE 'normal' END AS state FROM h""",
    "metrics_summary": """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, list_sort(list(value))[CAST(floor(count(value) * 0.95) AS BIGINT) + 1] AS p95, max(value) AS most, round(quantile_cont(value, 0.5), 6) AS median,
        count(*) FILTER (event_id % 17 = 0) AS errors, count(*) FILTER (value > 20) AS degraded FROM events GROUP BY event_type""",
    "latency_recent": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE value IS NOT NULL)
        SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM r WHERE k <= 1000 GROUP BY event_type""",
    "feedback_recent": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY rater ORDER BY doc_id DESC, quality) AS k FROM doc_labels WHERE quality IS NOT NULL) SELECT rater, round(avg(quality), 6) AS mean, round(avg(quality) FILTER (k <= 100), 6) AS recent FROM r GROUP BY rater""",
    "conversion_stats": """WITH u AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY ALL) SELECT day, CAST(sum(n) AS BIGINT) AS conversions, round(avg(CAST(n > 0 AS DOUBLE)), 6) AS rate FROM u GROUP BY day""",
    "retrieval_report": "SELECT count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 5) AS mean, round(avg(CAST(event_type = 'error' AS DOUBLE)), 6) AS errors FROM events",
    "repeats_window": f"""WITH p AS (SELECT source AS session, doc_id, list_distinct({_T('text')}) AS w, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND len({_T('text')}) > 0)
        SELECT DISTINCT x.doc_id FROM p x JOIN p y ON x.session = y.session AND y.k < x.k AND y.k >= x.k - 50 WHERE len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) > 0.95""",
    "strength_integrity": f"""WITH {_N}, e AS (SELECT DISTINCT node_id, unnest(causal_parents) AS parent FROM nodes), f AS (SELECT *, (CAST(right(node_id, 2) AS INT) - 3) / 95.0 AS s FROM e WHERE parent IS NOT NULL)
        SELECT node_id, parent, CASE WHEN node_id = parent THEN 'loop' ELSE 'strength' END AS fault FROM f WHERE node_id = parent OR NOT (s BETWEEN 0 AND 1)""",
}
