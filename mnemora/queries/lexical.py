"""Lexical search and text rules over whole texts; every hundredth held-out item asks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemora.functions import text as T
from mnemora.operators import lexical as L
from mnemora.operators import ranks
from mnemora.sources.tables import table

_KEYS = {"doc_key": "doc_id", "doc_text": "text", "query_key": "item_id", "query_text": "query"}


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text", "source")


def _asked(s, d):
    return table(s, d, "eval_items").where("item_id % 100 = 0").select("item_id", "query")


def bm25_topk(s, d):
    return L.ranked(L.bm25(_docs(s, d), _asked(s, d), **_KEYS), 10)


def bm25_binary_topk(s, d):
    return L.ranked(L.bm25(_docs(s, d), _asked(s, d), binary=True, **_KEYS).where("score >= 0.1"), 10)


def sparse_dot(s, d):
    return L.ranked(L.sparse_dot(_docs(s, d), _asked(s, d), **_KEYS), 10)


def token_df_idf(s, d):
    t = _docs(s, d).select(F.explode(F.array_distinct(T.tokens("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = _docs(s, d).agg(F.count("*").alias("n"))
    return t.crossJoin(F.broadcast(n)).select("term", "df", F.round(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 6).alias("idf"))


def hybrid_minmax(s, d):
    """Two lexical scores over their ranges, from one set of postings; the hybrid with vectors is ``rocchio_hybrid``."""
    cut, q = L.tokenised(_docs(s, d), "doc_id", "text"), L.query_terms(_asked(s, d), "item_id", "query")
    p = L.postings(cut, q)
    return L.ranked(L.fuse({"bm25": (L.bm25_of(cut, q, p=p), 0.7), "dot": (L.sparse_dot_of(p, q), 0.3)}, L.minmax), 10, digits=5)


def pmi_pairs(s, d):
    return L.pmi(_docs(s, d), "text").select("a", "b", "n", F.round("pmi", 5).alias("pmi"))


def query_expand_pmi(s, d):
    return L.expansions(L.pmi(_docs(s, d), "text"), _asked(s, d), "item_id", "query").withColumn("weight", F.round("weight", 5))


def rank_agreement(s, d):
    """Share of concordant pairs among the documents two rankings have in common, and their overlap."""
    a, b = bm25_topk(s, d), sparse_dot(s, d)
    both = a.select("query_id", "doc_id", F.col("rank").alias("ra")).join(b.select("query_id", "doc_id", F.col("rank").alias("rb")), ["query_id", "doc_id"])
    x, y = both.alias("x"), both.alias("y")
    pairs = x.join(y, (F.col("x.query_id") == F.col("y.query_id")) & (F.col("x.ra") < F.col("y.ra")))
    con = pairs.groupBy(F.col("x.query_id").alias("query_id")).agg(F.round(F.avg((F.col("x.rb") < F.col("y.rb")).cast("double")), 6).alias("concordance"))
    n = both.groupBy("query_id").agg(F.count("*").alias("common"))
    return n.join(con, "query_id", "left")


def chunk_words(s, d):
    c = _docs(s, d).select("doc_id", F.posexplode(T.chunk_words("text", 100, 20)).alias("chunk", "t"))
    return c.select("doc_id", "chunk", F.md5("t").alias("md5"))


def html_strip(s, d):
    return _docs(s, d).where("text like '%<%'").select("doc_id", F.md5(T.strip_tags("text")).alias("md5"))


def context_header(s, d):
    return table(s, d, "eval_items").select("item_id", T.header("context").alias("header"))


def token_estimates(s, d):
    return _docs(s, d).where("text is not null").groupBy("source").agg(F.sum(T.token_estimate("text")).alias("tokens"))


def token_budget_cut(s, d):
    """The documents of each source that fit a budget in order, ended by the first that does not."""
    t = _docs(s, d).where("text is not null").select("source", "doc_id", T.token_estimate("text").alias("t"))
    return ranks.running(t, ["source"], ["doc_id"], "t", "used").where("used <= 2000").select("source", "doc_id", "used")


def dedup_prefix5(s, d):
    """The first document of each key: five leading words, or all of fewer than three."""
    plain = F.regexp_replace(F.lower("text"), r"[^a-zа-яё0-9\s]", "")
    w = T.words(plain)
    key = F.when(F.size(w) < 3, plain).otherwise(F.array_join(F.slice(w, 1, 5), " "))
    return _docs(s, d).where("text is not null").groupBy(key.alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


def emotion_classify(s, d):
    return table(s, d, "eval_items").select("item_id", T.emotion("query").alias("emotion"))


def tags_detect(s, d):
    c = table(s, d, "chat_messages").where("content is not null").select("content").withColumn("tag", F.explode(T.tags("content")))
    return c.groupBy("tag").agg(F.count("*").alias("n"))


def tier_detect(s, d):
    return _docs(s, d).where("text is not null").groupBy(T.memory_tier("text").alias("tier")).agg(F.count("*").alias("n"))


def modality_detect(s, d):
    return _docs(s, d).where("text is not null").groupBy(T.modality("text").alias("modality")).agg(F.count("*").alias("n"))


def query_kinds(s, d):
    return table(s, d, "eval_items").select("item_id", T.query_kind("query").alias("kind"))


def cascade_route(s, d):
    return table(s, d, "eval_items").groupBy(T.cascade_route("query").alias("route")).agg(F.count("*").alias("n"))


def security_scan(s, d):
    return _docs(s, d).where("text is not null").select("doc_id", F.explode(T.injections("text")).alias("violation"))


def sentence_counts(s, d):
    n = F.size(F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda x: F.length(x) > 5))
    return _docs(s, d).where("text is not null").select("doc_id", n.alias("n"))


def causal_extract(s, d):
    """(doc_id, effect, cause, confidence) of the causal phrases of each sentence."""
    sent = _docs(s, d).where("length(trim(text)) >= 10").select("doc_id", F.explode(F.split("text", r"[.!?;]")).alias("s")).select("doc_id", F.trim("s").alias("s"))
    sent = sent.where(F.lower("s").rlike("because|cause|lead|due|as\\s+a|reason|therefore|thus"))  # most sentences end here
    clean = lambda p, g: F.regexp_replace(F.lower(F.trim(F.regexp_extract("s", f"(?i){p}", g))), r"[^\p{L}\p{N}_]+$", "")
    found = F.array(*(F.struct(clean(p, e).alias("effect"), clean(p, c).alias("cause")) for p, e, c in T.CAUSAL_PATTERNS))
    out = sent.select("doc_id", F.length("s").alias("n"), F.explode(found).alias("f")).where("length(f.effect) > 3 and length(f.cause) > 3")
    return out.select("doc_id", "f.effect", "f.cause", F.round(F.greatest(F.lit(0.5), 1 - F.col("n") / 200.0), 4).alias("confidence"))


def answer_overlap(s, d):
    """Token-set shares of answer, query and context: the evaluator's faithfulness, relevance and coverage."""
    e = table(s, d, "rubq_records").select("rec_id", *(F.array_distinct(T.tokens(c)).alias(c) for c in ("query", "answer", "context")))
    share = lambda a, b: F.round(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)), 6)
    return e.select("rec_id", share("answer", "context").alias("grounded"), share("query", "context").alias("relevant"))


def repeats_jaccard(s, d):
    """Neighbouring chat turns of a session whose word sets agree in at least nine tenths."""
    c = table(s, d, "chat_messages").where("content is not null and session_id is not null").select("msg_id", "session_id", "turn", "content").distinct()
    w = Window.partitionBy("session_id").orderBy("turn", "msg_id", "content")
    t = c.withColumn("a", F.array_distinct(T.tokens("content"))).withColumn("b", F.lag("a").over(w)).where("b is not null and size(a) > 0")
    j = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    return t.where(j >= 0.9).select("msg_id")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_TOK = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')"
_T = lambda c: _TOK.format(c=c)
_BASE = f"""q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_T('query')}) AS term FROM eval_items WHERE item_id % 100 = 0) GROUP BY ALL),
d AS (SELECT doc_id, len(coalesce({_T('text')}, [])) AS n, {_T('text')} AS t FROM documents),
st AS (SELECT count(*) AS docs, avg(n) AS mean FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT p.*, q.query_id, q.qtf, ln((docs - df + 0.5) / (df + 0.5) + 1) AS idf, mean FROM p JOIN q USING (term) JOIN f USING (term), st),
bm AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * greatest(n, 1) / greatest(mean, 1.0)))) AS score FROM w GROUP BY ALL),
bb AS (SELECT query_id, doc_id, sum(qtf * idf * 2.5::DOUBLE / (1 + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * greatest(n, 1) / greatest(mean, 1.0)))) AS score FROM w GROUP BY ALL),
sd AS (SELECT query_id, doc_id, CAST(sum(qtf * tf) AS DOUBLE) AS score FROM w GROUP BY ALL)"""


def _rank(source: str, digits: int = 6, k: int = 10) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(score, {digits}) AS score FROM {source})) WHERE rank <= {k}"


_MM = "(score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id) + 1e-8)"
_BM = "score / greatest(max(score) OVER (PARTITION BY query_id), 1e-12)"
_PMI = f"""tk AS (SELECT doc_id, unnest({_T('text')}) AS term, generate_subscripts({_T('text')}, 1) AS pos FROM documents),
c AS (SELECT term, count(*) AS c FROM tk GROUP BY term),
pr AS (SELECT least(x.term, y.term) AS a, greatest(x.term, y.term) AS b, count(*) AS n FROM tk x JOIN tk y ON x.doc_id = y.doc_id AND y.pos > x.pos AND y.pos <= x.pos + 5 WHERE x.term <> y.term GROUP BY ALL HAVING count(*) >= 3),
pm AS (SELECT a, b, n, greatest(0.0, ln(n + 1e-8::DOUBLE) + ln((SELECT sum(c) FROM c)) - ln(ca.c) - ln(cb.c)) AS pmi FROM pr JOIN c ca ON ca.term = a JOIN c cb ON cb.term = b)"""
_WORDS = "list_filter(regexp_split_to_array({c}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"


def _any(c: str, needles: list[str]) -> str:
    return "(" + " OR ".join("contains(lower({}), '{}')".format(c, n.replace("'", "''")) for n in needles) + ")"


def _case(c: str, table_: list, last: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(c, n)} THEN '{k}'" for k, n in table_) + f" ELSE '{last}' END"


def _part(pattern: str, group: int) -> str:
    return f"regexp_replace(lower(trim(regexp_extract(s, '(?i){pattern}', {group}))), '[^\\p{{L}}\\p{{N}}_]+$', '')"


_KIND = "CASE WHEN regexp_matches(lower(query), '\\b({})\\b') THEN 'causal' WHEN regexp_matches(lower(query), '\\b({})\\b') THEN 'factual' ELSE 'ambiguous' END".format("|".join(T.CAUSAL_CUES), "|".join(T.FACTUAL_CUES))
_EST = "CAST(greatest(1, floor(length(text) / CASE WHEN regexp_matches(text, '[\\x{0400}-\\x{04FF}]') THEN 6 ELSE 4 END)) AS INT)"
_CLEAN = "translate(regexp_replace(lower(text), '[\\x{200b}-\\x{200f}\\x{2060}\\x{feff}\\x{00ad}]', '', 'g'), 'аеорсхіјѕ', 'aeopcxijs')"
_MOD = "CASE " + " ".join("WHEN " + " OR ".join("regexp_matches(lower(text), '{}')".format(p) for p in ps) + f" THEN '{k}'" for k, ps in T.MODALITIES) + " ELSE 'text' END"
SQL = {
    "bm25_topk": f"WITH {_BASE} {_rank('bm')}",
    "bm25_binary_topk": f"WITH {_BASE} {_rank('(SELECT * FROM bb WHERE score >= 0.1)')}",
    "sparse_dot": f"WITH {_BASE} {_rank('sd')}",
    "token_df_idf": f"""WITH t AS (SELECT unnest(list_distinct({_T('text')})) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
        SELECT term, count(*) AS df, round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM t, n GROUP BY term""",
    "hybrid_minmax": f"""WITH {_BASE}, u AS (SELECT query_id, doc_id, 0.7::DOUBLE * {_MM} AS s FROM bm UNION ALL SELECT query_id, doc_id, 0.3::DOUBLE * {_MM} AS s FROM sd),
        z AS (SELECT query_id, doc_id, sum(s) AS score FROM u GROUP BY ALL) {_rank('z', 5)}""",
    "pmi_pairs": f"WITH {_PMI} SELECT a, b, n, round(pmi, 5) AS pmi FROM pm",
    "query_expand_pmi": f"""WITH {_PMI}, q AS (SELECT DISTINCT item_id AS query_id, unnest({_T('query')}) AS term FROM eval_items WHERE item_id % 100 = 0),
        b2 AS (SELECT a AS term, b AS other, pmi FROM pm WHERE pmi >= 0.5 UNION ALL SELECT b, a, pmi FROM pm WHERE pmi >= 0.5),
        z AS (SELECT q.query_id, other AS doc_id, sum(pmi) AS score FROM b2 JOIN q USING (term) WHERE NOT EXISTS (SELECT 1 FROM q x WHERE x.query_id = q.query_id AND x.term = other) GROUP BY ALL)
        SELECT query_id, doc_id AS term, round(score, 5) AS weight, rank FROM ({_rank('z', 6, 3)})""",
    "rank_agreement": f"""WITH {_BASE}, a AS ({_rank('bm')}), b AS ({_rank('sd')}), c AS (SELECT a.query_id, a.doc_id, a.rank AS ra, b.rank AS rb FROM a JOIN b USING (query_id, doc_id)),
        k AS (SELECT x.query_id, round(avg(CAST(x.rb < y.rb AS DOUBLE)), 6) AS concordance FROM c x JOIN c y ON x.query_id = y.query_id AND x.ra < y.ra GROUP BY 1)
        SELECT n.query_id, common, concordance FROM (SELECT query_id, count(*) AS common FROM c GROUP BY 1) n LEFT JOIN k USING (query_id)""",
    "chunk_words": f"""WITH w AS (SELECT doc_id, {_WORDS.format(c='text')} AS w FROM documents WHERE text IS NOT NULL),
        c AS (SELECT doc_id, w, unnest(range(0, len(w), 80)) AS i FROM w) SELECT doc_id, CAST(i // 80 AS INT) AS chunk, md5(array_to_string(w[i + 1 : i + 100], ' ')) AS md5 FROM c""",
    "html_strip": """SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS md5 FROM documents WHERE text LIKE '%<%'""",
    "context_header": f"""WITH h AS (SELECT item_id, trim(split_part(context, '.', 1)) AS f, {_WORDS.format(c='context')} AS w FROM eval_items)
        SELECT item_id, CASE WHEN len({_WORDS.format(c='f')}) <= 15 THEN f ELSE array_to_string(w[1:12], ' ') || '...' END AS header FROM h""",
    "token_estimates": f"SELECT source, CAST(sum({_EST}) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL GROUP BY source",
    "token_budget_cut": f"SELECT * FROM (SELECT source, doc_id, CAST(sum({_EST}) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents WHERE text IS NOT NULL) WHERE used <= 2000",
    "dedup_prefix5": f"""WITH p AS (SELECT doc_id, regexp_replace(lower(text), '[^a-zа-яё0-9 \\t\\n\\x0B\\f\\r]', '', 'g') AS p FROM documents WHERE text IS NOT NULL),
        w AS (SELECT doc_id, p, {_WORDS.format(c='p')} AS w FROM p) SELECT min(doc_id) AS doc_id FROM w GROUP BY CASE WHEN len(w) < 3 THEN p ELSE array_to_string(w[1:5], ' ') END""",
    "emotion_classify": f"SELECT item_id, {_case('query', T.EMOTIONS, 'neutral')} AS emotion FROM eval_items",
    "tags_detect": """WITH t AS (SELECT list_filter([
          CASE WHEN regexp_matches(l, 'hello|hi |hey|привет|здравствуй|hi,|hey,') THEN 'greeting' END, CASE WHEN regexp_matches(l, 'my name is|i''m |i am |меня зовут|мое имя') THEN 'name' END,
          CASE WHEN regexp_matches(l, 'code|program|python|java|функци|код|програм') THEN 'coding' END, CASE WHEN regexp_matches(l, 'coffee|tea|food|drink|кофе|чай|еда') THEN 'food_drink' END,
          CASE WHEN regexp_matches(l, 'love|like|prefer|enjoy|люб|нрав|предпочита') THEN 'preference' END, CASE WHEN regexp_matches(l, 'work|job|career|работ|карьер|професс') THEN 'work' END,
          CASE WHEN regexp_matches(l, 'live|city|country|home|жив|город|стран|дом') THEN 'location' END, CASE WHEN regexp_matches(l, 'family|friend|dog|cat|pet|семь|друг|собак|кот|питом') THEN 'relationships' END],
          lambda x: x IS NOT NULL)[1:5] AS tags FROM (SELECT lower(content) AS l FROM chat_messages WHERE content IS NOT NULL))
        SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM t) GROUP BY tag""",
    "tier_detect": f"""SELECT CASE WHEN {_any('text', T.PROCEDURAL)} THEN 'procedural' WHEN regexp_matches(text, '\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{2}}/\\d{{2}}/\\d{{4}}') OR {_any('text', T.EPISODIC)} THEN 'episodic' ELSE 'semantic' END AS tier,
        count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL""",
    "modality_detect": f"SELECT {_MOD} AS modality, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL",
    "query_kinds": f"SELECT item_id, {_KIND} AS kind FROM eval_items",
    "cascade_route": f"SELECT CASE {_KIND} WHEN 'factual' THEN 'fast' WHEN 'ambiguous' THEN 'standard' ELSE 'deep' END AS route, count(*) AS n FROM eval_items GROUP BY ALL",
    "security_scan": " UNION ALL ".join(f"SELECT doc_id, '{p}' AS violation FROM documents WHERE regexp_matches({_CLEAN}, '{p}')" for p in T.INJECTIONS) + " UNION ALL SELECT doc_id, 'too long' FROM documents WHERE length(text) > 10000",
    "sentence_counts": """SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 5)) AS INT) AS n
        FROM documents WHERE text IS NOT NULL""",
    "causal_extract": "WITH s AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[.!?;]'))) AS s FROM documents WHERE length(trim(text)) >= 10), t AS (SELECT * FROM s WHERE regexp_matches(lower(s), 'because|cause|lead|due|as\\s+a|reason|therefore|thus')), f AS ("
    + " UNION ALL ".join(f"SELECT doc_id, length(s) AS n, {_part(p, e)} AS effect, {_part(p, c)} AS cause FROM t" for p, e, c in T.CAUSAL_PATTERNS)
    + ") SELECT doc_id, effect, cause, round(greatest(0.5::DOUBLE, 1 - n / 200.0::DOUBLE), 4) AS confidence FROM f WHERE length(effect) > 3 AND length(cause) > 3",
    "answer_overlap": f"""WITH e AS (SELECT rec_id, list_distinct(coalesce({_T('query')}, [])) AS q, list_distinct(coalesce({_T('answer')}, [])) AS a, list_distinct(coalesce({_T('context')}, [])) AS c FROM rubq_records)
        SELECT rec_id, round(len(list_intersect(a, c)) / greatest(len(a), 1), 6) AS grounded, round(len(list_intersect(q, c)) / greatest(len(q), 1), 6) AS relevant FROM e""",
    "repeats_jaccard": f"""WITH c AS (SELECT DISTINCT msg_id, session_id, turn, content FROM chat_messages WHERE content IS NOT NULL AND session_id IS NOT NULL),
        t AS (SELECT msg_id, list_distinct({_T('content')}) AS a, lag(list_distinct({_T('content')})) OVER (PARTITION BY session_id ORDER BY turn, msg_id, content) AS b FROM c)
        SELECT msg_id FROM t WHERE b IS NOT NULL AND len(a) > 0 AND len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.9""",
}
