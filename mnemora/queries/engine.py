"""Indexed search, spectral groups, density matrices, the schedule, registered stages and intake by a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemora import workspace
from mnemora.functions import text as T
from mnemora.operators import lexical as L
from mnemora.operators import scoring
from mnemora.operators import spectral as S
from mnemora.operators import store as O
from mnemora.plans.registry import Registry, due_jobs
from mnemora.queries.analytics import _N as _NODES
from mnemora.queries.analytics import nodes
from mnemora.queries.similarity import _N, _asked, _nodes
from mnemora.queries.store import SQL as _STORE
from mnemora.sources.tables import table
from mnemora.streaming import events as st


def _first(n):
    return n.where("id < 8").select(F.col("id").alias("shard"), "vector")


def ann_topk(s, d):
    """The ten most similar vectors in the three nearest of eight cells, about fixed centres so that SQL can follow."""
    n = _nodes(s, d).select("id", "vector")
    return S.indexed_topk(n, _asked(_nodes(s, d)).select("query_id", "vector"), _first(n), 10, probes=3)


def ann_recall(s, d):
    """Share of the true ten most similar vectors that the cells give, over all queries, by how many cells are looked into."""
    n, q = _nodes(s, d).select("id", "vector"), _asked(_nodes(s, d)).select("query_id", "vector")
    true = workspace.materialise(scoring.topk(n, q, 10, kernel="cosine").select("query_id", "id"), "true")
    out = None
    for p in (1, 3, 6, 8):
        hit = S.indexed_topk(n, q, _first(n), 10, probes=p).select("query_id", "id", F.lit(1).alias("hit"))
        r = true.join(hit, ["query_id", "id"], "left").agg(F.lit(p).alias("probes"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
        out = r if out is None else out.unionByName(r)
    return out


def density_matrix(s, d):
    """Purity of each label's density matrix: one over the number of directions its vectors spread over."""
    return S.density(table(s, d, "embeddings").select("label", F.col("embedding").alias("vector")), "label").select("label", "n", F.round("purity", 6).alias("purity"))


def spectral_groups(s, d):
    """Vectors in four groups by the spectrum of their ten-neighbour graph: the sizes."""
    g = S.power_groups(S.affinity(_nodes(s, d).select("id", "vector"), 10), 4)
    return g.groupBy("cluster").agg(F.count("*").alias("n"))


def schedule(s, d):
    """Jobs due while a table grows by a node a step, by job."""
    steps = s.range(1, 3001).select(F.col("id").alias("step"), F.col("id").alias("nodes"))
    return due_jobs(steps).groupBy("job").agg(F.count("*").alias("n"), F.max("step").alias("last"))


def registered_stages(s, d):
    """Two stages of a user's own between retrieval and the answer."""
    r = Registry().register("retrieve", lambda n: scoring.topk(n, _asked(_nodes(s, d)), 10)).register("others", lambda x: x.where("id <> query_id")).register("firm", lambda x: x.where("score >= 0.1"))
    return r.run(_nodes(s, d), ["retrieve", "others", "firm"])


def stream_ingest(s, d):
    """Vectors taken in by a stream, a few files a batch, each batch as ``add_nodes_batch`` takes it."""
    path, out, check = (workspace.new_dir(s, k) for k in ("stream-in", "stream-out", "stream-state"))
    rows = table(s, d, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("node_id"), F.lit("text of a vector").alias("text"), F.col("embedding").alias("vector"), F.element_at(F.array(*map(F.lit, ("text", "code", "vision", "smell"))), (F.pmod("vec_id", F.lit(4)) + 1).cast("int")).alias("modality"))
    rows.repartition(4, "node_id").write.parquet(path)

    def take(batch, number):
        O.ingest(batch, now=1000.0, normalise=True).write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that is run again takes its own place

    st.file_stream(s, path, rows.schema, files=2).writeStream.foreachBatch(take).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out).select("node_id", "modality", *(F.round(c, 6).alias(c) for c in ("salience", "amplitude", "phase")))


def sentence_rerank(s, d):
    """The ten best lexical documents of a question again, by .6 of their score over the greatest and .4 of their best sentence's cosine of words."""
    docs, asked = table(s, d, "documents").select("doc_id", "text"), table(s, d, "eval_items").where("item_id % 100 = 0").select("item_id", "query")
    top = L.ranked(L.bm25(docs, asked, doc_key="doc_id", doc_text="text", query_key="item_id", query_text="query"), 10)
    words = lambda c: F.array_distinct(T.tokens(c))
    parts = top.join(docs, "doc_id").select("query_id", "doc_id", "score", F.explode(F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda x: F.length(x) > 5)).alias("sentence"))
    q = asked.select(F.col("item_id").alias("query_id"), words("query").alias("q"))
    j = parts.join(q, "query_id").select("query_id", "doc_id", "score", words("sentence").alias("w"), "q")
    near = F.size(F.array_intersect("q", "w")) / F.sqrt(F.greatest(F.size("q") * F.size("w"), F.lit(1)).cast("double"))
    best = j.groupBy("query_id", "doc_id", "score").agg(F.max(near).alias("near"))
    return L.ranked(best.select("query_id", "doc_id", (0.6 * L.by_max("score") + 0.4 * F.col("near")).alias("score")), 10, digits=5)


def swarm_vote(s, d):
    """Toxic or not by the raters' votes, each weighed by how near the rater's ratings of quality lie to the others'."""
    r = table(s, d, "doc_labels").select("doc_id", "rater", "quality", "toxic")
    mean = r.where("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("m"))
    rep = workspace.materialise(r.where("quality is not null").join(mean, "doc_id").groupBy("rater").agg((1 / (1 + F.avg(F.abs(F.col("quality") - F.col("m"))))).alias("rep")), "raters")
    v = r.where("toxic is not null").join(L.small(rep), "rater").groupBy("doc_id").agg((F.sum(F.col("rep") * F.col("toxic")) / F.sum("rep")).alias("share"))
    return v.select("doc_id", F.round("share", 6).alias("share"), (F.col("share") > 0.5).alias("toxic"))


def encrypted_roundtrip(s, d):
    """Contents written encrypted under a key that is given, and read back: their digests."""
    key, path = F.lit("0123456789abcdef"), workspace.new_dir(s, "sealed")  # a caller passes its own key
    n = nodes(s, d).where("content is not null").select("node_id", F.aes_encrypt("content", key).alias("sealed"))
    n.write.parquet(path)
    return s.read.schema("node_id string, sealed binary").parquet(path).select("node_id", F.md5(F.aes_decrypt("sealed", key)).alias("md5"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

from mnemora.queries.lexical import _BASE, _BM, _T, _rank  # noqa: E402

_CELLS = f"""{_N}, c AS (SELECT id AS cell, v FROM n WHERE id < 8), r AS (SELECT n.id, c.cell, row_number() OVER (PARTITION BY n.id ORDER BY round(list_distance(n.v, c.v), 6), c.cell) AS k FROM n, c),
cs AS (SELECT query_id, id, round(dp / (nv * nq), 6) AS score FROM p)"""
_IN = "SELECT cs.query_id, cs.id, score, row_number() OVER (PARTITION BY cs.query_id ORDER BY score DESC, cs.id) AS rank FROM cs JOIN r x ON x.id = cs.id AND x.k = 1 JOIN r y ON y.id = cs.query_id AND y.cell = x.cell AND y.k <= {0}"
SQL = {
    "ann_topk": f"WITH {_CELLS} SELECT * FROM ({_IN.format(3)}) WHERE rank <= 10",
    "ann_recall": f"WITH {_CELLS}, t AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM cs) WHERE k <= 10) "
    + " UNION ALL ".join(f"SELECT {p} AS probes, round(count(h.id) / count(*), 6) AS recall FROM t LEFT JOIN (SELECT * FROM ({_IN.format(p)}) WHERE rank <= 10) h ON h.query_id = t.query_id AND h.id = t.id" for p in (1, 3, 6, 8)),
    "density_matrix": """WITH v AS (SELECT label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), g AS (SELECT x.label, sum(pow(list_inner_product(x.v, y.v), 2)) AS s FROM v x JOIN v y ON x.label = y.label GROUP BY x.label),
        t AS (SELECT label, count(*) AS n, sum(list_inner_product(v, v)) AS t FROM v GROUP BY label) SELECT label, n, round(s / (t * t), 6) AS purity FROM g JOIN t USING (label)""",
    "schedule": """WITH s AS (SELECT unnest(range(1, 3001)) AS step), j AS (SELECT step, 'decay' AS job FROM s UNION ALL SELECT step, 'prune' FROM s WHERE step % 10 = 0 UNION ALL SELECT step, 'topology' FROM s WHERE step % 50 = 0
        UNION ALL SELECT step, 'consolidate' FROM s WHERE step % CASE WHEN step >= 2000 THEN 20 WHEN step >= 500 THEN 50 ELSE 100 END = 0) SELECT job, count(*) AS n, max(step) AS last FROM j GROUP BY job""",
    "registered_stages": f"""WITH {_N}, x AS (SELECT query_id, id, round(exp(-d2 / 2) * CAST(amplitude AS DOUBLE) * CAST(salience AS DOUBLE), 6) AS score FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x)
        SELECT * FROM r WHERE rank <= 10 AND id <> query_id AND score >= 0.1""",
    "sentence_rerank": f"""WITH {_BASE}, t AS ({_rank('bm')}), sn AS (SELECT query_id, doc_id, score, unnest(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1))) AS sentence FROM t JOIN documents USING (doc_id)),
        sw AS (SELECT sn.query_id, doc_id, score, list_distinct({_T('sentence')}) AS w, list_distinct({_T('query')}) AS q FROM sn JOIN eval_items ON item_id = sn.query_id WHERE length(sentence) > 5),
        b AS (SELECT query_id, doc_id, score, max(len(list_intersect(q, w)) / sqrt(greatest(len(q) * len(w), 1))) AS near FROM sw GROUP BY ALL), z AS (SELECT query_id, doc_id, 0.6::DOUBLE * {_BM} + 0.4::DOUBLE * near AS score FROM b) {_rank('z', 5)}""",
    "swarm_vote": """WITH m AS (SELECT doc_id, avg(quality) AS m FROM doc_labels WHERE quality IS NOT NULL GROUP BY doc_id), p AS (SELECT rater, 1 / (1 + avg(abs(quality - m))) AS rep FROM doc_labels JOIN m USING (doc_id) WHERE quality IS NOT NULL GROUP BY rater),
        v AS (SELECT doc_id, sum(rep * toxic) / sum(rep) AS share FROM doc_labels JOIN p USING (rater) WHERE toxic IS NOT NULL GROUP BY doc_id) SELECT doc_id, round(share, 6) AS share, share > 0.5 AS toxic FROM v""",
    "encrypted_roundtrip": f"WITH {_NODES} SELECT node_id, md5(content) AS md5 FROM nodes WHERE content IS NOT NULL",
    "stream_ingest": _STORE["add_nodes_batch"],
}
