"""The node store: reading pages and single nodes, taking nodes in, portable dumps, timelines, versions, backups.

Each is a function of tables. ``now`` is always a parameter; ties go to the
lesser id; null ids never match; empty inputs give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions import text as T
from mnemora.functions import vectors as V

TWO_PI = 6.283185307179586

#: Phase offsets of the modalities (fixed values).
OFFSETS = {"text": 0.0, "code": 0.7, "metrics": 1.4, "audio": 2.1, "vision": 2.8}


def page(df: DataFrame, key: str, *, offset: int, limit: int) -> DataFrame:
    """One page of the rows in the order of ``key``; the limit is the feature, and only offset + limit rows are kept a task."""
    return df.orderBy(key).offset(offset).limit(limit)


def newest(df: DataFrame, at: str, key: str, limit: int, **equal) -> DataFrame:
    """The newest rows of those with the given values: the limit is the feature."""
    for c, v in equal.items():
        df = df.where(F.col(c) == v)
    return df.orderBy(F.desc(at), key).limit(limit)


def ingest(rows: DataFrame, *, now: float, normalise: bool) -> DataFrame:
    """Nodes of rows (node_id, text, vector, modality): strength from the vector's length, phase from the time and the modality.

    ``normalise`` brings vectors to length 1 first, as batches do; salience is
    a twentieth of the length within .3 and 1, amplitude a fifteenth within .5
    and 1. Rows without a vector, with a text of injected instructions or
    without an id are left out.
    """
    n = V.norm("vector")
    v = F.transform(F.col("vector").cast("array<double>"), lambda x: x / F.greatest(n, F.lit(1e-12))) if normalise else F.col("vector").cast("array<double>")
    offset = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in OFFSETS.items() for x in kv)), F.col("modality")), F.lit(0.0))
    safe = rows.where("node_id is not null and vector is not null").where(F.coalesce(F.size(T.injections("text")), F.lit(0)) == 0)
    clip = lambda x, low: F.greatest(F.lit(low), F.least(F.lit(1.0), x))
    safe = safe.withColumn("vector", v).withColumn("length", V.norm("vector"))
    return safe.select(
        "node_id", "text", "modality", "vector",
        clip(F.col("length") / 20, 0.3).alias("salience"), clip(F.col("length") / 15, 0.5).alias("amplitude"),
        F.pmod(F.pmod(F.lit(now * 0.01), F.lit(TWO_PI)) + offset, F.lit(TWO_PI)).alias("phase"),
    )


def turns(messages: DataFrame) -> DataFrame:
    """(session, turn, input, output): each user message with the assistant's next one in its session, or none."""
    m = messages.where("content is not null and session_id is not null and role in ('user', 'assistant')").select("session_id", "turn", "msg_id", "role", "content").distinct()
    w = Window.partitionBy("session_id").orderBy("turn", "msg_id", "content")
    m = m.withColumn("next_role", F.lead("role").over(w)).withColumn("next", F.lead("content").over(w))
    return m.where("role = 'user'").select(F.col("session_id").alias("session"), "turn", "msg_id", F.col("content").alias("input"), F.when(F.col("next_role") == "assistant", F.col("next")).otherwise("").alias("output"))


def conversation_nodes(pairs: DataFrame) -> DataFrame:
    """Nodes of turns (session, msg_id, input, output): emotion of the input, tags of both, role and tier."""
    both = F.concat_ws(" ", "input", "output")
    return pairs.select(
        "msg_id", "session", T.emotion("input").alias("emotion"), F.slice(T.tags(both), 1, 5).alias("tags"),
        F.when(F.trim("output") != "", "assistant").otherwise("user").alias("role"), F.lit("episodic").alias("tier"),
    )


def patched(nodes: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``nodes`` with the values that ``changes`` gives in their place; a null gives nothing."""
    new = changes.select(key, *(F.col(c).alias(f"new_{c}") for c in columns))
    return nodes.join(new, key, "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in columns}).drop(*(f"new_{c}" for c in columns))


def row_digest(columns: list[str]) -> Column:
    """sha256 of a row as JSON, nulls included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def dump(nodes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, record, sha256): each node as a JSON record with its digest, for a portable file."""
    r = F.to_json(F.struct(key, *columns), {"ignoreNullFields": "false"})
    return nodes.select(key, r.alias("record"), F.sha2(r, 256).alias("sha256"))


def load(records: DataFrame, schema: str) -> DataFrame:
    """Rows of a dump with ``valid``: whether the record is readable and its digest right."""
    v = F.from_json("record", schema)
    ok = (F.sha2("record", 256) == F.col("sha256")) & v.isNotNull()
    return records.select(v.alias("v"), F.coalesce(ok, F.lit(False)).alias("valid")).select("v.*", "valid")


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, causal edges, and the nodes of each tier and modality as sorted JSON maps."""
    counts = lambda c: F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(c, F.lit("none")), "n")))))
    part = lambda c: nodes.groupBy(c).agg(F.count("*").alias("n")).agg(counts(c).alias(f"{c}s"))
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(part("tier")).crossJoin(part("modality"))


def delta(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, op, columns): what turns ``old`` into ``new``: rows to put, and keys to remove."""
    put = new.select(key, *columns).join(old.select(key, F.struct(*columns).alias("o")), key, "left").where(F.col("o").isNull() | ~F.struct(*columns).eqNullSafe(F.col("o")))
    gone = old.select(key).join(new.select(key), key, "left_anti")
    return put.select(key, F.lit("put").alias("op"), *columns).unionByName(gone.select(key, F.lit("remove").alias("op"), *(F.lit(None).cast(old.schema[c].dataType).alias(c) for c in columns)))


def apply_delta(old: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``old`` after a delta: removed keys gone, put rows in the place of those of their key; a key that is put and removed is put."""
    kept = old.select(key, *columns).join(changes.select(key).distinct(), key, "left_anti")
    return kept.unionByName(changes.where("op = 'put'").select(key, *columns))


def timeline(nodes: DataFrame, at: str, *, session: str | None = None, tier: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """The nodes of a session, a tier and a time range, each of which may be left open; rows without a time are left out."""
    t = nodes.where(F.col(at).isNotNull())
    for c, v in (("session", session), ("tier", tier)):
        t = t if v is None else t.where(F.col(c) == v)
    t = t if start is None else t.where(F.col(at) >= start)
    return t if end is None else t.where(F.col(at) <= end)


def timeline_markdown(nodes: DataFrame, at: str, by: str, text: str) -> DataFrame:
    """(by, markdown): a heading and a line for each event of a group, in the order of time.

    A group's document is one value by nature; groups are combined where they are.
    """
    line = F.format_string("## %s (%s)\n%s\n", F.date_format(F.col(at).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss"), F.coalesce("tier", F.lit("semantic")), F.coalesce(text, F.lit("")))
    events = F.array_sort(F.collect_list(F.struct(at, "node_id", line.alias("line"))))
    return nodes.groupBy(by).agg(F.concat(F.lit("# Timeline\n\n"), F.array_join(F.transform(events, lambda e: e["line"]), "\n")).alias("markdown"))


def outdated(backups: DataFrame, by: str, at: str, key: str, keep: int) -> DataFrame:
    """Backups beyond the newest ``keep`` of each source."""
    w = Window.partitionBy(by).orderBy(F.desc(at), key)
    return backups.withColumn("place", F.row_number().over(w)).where(F.col("place") > keep).drop("place")


def versions(changes: DataFrame, key: str, order: str, columns: list[str], every: int) -> DataFrame:
    """``changes`` with the number of the version each belongs to: a new one every so many units of ``order``."""
    return changes.select(key, order, *columns, (F.floor(F.col(order) / every) + 1).cast("bigint").alias("version"))


def rolled_back(versioned: DataFrame, key: str, order: str, columns: list[str], version: int) -> DataFrame:
    """The state at the end of a version: of each key the last change up to there."""
    return versioned.where(F.col("version") <= version).groupBy(key).agg(F.max(F.struct(order, *columns)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in columns))


def import_report(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, imported, failed, errors) of imported rows (position, error): counts, and the first ten errors, which is the report's feature."""
    w = Window.partitionBy(*by).orderBy("position")
    failed = rows.where("error is not null").withColumn("place", F.row_number().over(w)).where("place <= 10")
    first = failed.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.format_string("%d: %s", "position", "error").alias("e")))), lambda x: x["e"]).alias("errors"))
    n = rows.groupBy(*by).agg(F.count_if(F.col("error").isNull()).alias("imported"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return n.join(first, by, "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))


def integrity(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key, fault) of rows whose vector is missing, of another length, not finite or all zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fault = F.when(v.isNull(), "missing").when(F.size(v) != dim, "length").when(bad, "not finite").when(~F.exists(v, lambda x: x != 0), "zero")
    return vectors.select(key, fault.alias("fault")).where("fault is not null")


def healed(vectors: DataFrame, vector: str) -> Column:
    """The vector with 0 in the place of values that are null or not finite."""
    return F.transform(vector, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x.cast("double")))
