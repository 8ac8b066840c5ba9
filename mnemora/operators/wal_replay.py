"""Commit-ordered replay of a change feed into the state it leaves.

A change is one (clock, origin). Its readable copies are assembled into one
complete transaction before anything is applied. Transactions commit in the
order of clock, then origin: while the feed is open, those behind a gap in the
clocks are held, and so are those at clocks some known origin has not reached
yet; state shows only what lies at or below the committed watermark. At the
end of the feed the gaps are given up and all commits.

Changes of different nodes do not conflict and are replayed in parallel. Within
a node no row order is needed: the last add or delete decides whether it lives,
and every field is the value with the greatest commit position since the last
add. These are maxima, so partial results are combined before the shuffle, a
node with a third of all changes is no hot spot, and a repeat of a change that
is committed already alters nothing.

Defined cases: unreadable or null JSON, JSON that is no object, a null clock or
origin and a node id that is null or empty are no change; unknown operations
alter nothing; of copies that differ one is taken whole, a known operation
before an unknown one, then the least in the order of the fields; an empty log
gives no nodes; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora import workspace

#: Operation names (fixed values).
ADD = ("add", "add_node", "create", "insert")
UPDATE = ("update", "update_node", "patch")
DELETE = ("delete", "delete_node", "remove")

STATE = "node_id string, live boolean, clock bigint, origin string, content string, salience double, modality string"


def parse_changes(wal: DataFrame) -> DataFrame:
    """Readable rows: (clock, origin, kind, nodes, content, salience, modality, has_content, has_salience)."""
    v = F.col("v")
    path = lambda key: [f"$.payload.{key}", f"$.data.{key}", f"$.{key}"]
    get = lambda key, kind: F.coalesce(*(F.try_variant_get(v, p, kind) for p in path(key)))
    op = F.lower(F.trim(F.coalesce(F.try_variant_get(v, "$.op", "string"), F.try_variant_get(v, "$.action", "string"))))
    kind = F.when(op.isin(*ADD), "add").when(op.isin(*UPDATE), "update").when(op.isin(*DELETE), "delete")
    nodes = F.array_compact(
        F.array_union(F.coalesce(get("node_ids", "array<string>"), F.array().cast("array<string>")), F.array(get("node_id", "string")))
    )
    content = get("content", "variant")
    return (
        wal.select("clock", "origin", F.try_parse_json("mutation").alias("v"))
        .where(v.isNotNull() & F.col("clock").isNotNull() & F.col("origin").isNotNull())
        .select(
            "clock",
            "origin",
            kind.alias("kind"),
            F.filter(nodes, lambda n: n != "").alias("nodes"),
            F.coalesce(F.try_variant_get(content, "$.text", "string"), F.try_variant_get(content, "$", "string")).alias("content"),
            get("salience", "double").alias("salience"),
            get("modality", "string").alias("modality"),
            content.isNotNull().alias("has_content"),
        )
    )


def assemble(changes: DataFrame) -> DataFrame:
    """One row per (clock, origin): of its copies one, whole. Partial minima are taken before the shuffle."""
    rest = [c for c in changes.columns if c not in ("clock", "origin")]
    one = changes.groupBy("clock", "origin").agg(F.min(F.struct(F.col("kind").isNull().alias("unknown"), *rest)).alias("c"))
    return one.select("clock", "origin", *(F.col(f"c.{c}").alias(c) for c in rest))


def watermark(changes: DataFrame, *, after: int = 0, block: int = 1_000_000) -> int:
    """The last clock of the unbroken run of clocks that begins right after ``after``; ``after`` itself where there is none.

    Clocks are counted per block, so that no task sees more clocks than one
    block has; what is ordered as a whole is one row a block.
    """
    clocks = changes.select((F.col("clock") - after).alias("c")).where("c > 0").distinct()
    full = clocks.groupBy(F.expr(f"(c - 1) div {block}").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") == block)
    place = F.row_number().over(Window.orderBy("b")) - 1
    # the k-th full block is block k as long as none before it is missing or broken
    b = full.withColumn("k", place).where("b = k").count()
    inside = clocks.where(f"(c - 1) div {block} = {b}").select((F.col("c") - b * block).alias("c"))
    n = inside.withColumn("k", F.row_number().over(Window.orderBy("c"))).where("c = k").count()
    return after + b * block + n


_FIELDS = ("content", "salience", "modality")


def fold(changes: DataFrame) -> DataFrame:
    """Partial state of transactions: per node the maxima over commit positions, which ``merge`` combines further."""
    at = F.struct("clock", "origin")
    rows = changes.where("kind is not null").select("*", F.explode("nodes").alias("node_id"))
    add, upd, dele = (F.col("kind") == k for k in ("add", "update", "delete"))
    given = {"content": F.col("has_content"), "salience": F.col("salience").isNotNull(), "modality": F.col("modality").isNotNull()}
    last = lambda cond, value: F.max(F.when(cond, F.struct("clock", "origin", F.col(value).alias("x"))))
    return rows.groupBy("node_id").agg(
        F.max(at).alias("last"),
        F.max(F.when(add, at)).alias("added"),
        F.max(F.when(dele, at)).alias("deleted"),
        *(last(add, f).alias(f"{f}_a") for f in _FIELDS),
        *(last(upd & given[f], f).alias(f"{f}_u") for f in _FIELDS),
    )


def merge(parts: DataFrame) -> DataFrame:
    """Partial states of one or more feeds combined, one row per node."""
    return parts.groupBy("node_id").agg(*(F.max(c).alias(c) for c in parts.columns if c != "node_id"))


def state(folded: DataFrame) -> DataFrame:
    """(node_id, live, clock, origin, content, salience, modality) of merged partial states."""
    since = lambda k: F.when(
        F.struct(f"{k}_u.clock", f"{k}_u.origin") > F.col("added"), F.col(f"{k}_u.x")
    ).otherwise(F.col(f"{k}_a.x"))
    live = F.col("added").isNotNull() & (F.col("deleted").isNull() | (F.col("added") > F.col("deleted")))
    return folded.select(
        "node_id",
        live.alias("live"),
        F.col("last.clock").alias("clock"),
        F.col("last.origin").alias("origin"),
        *(since(k).alias(k) for k in _FIELDS),
    )


def replay(wal: DataFrame, *, upto: int | None = None, closed: bool = True) -> DataFrame:
    """State of the nodes after one pass over a whole log; ``upto`` gives the state as of a clock.

    ``closed`` says that the feed has ended. Otherwise only transactions up to
    the contiguous watermark are applied.
    """
    changes = assemble(parse_changes(wal))
    if not closed:
        changes = workspace.materialise(changes, "changes")
        changes = changes.where(F.col("clock") <= watermark(changes))
    if upto is not None:
        changes = changes.where(F.col("clock") <= upto)
    return state(fold(changes))


def live_nodes(wal: DataFrame, **how) -> DataFrame:
    """The nodes that live at the end, with the last change that took effect on each."""
    return replay(wal, **how).where("live").drop("live")


class Replica:
    """A table kept by a change feed that arrives in batches.

    ``apply`` assembles a batch's transactions with those held, moves the
    watermark over the unbroken run of clocks that every known origin has
    reached, folds what lies under it and appends the partial state; the rest
    stays held. ``close`` ends the feed and commits what is held. A batch's work
    follows its own rows and the held ones: committed state is appended to, not
    rewritten, until ``compact``. One rename of the manifest makes a batch
    visible, so a reader or a driver that starts again sees all of it or none; a
    batch number that is done already is not applied again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def manifest(self) -> dict:
        empty = {"version": 0, "watermark": 0, "batches": [], "held": None, "heard": [], "parts": []}
        return workspace.read_json(self.spark, f"{self.path}/manifest.json") or empty

    def _write(self, df: DataFrame, name: str, version: int) -> str:
        path = f"{self.path}/{name}-{version}"
        df.write.mode("overwrite").parquet(path)
        return path

    def apply(self, batch: DataFrame, number: int) -> "Replica":
        m = self.manifest()
        if number in m["batches"]:
            return self
        version = m["version"] + 1
        changes = assemble(parse_changes(batch))
        if m["held"]:
            changes = assemble(changes.unionByName(self.spark.read.parquet(m["held"])))
        path = self._write(changes, "changes", version)
        changes = self.spark.read.parquet(path)
        heard = self._write(changes.groupBy("origin").agg(F.max("clock").alias("clock")), "heard", version)
        reached = self.spark.read.parquet(*m["heard"], heard).groupBy("origin").agg(F.max("clock").alias("clock")).agg(F.min("clock")).first()[0]
        upto = min(watermark(changes, after=m["watermark"]), reached or 0)
        upto = max(upto, m["watermark"])
        return self._commit(m, changes, version, upto, heard=[*m["heard"], heard], batches=[*m["batches"], number])

    def close(self) -> "Replica":
        """The feed has ended: commit what is held, gaps or not."""
        m = self.manifest()
        return self._commit(m, self.spark.read.parquet(m["held"]), m["version"] + 1, None) if m["held"] else self

    def _commit(self, m: dict, changes: DataFrame, version: int, upto: int | None, **done) -> "Replica":
        under = F.lit(True) if upto is None else F.col("clock") <= upto
        part = self._write(fold(changes.where(under)), "state", version)
        held = None if upto is None else self._write(changes.where(~under), "held", version)
        top = changes.agg(F.max("clock")).first()[0] if upto is None else upto
        now = m | done | {"version": version, "watermark": max(m["watermark"], top or 0), "held": held, "parts": [*m["parts"], part]}
        workspace.replace_json(self.spark, f"{self.path}/manifest.json", now)
        return self

    def compact(self) -> "Replica":
        """Merge the appended partial states into one part."""
        m = self.manifest()
        if len(m["parts"]) > 1:
            part = self._write(merge(self.spark.read.parquet(*m["parts"])), "state", m["version"] + 1)
            workspace.replace_json(self.spark, f"{self.path}/manifest.json", m | {"version": m["version"] + 1, "parts": [part]})
        return self

    def read(self) -> DataFrame:
        """State of the nodes as far as it is committed."""
        m = self.manifest()
        if not m["parts"]:
            return self.spark.createDataFrame([], STATE)
        return state(merge(self.spark.read.parquet(*m["parts"])))

    def live(self) -> DataFrame:
        return self.read().where("live").drop("live")
