"""Sessions by inactivity, kept in a table that each batch amends.

Rows of an actor no further apart than the gap belong together, so all rows of
one gap-wide bucket do; ``pieces`` therefore combines rows to buckets before
any sorting. The rows an actor brings to the sort are bounded by its time span
over the gap, however many events it has, so an actor with a third of all rows
is no hot spot.

Defined cases: ``actor`` is the user, or the session where the user is null or
blank, trimmed and in lower case; rows where it is null, blank or ``default``,
rows without a usable event time and rows with a null or blank id are left out;
an id counts once; ties in time are ordered by id; an empty table gives no
sessions; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemora import workspace
from mnemora.operators.late_events import event_millis

GAP_MS = 30 * 60_000
DAY_MS = 86_400_000
_BLANKS = " \t\r\n"


def actor_of(user: str = "user_id", session: str = "session_id") -> Column:
    clean = lambda c: F.lower(F.btrim(F.col(c), F.lit(_BLANKS)))
    a = F.when(clean(user) != "", clean(user)).otherwise(clean(session))
    return F.when((a != "") & (a != "default"), a)


def actor_events(events: DataFrame) -> DataFrame:
    """One row per usable id: (id, event_ms, actor)."""
    return (
        events.select("id", event_millis("timestamp").alias("event_ms"), actor_of().alias("actor"))
        .where((F.trim("id") != "") & F.col("event_ms").isNotNull() & F.col("actor").isNotNull())
        .groupBy("id")
        .agg(F.min("event_ms").alias("event_ms"), F.min("actor").alias("actor"))
    )


def pieces(events: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Rows combined per actor and gap-wide bucket: (actor, start_ms, end_ms, first_id, last_id, events)."""
    at = F.struct("event_ms", "id")
    return (
        events.groupBy("actor", F.expr(f"event_ms div {gap_ms}").alias("bucket"))
        .agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("events"))
        .select("actor", F.col("a.event_ms").alias("start_ms"), F.col("b.event_ms").alias("end_ms"), F.col("a.id").alias("first_id"), F.col("b.id").alias("last_id"), "events")
    )


def _numbered(parts: DataFrame, gap_ms: int) -> DataFrame:
    """``parts`` with ``k``, the same for those of an actor that lie within the gap of each other, one after another."""
    w = Window.partitionBy("actor").orderBy("start_ms", "first_id")
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("new", (F.col("start_ms") - reach > gap_ms).cast("int")).withColumn("k", F.sum(F.coalesce("new", F.lit(1))).over(w)).drop("new")


def _combined(numbered: DataFrame) -> DataFrame:
    first, last = F.struct("start_ms", "first_id"), F.struct("end_ms", "last_id")
    return (
        numbered.groupBy("actor", "k")
        .agg(F.min(first).alias("a"), F.max(last).alias("b"), F.sum("events").alias("events"))
        .select("actor", F.col("a.start_ms").alias("start_ms"), F.col("b.end_ms").alias("end_ms"), F.col("a.first_id").alias("first_id"), F.col("b.last_id").alias("last_id"), "events")
    )


def merge(parts: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Union of pieces or sessions that lie within the gap of each other, per actor."""
    return _combined(_numbered(parts, gap_ms))


_SESSION = "actor string, start_ms bigint, end_ms bigint, first_id string, last_id string, events bigint, version int"
_EVENT = "id string, event_ms bigint, actor string"


class SessionTable:
    """Sessions in a table of parquet parts under a manifest, laid out by the day of their start.

    ``apply`` finds the sessions local to a batch, compares them with the
    stored ones of the same actors in days whose sessions lie within the gap of
    the batch's, and merges the components they bridge. Only those are written:
    the merged sessions as a new part, and the keys of the stored rows they
    replace, which readers leave out. One rename of the manifest puts both in
    place, so a reader, or a driver that starts again, sees the state before the
    batch or after it. ``compact`` rewrites the parts without replaced rows.
    """

    def __init__(self, spark: SparkSession, path: str, gap_ms: int = GAP_MS):
        self.spark, self.path, self.gap = spark, path, gap_ms

    def manifest(self) -> dict:
        return workspace.read_json(self.spark, f"{self.path}/manifest.json") or {"version": 0, "days": {}, "gone": [], "ids": {}}

    def _new_events(self, m: dict, batch: DataFrame, version: int) -> tuple[DataFrame, list[int]]:
        """The batch's events that are not stored, written to the index of ids, and their days.

        An id comes again at the same event time, so only the index of the days
        the batch touches is read.
        """
        new = actor_events(batch).withColumn("day", F.expr(f"event_ms div {DAY_MS}"))
        if m["ids"]:
            new = workspace.materialise(new, "events")
            days = [str(r.day) for r in new.select("day").distinct().collect()]  # one row a day
            paths = [p for d in days for p in m["ids"].get(d, [])]
            if paths:
                new = new.join(self.spark.read.schema(_EVENT).parquet(*paths).select("id"), "id", "left_anti")
        out = f"{self.path}/ids-{version}"
        new.write.mode("overwrite").partitionBy("day").parquet(out)
        rows = self.spark.read.schema(_EVENT + ", day bigint").parquet(out)
        return rows.drop("day"), [r.day for r in rows.select("day").distinct().collect()]

    def apply(self, batch: DataFrame) -> "SessionTable":
        m = self.manifest()
        version = m["version"] + 1
        new, days = self._new_events(m, batch, version)
        if not days:
            return self
        local = pieces(new, self.gap)
        gone = []
        if m["days"]:
            local = workspace.materialise(merge(local, self.gap), "local")
            spans = local.groupBy(F.expr(f"start_ms div {DAY_MS}").alias("day")).agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("z")).collect()  # one row a day
            hit = {d: x for d, x in m["days"].items() if any(x["from"] <= r.z + self.gap and x["to"] >= r.a - self.gap for r in spans)}
            stored = self._read({"days": hit, "gone": m["gone"]}).join(local.select("actor").distinct(), "actor", "left_semi")
            both = local.withColumn("version", F.lit(0)).unionByName(stored)
            numbered = _numbered(both, self.gap).withColumn("fresh", F.min("version").over(Window.partitionBy("actor", "k")) == 0)
            touched = workspace.materialise(numbered.where("fresh").drop("fresh"), "touched")
            gone = [f"{self.path}/gone-{version}"]
            touched.where("version > 0").select("actor", "first_id", "version").write.mode("overwrite").parquet(gone[0])
            sessions = _combined(touched)
        else:
            sessions = merge(local, self.gap)
        ids = m["ids"] | {str(d): [*m["ids"].get(str(d), []), f"{self.path}/ids-{version}/day={d}"] for d in days}
        self._put(m | {"gone": [*m["gone"], *gone], "ids": ids}, sessions, version)
        return self

    def _put(self, m: dict, sessions: DataFrame, version: int) -> None:
        """Write sessions as a part of this version and put the manifest in place."""
        out = f"{self.path}/sessions-{version}"
        row = sessions.withColumn("version", F.lit(version)).withColumn("day", F.expr(f"start_ms div {DAY_MS}"))
        row.write.mode("overwrite").partitionBy("day").parquet(out)
        written = self.spark.read.schema(_SESSION + ", day bigint").parquet(out)
        days = dict(m["days"])
        for r in written.groupBy("day").agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("z")).collect():  # one row a day
            old = days.get(str(r.day), {"paths": [], "from": r.a, "to": r.z})
            days[str(r.day)] = {"paths": [*old["paths"], f"{out}/day={r.day}"], "from": min(old["from"], r.a), "to": max(old["to"], r.z)}
        workspace.replace_json(self.spark, f"{self.path}/manifest.json", m | {"version": version, "days": days})

    def compact(self) -> "SessionTable":
        m = self.manifest()
        self._put(m | {"days": {}, "gone": []}, self.read(), m["version"] + 1)
        return self

    def _read(self, m: dict) -> DataFrame:
        paths = [p for x in m["days"].values() for p in x["paths"]]
        if not paths:
            return self.spark.createDataFrame([], _SESSION)
        rows = self.spark.read.schema(_SESSION).parquet(*paths)
        if m["gone"]:
            replaced = self.spark.read.schema("actor string, first_id string, version int").parquet(*m["gone"])
            rows = rows.join(replaced, ["actor", "first_id", "version"], "left_anti")
        return rows.select("actor", "start_ms", "end_ms", "first_id", "last_id", "events", "version")

    def read(self) -> DataFrame:
        return self._read(self.manifest()).drop("version")
