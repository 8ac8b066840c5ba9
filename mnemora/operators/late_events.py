"""Event-time aggregates that late records correct, by stream slicing.

Time is cut into panes that do not overlap, one per window boundary step. An
event belongs to one pane only, so a late event changes one pane, and only the
windows that cover the pane are composed again from the panes' partial counts.
A pane closes ``grace`` after its end; an arrival from then on corrects it up
to and including ``cutoff`` after its end, and is dropped later.

A pane's partial is kept per tick of lateness: tick 0 holds what came before
the close, later ticks the corrections by arrival, so the values a pane went
through can be told from the partials alone. The cut-off bounds the ticks.

Defined cases: a null or blank ``id``, an event time that is null, zero,
negative or not finite, and an id that never arrived are left out; redelivered
rows count once, by the earliest arrival; equal rows are one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora import workspace

HOUR = 3_600_000
_INDEX = "id string, event_type string, event_ms bigint, arrival_ms bigint, pane_start bigint, outcome string"
_PARTIAL = "event_type string, pane_start bigint, outcome string, tick bigint, n bigint"


def event_millis(c: str | Column) -> Column:
    """Epoch milliseconds of a time in seconds, milliseconds or microseconds; null where unusable."""
    t = F.col(c) if isinstance(c, str) else c
    ms = F.when(t < 1e11, t * 1000).when(t < 1e14, t).otherwise(t / 1000)
    return F.when((t > 0) & (t < 1e17) & ~F.isnan(t), F.round(ms).cast("long"))


def arrival_millis(c: str | Column) -> Column:
    """Epoch milliseconds of an arrival in ISO notation with any offset (none: UTC) or in epoch units; null where unreadable."""
    s = F.trim(F.col(c) if isinstance(c, str) else c)
    iso = F.when(s.rlike(r"(?:[Zz]|[+-]\d\d:?\d\d)$"), s).otherwise(F.concat(s, F.lit("Z")))
    number = s.rlike(r"^[+-]?\d+(\.\d+)?$")
    return F.when(number, event_millis(s.try_cast("double"))).otherwise(F.unix_millis(iso.try_cast("timestamp")))


def slice_events(
    events: DataFrame, *, pane_ms: int = HOUR, grace_ms: int = 300_000, cutoff_ms: int = 24 * HOUR
) -> DataFrame:
    """One row per usable id: (id, event_type, event_ms, arrival_ms, pane_start, outcome).

    One shuffle, on ``id``, with partial aggregation before it; no key of it is hot.
    """
    one = (
        events.select(
            "id",
            F.lower(F.trim("event_type")).alias("event_type"),
            event_millis("timestamp").alias("event_ms"),
            arrival_millis("received_at").alias("arrival_ms"),
        )
        .where(F.trim("id") != "")
        .groupBy("id")
        .agg(F.min("event_type").alias("event_type"), F.min("event_ms").alias("event_ms"), F.min("arrival_ms").alias("arrival_ms"))
        .where(F.col("event_ms").isNotNull() & F.col("arrival_ms").isNotNull())
    )
    start = F.col("event_ms") - F.pmod(F.col("event_ms"), F.lit(pane_ms))
    late = F.col("arrival_ms") - start - pane_ms
    return one.withColumn("pane_start", start).withColumn(
        "outcome", F.when(late < grace_ms, "on_time").when(late <= cutoff_ms, "corrected").otherwise("dropped")
    )


def pane_partials(sliced: DataFrame, *, tick_ms: int = HOUR) -> DataFrame:
    """(event_type, pane_start, outcome, tick, n): partial counts of each pane; hot types are combined before the shuffle."""
    tick = F.when(F.col("outcome") == "corrected", F.expr(f"arrival_ms div {tick_ms} + 1")).otherwise(F.lit(0)).cast("bigint")
    return sliced.groupBy("event_type", "pane_start", "outcome", tick.alias("tick")).agg(F.count("*").alias("n"))


def pane_counts(partials: DataFrame) -> DataFrame:
    """(event_type, pane_start, on_time, corrected, dropped) of the panes' partials."""
    count = lambda what: F.sum(F.when(F.col("outcome") == what, F.col("n")).otherwise(0)).alias(what)
    return partials.groupBy("event_type", "pane_start").agg(count("on_time"), count("corrected"), count("dropped"))


def _windows_of(pane: str, size_panes: int, pane_ms: int, window: str) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(size_panes - 1)), lambda k: F.col(pane) - k * pane_ms)).alias(window)


def compose_windows(panes: DataFrame, *, size_panes: int, pane_ms: int = HOUR) -> DataFrame:
    """Sliding windows of ``size_panes`` panes, a new one each pane, from the panes' counts alone."""
    return (
        panes.select("*", _windows_of("pane_start", size_panes, pane_ms, "window_start"))
        .groupBy("event_type", "window_start")
        .agg(F.sum("on_time").alias("at_close"), F.sum(F.col("on_time") + F.col("corrected")).alias("events"))
    )


def revisions(partials: DataFrame) -> DataFrame:
    """Each value a pane's count took: its count at the close, then one row per tick of late arrivals."""
    deltas = partials.where("outcome <> 'dropped'").groupBy("event_type", "pane_start", "tick").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("event_type", "pane_start").orderBy("tick")
    return deltas.select(
        "event_type",
        "pane_start",
        (F.row_number().over(w) - 1).cast("long").alias("revision"),
        F.sum("n").over(w).alias("events"),
    )


class PaneStore:
    """Panes' partial counts in a table, corrected batch by batch.

    A batch appends its own partials; stored ones are never read to be
    rewritten. Ids that came before are told by an index laid out by the day of
    the pane, of which only the days a batch touches are read: an id always
    comes again at the same event time, so in the same day. ``apply`` returns
    the windows to emit again, composed of the stored partials of the panes in
    their reach. One rename of the manifest makes a batch visible, so a reader
    sees all of it or none; a batch that is run again takes the place of its
    first run. Batches must come in the order of arrival, as the first delivery
    of an id decides; rows without arrival time count for nothing.
    """

    def __init__(self, spark: SparkSession, path: str, *, size_panes: int = 1, pane_ms: int = HOUR, grace_ms: int = 300_000, cutoff_ms: int = 24 * HOUR):
        self.spark, self.path, self.size, self.pane_ms = spark, path, size_panes, pane_ms
        self.rule = {"pane_ms": pane_ms, "grace_ms": grace_ms, "cutoff_ms": cutoff_ms}

    def _batches(self) -> dict[str, dict]:
        """By batch number: the folder of its files and the days its index holds."""
        return (workspace.read_json(self.spark, f"{self.path}/manifest.json") or {"batches": {}})["batches"]

    def _index(self, batches: dict[str, dict], days: set[int] | None = None) -> DataFrame | None:
        paths = [f"{b['path']}/ids/day={d}" for b in batches.values() for d in b["days"] if days is None or d in days]
        return self.spark.read.schema(_INDEX).parquet(*paths) if paths else None

    def apply(self, batch: DataFrame, number: int) -> DataFrame:
        batches = {k: b for k, b in self._batches().items() if k != str(number)}
        out = f"{self.path}/batch-{number}-{uuid.uuid4().hex}"
        day = F.expr(f"pane_start div {24 * HOUR}")
        new = slice_events(batch, **self.rule).withColumn("day", day)
        stored = [d for b in batches.values() for d in b["days"]]
        if stored:
            new = workspace.materialise(new, "sliced")
            days = {r.day for r in new.select("day").distinct().collect()}  # one row a day
            if (seen := self._index(batches, days)) is not None:
                new = new.join(seen.select("id"), "id", "left_anti")
        new.write.partitionBy("day").parquet(f"{out}/ids")
        rows = self.spark.read.schema(_INDEX + ", day bigint").parquet(f"{out}/ids")
        pane_partials(rows).coalesce(1).write.parquet(f"{out}/panes")
        days = sorted(r.day for r in rows.select("day").distinct().collect())  # one row a day
        workspace.replace_json(self.spark, f"{self.path}/manifest.json", {"batches": batches | {str(number): {"path": out, "days": days}}})
        touched = self.spark.read.parquet(f"{out}/panes").where("outcome <> 'dropped'").select("event_type", "pane_start").distinct()
        reach = F.explode(F.transform(F.sequence(F.lit(1 - self.size), F.lit(self.size - 1)), lambda k: F.col("pane_start") + k * self.pane_ms))
        near = touched.select("event_type", reach.alias("pane_start")).distinct()
        emitted = touched.select("event_type", _windows_of("pane_start", self.size, self.pane_ms, "window_start")).distinct()
        panes = pane_counts(self.partials().join(near, ["event_type", "pane_start"], "left_semi"))
        return compose_windows(panes, size_panes=self.size, pane_ms=self.pane_ms).join(emitted, ["event_type", "window_start"], "left_semi")

    def partials(self) -> DataFrame:
        paths = [f"{b['path']}/panes" for b in self._batches().values()]
        return self.spark.read.schema(_PARTIAL).parquet(*paths) if paths else self.spark.createDataFrame([], _PARTIAL)

    def panes(self) -> DataFrame:
        return pane_counts(self.partials())

    def events(self) -> DataFrame:
        """(id, event_type, event_ms, arrival_ms, pane_start, outcome) of every id so far."""
        index = self._index(self._batches())
        return index if index is not None else self.spark.createDataFrame([], _INDEX)
