"""Changes of a node table as functions from tables to the new table.

Each gives the whole new table or the rows that change; writing it in place of
the old is left to the caller, whose format has a commit protocol. Ties go to
the lesser id throughout, and null keys never match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.times import micros
from mnemora.operators import ranks


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key among both, by one aggregation."""
    both = table.unionByName(changes)
    rest = [c for c in both.columns if c not in (key, order)]
    return both.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *rest)).alias("r")).select(key, "r.*").select(*both.columns)


def delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def decay(nodes: DataFrame, rate: Column, steps: Column, *, amplitude_floor: float = 0.05, salience_floor: float = 0.025) -> DataFrame:
    """Amplitude and salience after so many steps, in closed form; both stay above their floors and at most 1."""
    f = F.pow(rate, steps)
    clip = lambda c, lo: F.greatest(F.lit(lo), F.least(F.lit(1.0), F.col(c) * f))
    return nodes.withColumn("amplitude", clip("amplitude", amplitude_floor)).withColumn("salience", clip("salience", salience_floor))


def beyond_capacity(nodes: DataFrame, keep: int, key: str = "node_id") -> DataFrame:
    """Rows beyond the ``keep`` of greatest salience * amplitude, by ranks taken in ranges, so no task sorts the table."""
    worth = F.coalesce(F.col("salience") * F.col("amplitude"), F.lit(0.0))
    return ranks.running(nodes.withColumn("worth", worth), [], [F.desc("worth"), key]).where(F.col("place") > keep).drop("place", "worth")


def prunable(nodes: DataFrame, policy: DataFrame, created: str, now: Column) -> DataFrame:
    """Rows that are old, of low salience and of low amplitude by their tier's policy (tier, max_hours, min_salience, min_amplitude)."""
    age = (now - micros(created)) / 3.6e9
    p = nodes.join(F.broadcast(policy), "tier")  # a row per tier
    return p.where((age >= F.col("max_hours")) & (F.col("salience") <= F.col("min_salience")) & (F.col("amplitude") <= F.col("min_amplitude"))).select(*nodes.columns)


def expired(rows: DataFrame, key: str, at: str, *, cutoff: Column, keep: int) -> DataFrame:
    """Rows older than the cut-off or beyond the newest ``keep``; rows without a time are neither."""
    timed = ranks.running(rows.where(F.col(at).isNotNull()), [], [F.desc(at), key])
    return timed.where((F.col(at) < cutoff) | (F.col("place") > keep)).drop("place")


def tiers(access: DataFrame, hot: int, warm: int) -> DataFrame:
    """(key, tier) from (key, hits, last): the ``hot`` most used, then the ``warm`` last used of the rest, else cold."""
    a = ranks.running(access, [], [F.desc("hits"), "key"], name="used")
    b = ranks.running(a.where(F.col("used") > hot), [], [F.desc("last"), "key"], name="fresh").select("key", F.when(F.col("fresh") <= warm, "warm").otherwise("cold").alias("tier"))
    return a.where(F.col("used") <= hot).select("key", F.lit("hot").alias("tier")).unionByName(b)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: list[str]) -> DataFrame:
    """(key, status): added, removed or changed rows of two snapshots."""
    a = old.select(key, F.xxhash64(*value).alias("a"))
    b = new.select(key, F.xxhash64(*value).alias("b"))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status")).where("status is not null")


def as_of(versions: DataFrame, key: str, version: str, upto: Column | int) -> DataFrame:
    """The state of each key at a version: its last row up to there."""
    rest = [c for c in versions.columns if c not in (key, version)]
    return versions.where(F.col(version) <= upto).groupBy(key).agg(F.max(F.struct(version, *rest)).alias("r")).select(key, "r.*")


def history(versions: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """Each change of a key with the value before it; rows that change nothing are left out."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(version))
    return versions.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col(value)))


def checksum(df: DataFrame, columns: list[str]) -> DataFrame:
    """An order-free digest of a table: rows, and the sum of the rows' sha256 prefixes."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns)), 256), 1, 12), 16, 10)
    return df.agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("digest"))
