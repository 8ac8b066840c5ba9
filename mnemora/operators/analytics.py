"""Aggregates over events and nodes. ``now`` is always a parameter, never the clock.

Every aggregate is associative or counted per distinct value first, so hot keys
are combined before the shuffle. Null keys form a group of their own unless a
docstring says otherwise; an empty input gives no rows, or one row of nulls
where there is no key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.times import micros
from mnemora.operators import ranks


def distribution(df: DataFrame, by: str) -> DataFrame:
    """Rows per value and their share in per cent."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select(by, "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"))


def salience_bins(nodes: DataFrame, salience: str = "salience") -> DataFrame:
    """Counts and shares in the bins critical > .7, high > .4, medium > .1, low; every bin is given."""
    s = F.col(salience)
    b = F.when(s > 0.7, "critical").when(s > 0.4, "high").when(s > 0.1, "medium").otherwise("low")
    counts = nodes.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    bins = nodes.sparkSession.createDataFrame([("critical",), ("high",), ("medium",), ("low",)], "bin string")
    full = bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return full.select("bin", "n", F.round(100.0 * F.col("n") / F.greatest(total, F.lit(1)), 1).alias("pct"))


def lifecycle(nodes: DataFrame, created: str, now: Column) -> DataFrame:
    """Average, median, least and greatest age in hours at ``now``, in microseconds since 1970."""
    h = (now - micros(created)) / 3.6e9
    r = lambda c, name: F.round(c, 1).alias(name)
    return nodes.where(F.col(created).isNotNull()).select(h.alias("h")).agg(r(F.avg("h"), "avg_h"), r(F.percentile("h", 0.5), "median_h"), r(F.min("h"), "min_h"), r(F.max("h"), "max_h"))


def _placed(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, place, n) of the rows with a value, in its order."""
    v = df.where(F.col(value).isNotNull()).select(*by, value)
    n = v.groupBy(*by).agg(F.count("*").alias("n"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by]
    j = ranks.running(v, by, [value]).alias("x").join(n.alias("y"), same)
    return j.select(*(F.col(f"x.{c}") for c in by), F.col(f"x.{value}"), "place", "n")


def percentiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Linear p50, p95 and p99 per key, from the values on both sides of each; no task holds a key's values."""
    r, out = _placed(df, by, value), []
    for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
        at = (F.col("n") - 1) * q
        low, high = (F.max(F.when(F.col("place") == f(at) + 1, F.col(value))) for f in (F.floor, F.ceil))
        out.append(F.round(low + (high - low) * F.max(at - F.floor(at)), 6).alias(name))
    return r.groupBy(*by).agg(*out)


def nearest_p95(df: DataFrame, by: str, value: str) -> DataFrame:
    """Stage summary: count, mean, greatest value and the p95 at index int(n * .95) of the sorted values."""
    at = F.floor(F.col("n") * 0.95) + 1
    return _placed(df, [by], value).groupBy(by).agg(
        F.max("n").alias("n"),
        F.round(F.avg(value), 6).alias("mean"),
        F.max(F.when(F.col("place") == at, F.col(value))).alias("p95"),
        F.max(value).alias("most"),
    )


def normalised_entropy(df: DataFrame, by: str, value: str) -> DataFrame:
    """Shannon entropy of the values of each key over its greatest possible, null under three distinct values."""
    c = df.groupBy(by, value).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(by))
    h = c.withColumn("h", -p * F.log2(p + 1e-10)).groupBy(by).agg(F.sum("h").alias("h"), F.count("*").alias("k"))
    return h.select(by, F.round(F.when(F.col("k") >= 3, F.col("h") / F.log2("k")), 6).alias("entropy"))


def trailing_counts(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """``events`` with the number of the key's events in the trailing window, itself included."""
    w = Window.partitionBy(key).orderBy(micros(at)).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("n", F.count("*").over(w))


def spikes(df: DataFrame, key: str, order: list[str], value: str, *, window: int = 100, least: int = 10, threshold: float = 3.0) -> DataFrame:
    """Rows whose value lies more than ``threshold`` deviations from the mean of the ``window`` rows before; hot keys are taken in blocks."""
    w = Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(-window, -1)
    z = F.abs(F.col(value) - F.avg(value).over(w)) / F.stddev_pop(value).over(w)
    x = ranks.blocks(df, [key], order, window).withColumn("seen", F.count(value).over(w)).withColumn("z", z)
    return x.where(F.col("_own") & (F.col("seen") >= least) & (F.col("z") > threshold)).drop("seen", "_own", "_block")


def variant(key: Column | str, variants: int) -> Column:
    """md5 of the key modulo the number of variants, by Horner's rule over eight hex digits at a time."""
    h = F.md5(F.col(key) if isinstance(key, str) else key)
    x = F.lit(0).cast("bigint")
    for k in range(4):
        x = F.pmod(x * 4294967296 + F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("bigint"), F.lit(variants))
    return x


def trailing_mean_threshold(df: DataFrame, key: str, order: list[str], value: str, *, window: int = 30, least: int = 5, floor: float = 0.01) -> DataFrame:
    """``df`` with max(floor, mean + half a deviation) of the last ``window`` rows, itself included; null under ``least``; hot keys are taken in blocks."""
    w = Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(1 - window, 0)
    t = F.greatest(F.lit(floor), F.avg(value).over(w) + 0.5 * F.stddev_pop(value).over(w))
    x = ranks.blocks(df, [key], order, window - 1).withColumn("threshold", F.when(F.count(value).over(w) >= least, t))
    return x.where("_own").drop("_own", "_block")


def last_n(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each key; the rank is cut before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)


def once_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by a partial aggregation rather than a sort."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("r")).select(*keys, "r.*")
