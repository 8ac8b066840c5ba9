"""Exact ranks, running sums and trailing windows over a whole table or over keys that hold most of it.

A window partitioned by a hot key, or by none, puts it all into one task. Here
rows are range-partitioned by key and order, counted per partition, and each
partition is told what lies before it: one row a partition and key is moved
for that, whatever the number of rows. Ties of the order are broken by it as it
stands, so it should end in a unique column; null keys are a group of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora import workspace


def _cols(order: list) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _ranged(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return workspace.materialise(df.repartitionByRange(n, *keys, *_cols(order)).withColumn("_part", F.spark_partition_id()), "ranged")


def running(df: DataFrame, keys: list[str], order: list, value: str | None = None, name: str = "place") -> DataFrame:
    """``df`` with each row's place within its keys, from 1, or the sum of ``value`` up to it."""
    amount = F.lit(1).cast("bigint") if value is None else F.col(value)
    parts = _ranged(df, keys, order)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    sums = parts.groupBy("_part", *keys).agg(F.sum(amount).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_sum")
    here = Window.partitionBy("_part", *keys).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.withColumn("_here", F.sum(amount).over(here))
    j = rows.alias("a").join(sums.alias("b"), [F.col("a._part") == F.col("b._part"), *same])
    return j.select(*(F.col(f"a.{c}") for c in df.columns), (F.col("a._here") + F.col("b._before")).alias(name))


def blocks(df: DataFrame, keys: list[str], order: list, before: int, block: int = 100_000) -> DataFrame:
    """``df`` in blocks of a key's rows, each led by the ``before`` rows in front of it: columns ``_block`` and ``_own``.

    A window over the last ``before`` rows can then be partitioned by the keys
    and ``_block``; rows that are not ``_own`` only serve it.
    """
    placed = running(df, keys, order, name="_place")
    b = F.floor((F.col("_place") - 1) / block)
    reach = F.floor((F.col("_place") - 1 + before) / block)
    rows = placed.withColumn("_home", b).withColumn("_block", F.explode(F.sequence(b, reach)))
    return rows.withColumn("_own", F.col("_block") == F.col("_home")).drop("_home", "_place")
