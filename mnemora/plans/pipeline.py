"""Staged retrieval as composed DataFrame functions, and the planner that leaves stages out.

A stage is a name and a function of the result so far; the pipeline is their
composition, so Catalyst sees one plan. The planner decides per query class
before the plan is built: nothing is decided row by row at run time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions.text import cascade_route, words

#: Stages in order with their expected milliseconds and cost (fixed values).
STAGES = {"embed": (15.0, 0.30), "route": (0.1, 0.01), "retrieve": (1.0, 0.05), "rerank": (8.0, 0.20), "calibrate": (0.5, 0.02), "explain": (2.0, 0.08)}
#: Cost of a stage's call before its latency is counted (fixed values).
RATES = {"embed": 0.50, "route": 0.01, "retrieve": 0.02, "rerank": 0.30, "calibrate": 0.01, "explain": 0.15}

#: Reasons for leaving a stage out (fixed values).
FAST_RERANK, FAST_CALIBRATE, LOW_TOP_K, SHORT_QUERY = "fast_route_skip:rerank", "fast_route_skip:calibrate", "low_top_k", "short_query"

Stage = Callable[[DataFrame], DataFrame]


@dataclass
class Pipeline:
    """Named stages applied in order; ``without`` gives one that leaves some out."""

    stages: dict[str, Stage] = field(default_factory=dict)

    def add(self, name: str, stage: Stage) -> "Pipeline":
        return Pipeline(self.stages | {name: stage})

    def without(self, *names: str) -> "Pipeline":
        return Pipeline({k: v for k, v in self.stages.items() if k not in names})

    def transform(self, df: DataFrame) -> DataFrame:
        for stage in self.stages.values():
            df = df.transform(stage)
        return df


def skips(route: Column, tokens: Column, top_k: int, short: int = 10) -> dict[str, Column]:
    """Reason for leaving a stage out, or null: refinement on the fast route, explanation of short queries, calibration of few rows."""
    fast = route == "fast"
    return {
        "rerank": F.when(fast, FAST_RERANK),
        "calibrate": F.when(fast, FAST_CALIBRATE).when(F.lit(top_k <= 3), LOW_TOP_K),
        "explain": F.when(tokens <= short, SHORT_QUERY),
    }


def plan(queries: DataFrame, key: str, text: str, *, top_k: int = 5) -> DataFrame:
    """(key, route, stages, skipped, latency_ms, cost): the plan of each query."""
    reasons = skips(cascade_route(text), F.size(words(text)), top_k)
    kept = [F.when(reasons[s].isNull(), F.lit(s)) if s in reasons else F.lit(s) for s in STAGES]
    total = lambda i: sum(F.when(reasons[s].isNull(), F.lit(c[i])).otherwise(0.0) if s in reasons else F.lit(c[i]) for s, c in STAGES.items())
    return queries.select(
        key,
        cascade_route(text).alias("route"),
        F.concat_ws(",", *kept).alias("stages"),
        F.concat_ws(",", *reasons.values()).alias("skipped"),
        F.round(total(0), 3).alias("latency_ms"),
        F.round(total(1), 6).alias("cost"),
    )


def stage_cost(stage: Column, latency_ms: Column) -> Column:
    """Cost of a call: the stage's rate, more the slower it was."""
    rates = F.create_map(*(F.lit(x) for kv in RATES.items() for x in kv))
    return F.coalesce(F.try_element_at(rates, stage), F.lit(0.0)) * (1 + latency_ms / 1000.0)


def health(metrics: DataFrame, slo: dict[str, float], *, stage: str = "stage", latency: str = "latency_ms", failed: str = "failed") -> DataFrame:
    """(stage, calls, p95, errors, status): status by the stage's objective and the share of errors."""
    limit = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in slo.items() for x in kv)), F.col(stage)), F.lit(1e12))
    m = metrics.groupBy(stage).agg(F.count("*").alias("calls"), F.percentile(latency, 0.95).alias("p95"), F.avg(F.col(failed).cast("double")).alias("errors"))
    status = F.when(F.col("errors") > 0.1, "failing").when(F.col("p95") > limit, "slow").otherwise("healthy")
    return m.select(stage, "calls", F.round("p95", 3).alias("p95"), F.round("errors", 6).alias("errors"), status.alias("status"))


def explain(scored: DataFrame) -> DataFrame:
    """``scored`` (score, rank, ...) with a sentence on why each row was found."""
    parts = [F.format_string("rank %d", "rank"), F.format_string("score %.3f", "score"), F.when(F.col("score") >= 0.8, "strong match").when(F.col("score") >= 0.3, "partial match").otherwise("weak match")]
    return scored.withColumn("why", F.concat_ws("; ", *parts))
