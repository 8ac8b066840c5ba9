"""A registry of stages that users add, and the schedule of periodic jobs.

A stage is a function from a DataFrame to a DataFrame under a name; a plan is a
list of names. Hooks run before and after every stage and may only look.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]


class Registry:
    def __init__(self):
        self._stages: dict[str, Stage] = {}
        self._hooks: list[Callable[[str, DataFrame], None]] = []

    def register(self, name: str, stage: Stage) -> "Registry":
        if name in self._stages:
            raise ValueError(f"stage {name!r} is registered already")
        self._stages[name] = stage
        return self

    def hook(self, f: Callable[[str, DataFrame], None]) -> "Registry":
        self._hooks.append(f)
        return self

    def run(self, df: DataFrame, plan: list[str]) -> DataFrame:
        missing = [n for n in plan if n not in self._stages]
        if missing:
            raise KeyError(f"no stage named {missing[0]!r}")
        for name in plan:
            df = df.transform(self._stages[name])
            for h in self._hooks:
                h(name, df)
        return df


#: Steps between runs of the periodic jobs (fixed values); decay runs at every step.
PERIODS = {"decay": 1, "prune": 10, "topology": 50}


def due_jobs(steps: DataFrame, step: str = "step", size: str = "nodes") -> DataFrame:
    """(step, job): the jobs due at each step; consolidation every 100 steps, every 50 from 500 nodes on and every 20 from 2,000 on."""
    every = F.when(F.col(size) >= 2000, 20).when(F.col(size) >= 500, 50).otherwise(100)
    jobs = [F.when(F.col(step) % n == 0, F.lit(j)) for j, n in PERIODS.items()] + [F.when(F.col(step) % every == 0, F.lit("consolidate"))]
    return steps.select(step, F.explode(F.array_compact(F.array(*jobs))).alias("job"))
