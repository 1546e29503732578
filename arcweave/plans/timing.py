"""Where the time of a run goes, in milliseconds.

Phases of the driver are timed as they pass. What the tasks did in the meantime comes from Spark's own record of stages:
computing, writing what is shuffled (scatter) and waiting for it (gather), as time of one core each. There is no device
besides the processors, so its columns are 0.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Columns of a run, in the order in which they are printed.
COLUMNS = ("total", "exec", "init", "comp", "comm", "finalize", "cpu_comp", "gpu_comp", "gpu_total_comp", "scatter", "gather", "aggr", "trv_edges", "exec_rate")


class Timers:
    """Phases are added up by name: with timers.phase("init"): ..."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.ms = spark, {}
        self._stages = self._last_stage()

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.ms[name] = self.ms.get(name, 0.0) + 1000 * (time.perf_counter() - began)

    def _list(self):
        context = self.spark.sparkContext
        quantiles = context._gateway.new_array(context._jvm.double, 0)
        empty = context._jvm.java.util.ArrayList()
        stages = context._jsc.sc().statusStore().stageList(empty, False, False, quantiles, empty)
        return [stages.apply(i) for i in range(stages.size())]

    def _last_stage(self) -> int:
        return max((s.stageId() for s in self._list()), default=-1)

    def row(self, traversed: int) -> dict[str, float]:
        """All columns. exec is the phase of that name; comp and comm split it as the tasks' time is split."""
        own = [s for s in self._list() if s.stageId() > self._stages]
        run, scatter, gather = sum(s.executorRunTime() for s in own), sum(s.shuffleWriteTime() for s in own) / 1e6, sum(s.shuffleFetchWaitTime() for s in own)
        took = self.ms.get("exec", 0.0)
        share = min(1.0, (scatter + gather) / run) if run else 0.0
        out = {c: self.ms.get(c, 0.0) for c in COLUMNS}
        out |= {"total": sum(self.ms.values()), "comp": took * (1 - share), "comm": took * share, "cpu_comp": sum(s.executorCpuTime() for s in own) / 1e6, "scatter": scatter, "gather": gather}
        return out | {"trv_edges": traversed, "exec_rate": traversed / max(took, 1e-6) / 1e6}
