"""What a run took and made: stages with their times, metrics, as Markdown and JSON."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Stages and metrics that a report has room for; more are left out.
MAX_STAGES, MAX_METRICS = 32, 64


class Report:
    """Timings by stage and metrics by name, in the order in which they came."""

    def __init__(self) -> None:
        self.stages: list[tuple[str, float]] = []
        self.metrics: list[tuple[str, str]] = []
        self._began = time.perf_counter()
        self._watched: list[Observation] = []

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            if len(self.stages) < MAX_STAGES:
                self.stages.append((name, (time.perf_counter() - began) * 1000))

    def metric(self, name: str, value: object) -> None:
        if len(self.metrics) < MAX_METRICS:
            self.metrics.append((name, str(value)))

    def watch(self, rows: DataFrame) -> DataFrame:
        """rows, of which files, shown files, bytes and tokens are counted while they are computed: no job of their own."""
        seen = Observation()
        self._watched.append(seen)
        ok = F.col("status") == "ok"
        return rows.observe(
            seen, F.count_if(F.col("kind") == "file").alias("files"), F.count_if(ok).alias("shown"), F.coalesce(F.sum("section_bytes"), F.lit(0)).alias("bytes"),
            F.coalesce(F.sum(F.when(ok, F.col("section_tokens"))), F.lit(0)).alias("tokens"),
        )

    def gather(self) -> None:
        """The watched counts as metrics, once the rows were computed."""
        for seen in self._watched:
            for name, value in seen.get.items():
                self.metric(name, value)
        self._watched = []

    def total_ms(self) -> float:
        return (time.perf_counter() - self._began) * 1000

    def to_markdown(self) -> str:
        lines = ["## Profile", "", "| Stage | Time |", "|---|---|", *(f"| {n} | {ms:.1f}ms |" for n, ms in self.stages), f"| **Total** | {self.total_ms():.0f}ms |", ""]
        if self.metrics:
            lines += ["| Metric | Value |", "|---|---|", *(f"| {n} | {v} |" for n, v in self.metrics)]
        return "\n".join(lines) + "\n"

    def to_json(self) -> str:
        return json.dumps({"totalMs": round(self.total_ms()), "stages": dict(self.stages), "metrics": dict(self.metrics)})
