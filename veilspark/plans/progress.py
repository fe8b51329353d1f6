"""How far a run is: pages counted where they pass, reduced to a count that never falls and counts no page twice."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame, SparkSession


class _Most(AccumulatorParam):
    """Greatest count by key: a task that runs again, after a failure or beside a slow copy of itself, adds nothing."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:  # noqa: N802
        for key, n in b.items():
            a[key] = max(a.get(key, 0), n)
        return a


class Progress:
    """Pages done by phase. A phase is one pass over the pages; its tasks report when they end, so what a lost executor did not
    report is counted when another one has done it. The driver holds one number a task and phase, no pages.

    progress = Progress(spark, total); redact(pages, book, progress=progress), and from another thread progress.done or .phase.
    """

    def __init__(self, spark: SparkSession, total: int | None = None):
        self.total, self._phases, self._done = total, [], 0
        self._counts = spark.sparkContext.accumulator({}, _Most())

    def counted(self, pages: DataFrame, phase: str) -> DataFrame:
        """pages, unchanged, counted under phase as they pass; a name is for one pass only."""
        if phase in self._phases:
            raise ValueError(f"{phase} is counted already")
        self._phases.append(phase)
        counts = self._counts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, n = (phase, TaskContext.get().partitionId()), 0
            for batch in batches:
                yield batch
                n += batch.num_rows
                counts.add({at: n})

        return pages.mapInArrow(run, pages.schema)

    def by_phase(self) -> dict[str, int]:
        """Pages that have passed each phase, phases in order."""
        held = dict(self._counts.value)
        return {p: sum(n for (phase, _), n in held.items() if phase == p) for p in self._phases}

    @property
    def phase(self) -> str | None:
        """The last phase that pages have passed."""
        return next((p for p, n in reversed(self.by_phase().items()) if n), None)

    @property
    def done(self) -> int:
        """Pages done: the most that any phase has seen, at most total; it never falls, and is total once the run is finished."""
        most = max(self.by_phase().values(), default=0)
        self._done = max(self._done, most if self.total is None else min(most, self.total))
        return self._done

    def finished(self) -> None:
        if self.total is not None:
            self._done = self.total
