"""Ending a stream at a batch boundary, and telling how far it has come."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


class Stopper:
    """Ends a query after the batch under way once a signal (by default an interrupt or a request to terminate) comes."""

    def __init__(self, query: StreamingQuery, signals: tuple[int, ...] = (signal.SIGINT, signal.SIGTERM)):
        self.query, self.asked, self.before = query, threading.Event(), {}
        for s in signals:
            self.before[s] = signal.signal(s, lambda *_: self.asked.set())

    def wait(self, every: float = 0.2) -> bool:
        """Until the query ends by itself (false) or was asked to (true); restores the signals' handlers."""
        try:
            while self.query.isActive:
                if self.asked.wait(every):
                    while self.query.isActive and self.query.status["isTriggerActive"]:
                        threading.Event().wait(every)
                    self.query.stop()
                    return True
            return False
        finally:
            for s, f in self.before.items():
                signal.signal(s, f)


def progress(query: StreamingQuery) -> list[dict]:
    """(batch, rows, rows a second) of the latest batches."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p.get("processedRowsPerSecond")} for p in query.recentProgress]


def counting(every: int, tell: Callable[[int, int], None]) -> Callable[[DataFrame, int], None]:
    """A step for ``foreachBatch`` that counts rows and calls ``tell(batch, rows so far)`` each time ``every`` more have come."""
    seen = {"n": 0, "told": 0}

    def step(batch: DataFrame, number: int) -> None:
        seen["n"] += batch.count()
        if seen["n"] // every > seen["told"]:
            seen["told"] = seen["n"] // every
            tell(number, seen["n"])

    return step
