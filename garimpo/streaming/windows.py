"""Event-time windows with watermarks, and stateful spike detection on a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, every: str = "1 hour", late: str | None = None, time: str = "ts", key: str = "event_type") -> DataFrame:
    """(begin, key, n, total) of each window; on a stream, rows later than ``late`` are left out."""
    e = events.withWatermark(time, late) if late else events
    got = e.groupBy(F.window(time, every), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").alias("begin"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", time: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, begin, n) of each run of events less than ``gap`` apart."""
    return events.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("begin"), "n")


def stream_spikes(log: DataFrame, threshold: float = 0.3, beta: float = 0.98) -> DataFrame:
    """(run, line, spike) of a stream of (run, line, loss); each run's average is kept as state."""

    def step(key, frames, state: GroupState):
        ema = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("line")
        out = []
        for line, v in zip(rows["line"], rows["loss"]):
            hit = False
            if v is not None and v == v and abs(v) != float("inf"):
                if ema is None:
                    ema = float(v)
                elif v > ema * (1 + threshold):
                    hit = True
                else:
                    ema = beta * ema + (1 - beta) * float(v)
            out.append((key[0], line, hit))
        state.update((ema,))
        yield pd.DataFrame(out, columns=["run", "line", "spike"])

    return log.groupBy("run").applyInPandasWithState(step, "run string, line bigint, spike boolean", "ema double", "append", GroupStateTimeout.NoTimeout)
