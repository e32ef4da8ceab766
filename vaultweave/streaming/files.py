"""File-event streams: bursts, renames and the pending-state machine.

The functions take batch or streaming frames alike; on a stream the frame must
carry a watermark on its time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounce(events: DataFrame, path: str, ts: str, quiet: str, kind: str) -> DataFrame:
    """(path, started, ended, n, last_type): the events of a path joined while no pause reaches ``quiet``."""
    window = F.session_window(F.col(ts), quiet)
    return events.groupBy(path, window.alias("_w")).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("n"), F.max_by(kind, ts).alias("last_type")).drop("_w")


def renames(deleted: DataFrame, created: DataFrame, content: str, path: str, within: str) -> DataFrame:
    """Pairs ``d``, ``c`` of a deletion and a later creation of the same content at another path within ``within``."""
    near = F.expr(f"c.ts >= d.ts AND c.ts <= d.ts + INTERVAL {within}")
    same = (F.col(f"d.{content}") == F.col(f"c.{content}")) & (F.col(f"d.{path}") != F.col(f"c.{path}")) & near
    if deleted.isStreaming or created.isStreaming:
        return deleted.alias("d").join(created.alias("c"), same)
    # A content of few values would meet all its rows; in buckets of time only those of the same or the next one meet.
    bucket = lambda ts: F.floor(ts.cast("timestamp").cast("double") / _seconds(within))
    d = deleted.withColumn("_bucket", F.explode(F.array(bucket(F.col("ts")), bucket(F.col("ts")) + 1))).alias("d")
    c = created.withColumn("_bucket", bucket(F.col("ts"))).alias("c")
    return d.join(c, (F.col("d._bucket") == F.col("c._bucket")) & same)


def _seconds(interval: str) -> float:
    """The length of an interval like ``10 minutes``."""
    n, unit = interval.split()
    return float(n) * {"millisecond": 0.001, "second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.lower().rstrip("s")]


def _pending(state: str | None, kind: str) -> str | None:
    """The pending kind after one more event: a creation absorbs changes, a deletion cancels it."""
    if state is None:
        return kind
    if state == "created":
        return None if kind == "deleted" else "created"
    if state == "deleted" and kind == "created":
        return "modified"
    return kind


def pending_changes(events: DataFrame, path: str = "path", kind: str = "kind", seq: str = "seq", content: str = "hash", ts: str = "ts", quiet: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(path, kind, hash): what a watcher would emit for each path of a stream in append mode.

    A path's events wait until the watermark (``late`` behind the latest event)
    is ``quiet`` past its last one; what they come to together is emitted then.  A
    creation that is deleted again meanwhile, in whatever micro-batch, emits
    nothing, nor does a change that leaves the content as it was emitted last.
    """
    wait = int(1000 * _seconds(quiet))

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # What is pending, the content it leads to, the content emitted last, the time of the last event.
        pending, now, last, at = state.get if state.exists else (None, None, None, 0)
        out = []

        def emit() -> None:
            nonlocal pending, last
            if pending and not (pending == "modified" and now == last):
                out.append((key[0], pending, now))
                last = None if pending == "deleted" else now
            pending = None

        if state.hasTimedOut:
            emit()
            if last is None:
                state.remove()
            else:
                state.update((None, None, last, at))
        else:
            rows = pd.concat(list(batches)).sort_values(seq)
            for k, h, t in zip(rows[kind], rows[content], rows[ts]):
                ms = int(t.timestamp() * 1000)
                if ms - at >= wait:  # it had been quiet before this one
                    emit()
                pending, now, at = _pending(pending, k), h, max(at, ms)
            state.update((pending, now, last, at))
            # A time already past would be refused.
            state.setTimeoutTimestamp(max(at + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[path, "kind", "hash"])

    marked = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return marked.groupBy(path).applyInPandasWithState(step, f"{path} string, kind string, hash string", "pending string, now string, last string, at long", "append", "EventTimeTimeout")


def fold_pending(kinds: list[str]) -> str | None:
    """The pending kind after a list of events."""
    state = None
    for k in kinds:
        state = _pending(state, k)
    return state
