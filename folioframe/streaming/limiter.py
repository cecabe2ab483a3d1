"""The rate limiter and the request figures over streams, in event time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RateLimit
from ..operators.limits import DAY, Usage, checked_shape

STATE = "minute long, hour long, today long, bytes_today long, last long, day long"


def limited(requests: DataFrame, limits: RateLimit, delay: str | None = None) -> DataFrame:
    """A stream of requests (event_id, user_id, ts, data_size) with verdicts, as the batch replay gives them.

    The clock is the requests' ts. A trigger's rows are put in order by user;
    a request older than one seen in an earlier trigger counts as it comes. Other columns stay. A trigger's requests of
    one user are sorted in one task: bound them by the source's options for the size of a trigger.

    With a ``delay`` (as ``10 minutes``) the stream has a watermark: a user's
    state goes once the watermark has passed the day of the last request, after
    which every counter would start anew, so verdicts stay those of the replay.
    Requests older than the watermark get the verdict ``late`` and change no counter. Without
    a delay all users' states stay.
    """
    rows = requests.drop("verdict", "wait_us").withColumn("user_id", F.col("user_id").cast("long"))
    shape = checked_shape(rows)
    if delay is not None:
        rows = rows.withWatermark("ts", delay)
    rows = rows.withColumn("__us", F.unix_micros("ts"))

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mark = state.getCurrentWatermarkMs() if delay is not None else 0
        usage = Usage(*[None if v is None else int(v) for v in state.get]) if state.exists else Usage()
        part = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        late = [int(now) // 1000 < mark for now in part["__us"]]
        found = [("late", 0) if old else usage.check(int(now), int(size), limits) for now, size, old in zip(part["__us"], part["data_size"], late, strict=True)]
        if usage.last is not None:
            state.update((usage.minute, usage.hour, usage.today, usage.bytes_today, usage.last, usage.day))
            if delay is not None:
                newest = max([int(us) for us, old in zip(part["__us"], late, strict=True) if not old], default=usage.last)
                # an hour beyond the day's end: the gaps of minute and hour are over as well
                state.setTimeoutTimestamp(max(mark + 1, ((max(newest, usage.last) // DAY + 1) * DAY + DAY // 24) // 1000))
        part = part.drop(columns="__us")
        part["verdict"], part["wait_us"] = [v for v, _ in found], [w for _, w in found]
        yield part

    return rows.groupBy("user_id").applyInPandasWithState(run, shape, STATE, "append", "NoTimeout" if delay is None else "EventTimeTimeout")


def running_counts(requests: DataFrame, *keys: str, window: str | None = None, delay: str | None = None) -> DataFrame:
    """Requests and bytes by the keys so far; for output mode complete or update.

    With ``window`` (as ``1 hour``) the figures are of windows of ts, first and
    last in columns start and end. With a ``delay`` too, windows that the watermark has passed
    are closed: they go out once in mode append, their state goes, and rows that come later for them are left out.
    """
    rows = requests if delay is None else requests.withWatermark("ts", delay)
    by = [*keys] if window is None else [*keys, F.window("ts", window).alias("window")]
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("data_size").alias("bytes"))
    return found if window is None else found.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "bytes")


def progress(rows: DataFrame, sink, name: str, checkpoint: str):
    """Run a stream into ``sink(batch DataFrame, batch id)`` and return the query; a batch that was written before may come again under the same id."""
    return rows.writeStream.foreachBatch(sink).queryName(name).option("checkpointLocation", checkpoint).start()
