"""Keyed limits and running figures.

A user's counters depend on the requests accepted before, so the replay is a
fold over each user's requests in time order; the streaming form keeps the
same state (see ``streaming.limiter``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RateLimit

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000

# Bucket bounds of the request histograms.
DURATION_BOUNDS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0)
TEXT_LENGTH_BOUNDS = (0, 10, 50, 100, 500, 1000, 5000, 10000, 50000)
REGION_BOUNDS = (0, 1, 5, 10, 25, 50, 100, 250, 500)
UPLOAD_BOUNDS = (1024, 10240, 102400, 1048576, 10485760, 52428800, 104857600)


@dataclass
class Usage:
    """A user's state; times in microseconds."""

    minute: int = 0
    hour: int = 0
    today: int = 0
    bytes_today: int = 0
    last: int | None = None
    day: int | None = None

    def check(self, now: int, size: int, limits: RateLimit) -> tuple[str, int]:
        """(verdict, microseconds to wait or to the next midnight) of a request, counting it if it is accepted.

        The minute's and hour's counters start anew when the last accepted
        request is that long ago; the day's on another date. Refused requests
        change no counter.
        """
        if self.last is None:
            self.last, self.day = now, now // DAY
        if now // DAY != self.day:
            self.today = self.bytes_today = 0
            self.day = now // DAY
        gap = now - self.last
        if gap >= MINUTE:
            self.minute = 0
        if gap >= HOUR:
            self.hour = 0
        if 0 < limits.per_minute <= self.minute:
            return "minute", MINUTE - gap
        if 0 < limits.per_hour <= self.hour:
            return "hour", HOUR - gap
        midnight = (now // DAY + 1) * DAY - now
        if 0 < limits.requests_per_day <= self.today:
            return "requests", midnight
        if limits.bytes_per_day > 0 and self.bytes_today + size > limits.bytes_per_day:
            return "data", midnight
        self.minute, self.hour, self.today = self.minute + 1, self.hour + 1, self.today + 1
        self.bytes_today, self.last = self.bytes_today + size, now
        return "ok", 0


VERDICT = "verdict string, wait_us long"


def checked_shape(requests: DataFrame) -> str:
    """The columns of ``requests``, all of them, with verdict and wait_us."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema if f.name not in ("verdict", "wait_us"))
    return f"{own}, {VERDICT}"


def replay(requests: DataFrame, limits: RateLimit) -> DataFrame:
    """Each request with its verdict: ok, minute, hour, requests or data; users in parallel, a user's rows streamed in time order. Other columns stay."""
    rows = requests.drop("verdict", "wait_us").withColumn("user_id", F.col("user_id").cast("long"))
    shape = checked_shape(rows)
    rows = rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").withColumn("__us", F.unix_micros("ts"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, usage = None, Usage()
        for part in parts:  # a user's rows may go on in the next batch
            found = []
            for u, now, size in zip(part["user_id"], part["__us"], part["data_size"], strict=True):
                if u != user:
                    user, usage = u, Usage()
                found.append(usage.check(int(now), int(size), limits))
            part = part.drop(columns="__us")
            part["verdict"], part["wait_us"] = [v for v, _ in found], [w for _, w in found]
            yield part

    return rows.mapInPandas(run, shape)


def rejections(checked: DataFrame, limits: RateLimit) -> DataFrame:
    """The refused requests as what a client is told: kind (rate or quota), type, limit, retry_after_us, and for quotas when they reset.

    A rate's wait runs from the request; quotas reset at the next midnight.
    """
    most = {"minute": limits.per_minute, "hour": limits.per_hour, "requests": limits.requests_per_day, "data": limits.bytes_per_day}
    limit = F.coalesce(*[F.when(F.col("verdict") == k, F.lit(v).cast("long")) for k, v in most.items()])
    quota = F.col("verdict").isin("requests", "data")
    return checked.filter("verdict <> 'ok'").select(
        "event_id",
        "user_id",
        F.when(quota, "quota").otherwise("rate").alias("kind"),
        F.col("verdict").alias("type"),
        limit.alias("limit"),
        F.when(~quota, F.col("wait_us")).alias("retry_after_us"),
        F.when(quota, F.date_trunc("day", "ts") + F.expr("interval 1 day")).alias("resets"),
    )


def run_statistics(results: DataFrame, seconds: float, workers: int) -> DataFrame:
    """One row for results (error): total, processed, failed, workers, seconds an image and images a second, 0 where none was processed."""
    done = F.count(F.when(F.col("error").isNull(), 1))
    some = lambda x: F.when(F.col("processed") > 0, x).otherwise(0.0)
    out = results.agg(F.count("*").alias("total"), done.alias("processed"), F.count("error").alias("failed"))
    return out.select("*", F.lit(workers).alias("workers"), some(F.lit(float(seconds)) / F.col("processed")).alias("seconds_each"), some(F.col("processed") / F.lit(float(seconds))).alias("per_second"))


def profile(records: DataFrame, *keys: str) -> DataFrame:
    """Records (det_ns, rec_ns, regions), one an image, summed by the keys (none: all): counts, whole milliseconds, milliseconds an image."""
    out = records.groupBy(*keys).agg(F.count("*").alias("images"), F.coalesce(F.sum("regions"), F.lit(0)).alias("regions"), F.coalesce(F.sum("det_ns"), F.lit(0)).alias("det"), F.coalesce(F.sum("rec_ns"), F.lit(0)).alias("rec"))
    whole = lambda c: F.floor(F.col(c) / 1_000_000).cast("long").alias(f"{c}_ms_total")
    each = lambda c: F.when(F.col("images") > 0, F.col(c) / 1_000_000 / F.col("images")).alias(f"{c}_ms_per_image")
    return out.select(*keys, "images", "regions", whole("det"), whole("rec"), each("det"), each("rec"))


def hour_of(us: Column) -> Column:
    """The hour of a time in microseconds; no time is before all others, as in their order."""
    return F.coalesce(us - F.pmod(us, F.lit(HOUR)), F.lit(-(1 << 62)))


def _with_sums(rows: DataFrame, sums: DataFrame, key: str) -> DataFrame:
    """Rows with the figures of their key and slot."""
    sums = sums.select(F.col(key).alias("__key"), F.col("__slot").alias("__at"), *[c for c in sums.columns if c not in (key, "__slot")])
    return rows.join(sums, F.col(key).eqNullSafe(F.col("__key")) & F.col("__slot").eqNullSafe(F.col("__at"))).drop("__key", "__at")


def gap_counters(requests: DataFrame) -> DataFrame:
    """The requests with minute and hour counters, all being accepted: how many are in the run without such a gap so far.

    A user's requests are counted by hours, and one row an hour carries the runs on from one to the next: no user is one task.
    """
    rows = requests.withColumn("__us", F.unix_micros("ts")).withColumn("__slot", hour_of(F.col("__us")))
    inside = Window.partitionBy("user_id", "__slot").orderBy("ts", "event_id")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"__n": F.row_number().over(inside), "__gap": F.col("__us") - F.lag("__us").over(inside)})
    kinds = {"minute": MINUTE, "hour": HOUR}
    rows = rows.withColumns({f"__{k}": F.max(F.when(F.col("__gap") >= most, F.col("__n"))).over(so_far) for k, most in kinds.items()})  # where the run began, null: before the hour
    tails = [(F.count("*") - F.max(f"__{k}") + 1).alias(f"tail_{k}") for k in kinds]
    sums = rows.groupBy("user_id", "__slot").agg(F.count("*").alias("n"), F.min("__us").alias("first"), F.max("__us").alias("last"), *tails)
    hours = Window.partitionBy("user_id").orderBy("__slot")
    for k, most in kinds.items():
        fresh = F.coalesce(F.col("first") - F.lag("last").over(hours) >= most, F.lit(False))
        sums = sums.withColumn("fresh", fresh).withColumn("run", F.sum((F.col("fresh") | F.col(f"tail_{k}").isNotNull()).cast("int")).over(hours))
        sums = sums.withColumn("all", F.sum(F.coalesce(f"tail_{k}", "n")).over(Window.partitionBy("user_id", "run").orderBy("__slot")))
        sums = sums.withColumn(f"__from_{k}", F.when(F.col("fresh"), 0).otherwise(F.coalesce(F.lag("all").over(hours), F.lit(0))))
    rows = _with_sums(rows, sums.select("user_id", "__slot", *[f"__from_{k}" for k in kinds]), "user_id")
    count = lambda k: F.coalesce(F.col("__n") - F.col(f"__{k}") + 1, F.col("__n") + F.col(f"__from_{k}")).cast("int")
    return rows.select(*requests.columns, *[count(k).alias(k) for k in kinds])


def daily_quota(requests: DataFrame) -> DataFrame:
    """(user_id, day, n, bytes) used on each date, as yyyy-MM-dd."""
    return requests.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.sum("data_size").alias("bytes"))


def cumulative_histogram(rows: DataFrame, key: str, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """(key, le, n): rows at or under each bound; a null bound is infinity."""
    counts = rows.groupBy(key).agg(*[F.count(F.when(F.col(value) <= b, 1)).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("all"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("all").alias("n")))
    return counts.select(key, F.explode(F.array(*cells)).alias("c")).select(key, "c.le", "c.n")


def moving_memory(samples: DataFrame, last: int = 60, slot: Column | None = None, piece: int = 4096) -> DataFrame:
    """Samples (host, ts, bytes) with the mean of the last ones and the peak so far.

    With ``slot``, a column that never falls as ts grows (its hour), a host with many samples is not one task: peaks and
    numbers are carried on from slot to slot, means taken in pieces of so many samples and the few before them.
    """
    if slot is None:
        order = Window.partitionBy("host").orderBy("ts")
        return samples.withColumns({"mean": F.avg("bytes").over(order.rowsBetween(-(last - 1), 0)), "peak": F.max("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    piece = max(piece, last)
    inside = Window.partitionBy("host", "__slot").orderBy("ts")
    rows = samples.withColumn("__slot", slot)
    rows = rows.withColumns({"__n": F.row_number().over(inside), "peak": F.max("bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    before = Window.partitionBy("host").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("host", "__slot").agg(F.count("*").alias("n"), F.max("bytes").alias("most"))
    sums = sums.select("host", "__slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"), F.max("most").over(before).alias("__most"))
    rows = _with_sums(rows, sums, "host").withColumns({"__n": F.col("__before") + F.col("__n") - 1, "peak": F.greatest("peak", "__most")})
    own = F.floor(F.col("__n") / piece)
    rows = rows.withColumn("__piece", F.explode(F.when(F.col("__n") % piece > piece - last, F.array(own, own + 1)).otherwise(F.array(own))))
    near = Window.partitionBy("host", "__piece").orderBy("__n").rowsBetween(-(last - 1), 0)
    rows = rows.withColumn("mean", F.avg("bytes").over(near)).filter(F.col("__piece") == own)
    return rows.select(*samples.columns, "mean", "peak")


def batch_summary(results: DataFrame, seconds: Column | float | None = None) -> DataFrame:
    """One row for results (ms, error): total, done, failed, mean_ms, and per_second if the elapsed time is given."""
    out = results.agg(F.count("*").alias("total"), F.count(F.when(F.col("error").isNull(), 1)).alias("done"), F.count("error").alias("failed"), F.coalesce(F.avg(F.when(F.col("error").isNull(), F.col("ms"))), F.lit(0.0)).alias("mean_ms"))
    return out if seconds is None else out.withColumn("per_second", F.col("done") / seconds)
