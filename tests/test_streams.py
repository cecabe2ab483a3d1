"""Streams in event time: the limiter's state goes after its day, windows close behind the watermark."""

from pyspark.sql import functions as F

from folioframe.config import RateLimit
from folioframe.operators import limits
from folioframe.streaming import limiter

REQUEST = "event_id long, user_id long, ts string, data_size long"


def ran(spark, tmp_path, name, parts, plan, mode="append"):
    """(rows, last progress, all progress) of a stream that gets one part a trigger."""
    shape = spark.createDataFrame([], REQUEST).withColumn("ts", F.to_timestamp("ts")).schema
    folder = tmp_path / name
    (folder / "in").mkdir(parents=True)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    query = plan(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / "cp")).outputMode(mode).start()
    try:
        for part in parts:
            spark.createDataFrame(part, REQUEST).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(folder / "in"))
            query.processAllAvailable()
        return spark.table(name).collect(), [p for p in query.recentProgress if p["stateOperators"]]
    finally:
        query.stop()


def at(i, user, day, minute, second=0, size=10):
    return (i, user, f"2024-01-{day:02d} 10:{minute:02d}:{second:02d}", size)


def test_state_goes_after_the_day_and_late_rows_are_told(spark, tmp_path):
    parts = [
        [at(i, i % 5, 1, i) for i in range(20)],
        [at(20 + i, 1, 1, 30 + i) for i in range(5)],
        [at(40 + i, 7, 4, i) for i in range(4)],  # three days on: the watermark passes the others' day
        [at(50, 8, 4, 10)],
        [at(60, 1, 4, 11), at(61, 1, 1, 50), at(62, 9, 1, 50)],  # one in time, two far behind the watermark
        [at(63, 1, 4, 12)],
    ]
    rules = RateLimit(per_minute=2, per_hour=6, requests_per_day=7, bytes_per_day=100)
    rows, progress = ran(spark, tmp_path, "limits_by_day", parts, lambda s: limiter.limited(s, rules, "1 hour"))
    found = {r.event_id: r.verdict for r in rows}
    late = {61, 62}
    assert {i for i, v in found.items() if v == "late"} <= late
    kept = [r for part in parts for r in part if r[0] not in late]
    want = {r.event_id: r.verdict for r in limits.replay(spark.createDataFrame(kept, REQUEST).withColumn("ts", F.to_timestamp("ts")), rules).collect()}
    assert {i: v for i, v in found.items() if i not in late} == want and "hour" in want.values()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(sizes) >= 5 and sizes[-1] <= 3  # users 7, 8 and 1 of the last day


def test_windows_close_behind_the_watermark(spark, tmp_path):
    parts = [[at(1, 1, 1, 5), at(2, 1, 1, 6), at(3, 2, 1, 7)], [at(4, 1, 2, 0)], [at(5, 1, 1, 8), at(6, 2, 2, 1)], [at(7, 3, 3, 0)]]
    rows, progress = ran(spark, tmp_path, "closed_hours", parts, lambda s: limiter.running_counts(s, "user_id", window="1 hour", delay="10 minutes"))
    got = sorted((r.user_id, r.start.day, r.n, r.bytes) for r in rows)
    assert got == [(1, 1, 2, 20), (1, 2, 1, 10), (2, 1, 1, 10), (2, 2, 1, 10)]  # event 5 came too late for its window
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 1


def test_running_counts_so_far(spark, tmp_path):
    parts = [[at(1, 1, 1, 5), at(2, 2, 1, 6, size=7)], [at(3, 1, 1, 7, size=5)]]
    rows, _ = ran(spark, tmp_path, "so_far", parts, lambda s: limiter.running_counts(s, "user_id"), "complete")
    assert sorted((r.user_id, r.n, r.bytes) for r in rows) == [(1, 2, 15), (2, 1, 7)]
    batch = limiter.running_counts(spark.createDataFrame(parts[0], REQUEST).withColumn("ts", F.to_timestamp("ts")), window="1 hour")
    assert [(r.n, r.bytes) for r in batch.collect()] == [(2, 17)]
