"""Runs over the events, a user's events being a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators import catalog, runs
from meshloom.plans.registry import query
from meshloom.plans.views import view
from meshloom.sources.shared import shared_folder
from meshloom.sources.storage import write_report
from meshloom.streaming import jobs

_SUMMARY = """
    select run_id, count(*) as total, count(*) as processed, count(*) filter (ok) as succeeded, count(*) filter (not ok) as failed, cast(0 as bigint) as not_reached,
        round(100.0::double * count(*) filter (ok) / count(*), 2) as success_rate, (epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000) / 60000 as minutes,
        (epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000) / 60000 / count(*) as minutes_per_file
    from V_RUN_EVENT group by run_id"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "V_RUN_EVENT")


def _streamed(spark: SparkSession, events: DataFrame, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of a streaming job that is started for the events, and once more for a late one of no run, which closes all that is open."""
    root, timed = shared_folder(spark, "stream"), events.withColumn("ts", F.col("ts").cast("timestamp"))
    end = timed.agg(F.max("ts").alias("ts")).select(*(F.expr("ts + interval 1 year").alias("ts") if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in timed.dtypes))
    for rows in (timed, end):
        rows.write.mode("append").parquet(f"{root}/events")
        found = job(spark.readStream.schema(timed.schema).parquet(f"{root}/events"))
        found.writeStream.outputMode("append").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{root}/out").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{root}/out")


@query(
    "progress_eta",
    """select run_id, event_id, processed, succeeded, processed - succeeded as failed, cast(floor(100.0::double * processed / total + 0.5) as bigint) as percentage,
        cast(floor(elapsed / processed * (total - processed) / 1000 + 0.5) as bigint) as eta_seconds
        from (select *, count(*) over w as processed, cast(sum(case when ok then 1 else 0 end) over w as bigint) as succeeded, count(*) over (partition by run_id) as total,
            cast(epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) over w as double) as elapsed
            from V_RUN_EVENT window w as (partition by run_id order by ts, event_id rows between unbounded preceding and current row))""",
)
def progress_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.progress_eta(_events(spark, sf_dir))


@query(
    "stall_gap",
    """select run_id, event_id, gap_ms from (select *, epoch_us(ts) // 1000 - epoch_us(lag(ts) over (partition by run_id order by ts, event_id)) // 1000 as gap_ms from V_RUN_EVENT) where gap_ms > 600000""",
)
def stall_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.stall_gap(_events(spark, sf_dir))


@query("run_summary", _SUMMARY)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_summary(_events(spark, sf_dir))


@query("run_report", f"select run_id, processed, succeeded, failed, success_rate from ({_SUMMARY})")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of all runs, written as JSON lines and read again."""
    path = shared_folder(spark, "reports")
    write_report(runs.run_summary(_events(spark, sf_dir)).select("run_id", "processed", "succeeded", "failed", "success_rate"), path)
    return spark.read.schema("run_id long, processed long, succeeded long, failed long, success_rate double").json(path)


@query(
    "stream_progress",
    """select run_id, time_bucket(interval '10 minutes', ts) as window_start, time_bucket(interval '10 minutes', ts) + interval '10 minutes' as window_end,
        count(*) as processed, count(*) filter (not ok) as failed from V_RUN_EVENT group by all""",
)
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming job over the events."""
    return _streamed(spark, _events(spark, sf_dir), jobs.stream_progress)


@query(
    "stream_stalls",
    """select run_id, min(ts) as started, max(ts) as ended, count(*) as events from (
        select *, sum(case when gap is null or gap > 600000000 then 1 else 0 end) over (partition by run_id order by ts, event_id) as part
        from (select *, epoch_us(ts) - epoch_us(lag(ts) over (partition by run_id order by ts, event_id)) as gap from V_RUN_EVENT)) group by run_id, part""",
)
def stream_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming job over the events."""
    return _streamed(spark, _events(spark, sf_dir), jobs.stream_stalls)


@query(
    "stall_alarms",
    """select run_id, since_ms, since_ms + 600000 as due_ms from (select run_id, epoch_us(ts) // 1000 as since_ms, lead(epoch_us(ts) // 1000) over (partition by run_id order by ts) as next_ms,
        max(epoch_us(ts) // 1000) over () - 1800000 as now_ms from V_RUN_EVENT) where coalesce(next_ms, 9000000000000) - since_ms > 600000 and now_ms - since_ms > 600000""",
)
def stall_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that is stopped twice: alarms up to half an hour before the last event, which may still be late."""
    rows, root = _events(spark, sf_dir), shared_folder(spark, "alarms")
    for days in ("day(ts) <= 10", "day(ts) between 11 and 20", "day(ts) > 20"):
        rows.where(days).write.mode("append").parquet(f"{root}/events")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/events")
        jobs.start_alarms(jobs.stall_alarms(stream, delay="30 minutes"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    found = spark.read.schema("run_id long, stalled_since timestamp, due timestamp").parquet(f"{root}/out")
    return found.select("run_id", F.unix_millis("stalled_since").alias("since_ms"), F.unix_millis("due").alias("due_ms"))


@query("status_counts", "select status, count(*) as files from V_VERSION group by status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.status_counts(view(spark, sf_dir, "V_VERSION"))


@query(
    "download_summary",
    """select count(*) as total, count(t.id) as succeeded, count(*) - count(t.id) as failed from V_REQUEST r left join (select distinct id from V_TIER) t on r.id = t.id""",
)
def download_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.batch_lookup(view(spark, sf_dir, "V_REQUEST").select("position", "id"), view(spark, sf_dir, "V_TIER"))
    return runs.download_summary(found)
