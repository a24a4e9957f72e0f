"""Runs over many files: progress, stalls and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A run stands still if nothing has happened for more than so many milliseconds.
STALL_MS = 600_000
#: Milliseconds of a run that one task handles.
SLICE_MS = 3_600_000


def millis(ts: Column) -> Column:
    """Milliseconds of a timestamp with or without a time zone (then the session's)."""
    return F.unix_millis(ts.cast("timestamp"))


def _slice() -> Column:
    return F.floor(millis(F.col("ts")) / SLICE_MS)


def progress_eta(events: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """After each event of a run: how many are processed, succeeded and failed, the percentage, and the seconds left.

    ``events`` holds ``(run_id, event_id, ts, ok)``; the seconds left are the mean
    time since the run's first event times what remains. Without ``totals``
    (``run_id, total``) a run's total is its number of events. Runs are cut into
    slices of time; sums of the slices before are added to the places within one,
    so a long run isn't one task's.

    No event is lost: a null run is a run of its own, and events without a time come
    first in theirs, with no seconds left. A run that ``totals`` doesn't name counts
    its events.
    """
    ok, ms = F.col("ok").cast("long"), millis(F.col("ts"))
    slices = events.groupBy("run_id", _slice().alias("slice")).agg(F.count("*").alias("n"), F.coalesce(F.sum(ok), F.lit(0)).alias("good"), F.min(ms).alias("first"))
    earlier = Window.partitionBy("run_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("run_id")
    slices = slices.select("run_id", "slice", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("n", "good")), F.min("first").over(whole).alias("began"), F.sum("n").over(whole).alias("total"))
    if totals is not None:
        given = totals.select(F.col("run_id").alias("_run"), F.col("total").alias("_total"))
        slices = slices.join(given, F.col("run_id").eqNullSafe(F.col("_run")), "left").withColumn("total", F.coalesce("_total", "total")).drop("_run", "_total")
    upto = Window.partitionBy("run_id", "slice").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    slices = slices.withColumnsRenamed({"run_id": "_run", "slice": "_slice"})
    same = F.col("run_id").eqNullSafe(F.col("_run")) & F.col("slice").eqNullSafe(F.col("_slice"))
    rows = events.withColumn("slice", _slice()).join(slices, same).withColumns(
        {
            "processed": F.col("n_before") + F.count("*").over(upto),
            "succeeded": F.col("good_before") + F.coalesce(F.sum(ok).over(upto), F.lit(0)),
            "elapsed_ms": ms - F.col("began"),
        }
    )
    left = F.col("total") - F.col("processed")
    return rows.select(
        "run_id",
        "event_id",
        "processed",
        "succeeded",
        (F.col("processed") - F.col("succeeded")).alias("failed"),
        F.floor(F.lit(100.0) * F.col("processed") / F.col("total") + 0.5).alias("percentage"),
        F.floor(F.col("elapsed_ms") / F.col("processed") * left / 1000 + 0.5).alias("eta_seconds"),
    )


def stall_gap(events: DataFrame, limit_ms: int = STALL_MS) -> DataFrame:
    """Events that come more than ``limit_ms`` after the one before in their run, with the gap.

    The event before a slice's first one is the last of the slice before. An event
    without a time has no gap; a null run is a run of its own.
    """
    ms = millis(F.col("ts"))
    slices = events.where("ts is not null").groupBy("run_id", _slice().alias("slice")).agg(F.max(ms).alias("last"))
    slices = slices.select(F.col("run_id").alias("_run"), F.col("slice").alias("_slice"), F.lag("last").over(Window.partitionBy("run_id").orderBy("slice")).alias("before"))
    order = Window.partitionBy("run_id", "slice").orderBy("ts", "event_id")
    rows = events.withColumn("slice", _slice()).join(slices, F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("slice") == F.col("_slice")))
    gap = ms - F.coalesce(millis(F.lag("ts").over(order)), F.col("before"))
    return rows.withColumn("gap_ms", gap).where(F.col("gap_ms") > limit_ms).select("run_id", "event_id", "gap_ms")


def sessions(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Stretches of a run without a stall: start, end (of the last event) and events."""
    found = events.groupBy("run_id", F.session_window("ts", gap).alias("s")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events"))
    return found.drop("s")


def run_summary(events: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Per run: total, processed, succeeded, failed, not reached, success rate in percent, minutes, and minutes a file."""
    found = events.groupBy("run_id").agg(
        F.count("*").alias("processed"), F.count_if("ok").alias("succeeded"), ((millis(F.max("ts")) - millis(F.min("ts"))) / 60000).alias("minutes")
    )
    found = found.join(totals, "run_id") if totals is not None else found.withColumn("total", F.col("processed"))
    return found.select(
        "run_id",
        "total",
        "processed",
        "succeeded",
        (F.col("processed") - F.col("succeeded")).alias("failed"),
        (F.col("total") - F.col("processed")).alias("not_reached"),
        F.round(F.try_divide(F.lit(100.0) * F.col("succeeded"), F.col("total")), 2).alias("success_rate"),
        "minutes",
        F.try_divide(F.col("minutes"), F.col("processed")).alias("minutes_per_file"),
    )


def status_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("status").agg(F.count("*").alias("files"))


def download_summary(lookups: DataFrame) -> DataFrame:
    """One row: how many of the looked-up files were found, and of how many."""
    return lookups.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def tumbling_progress(events: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Processed and failed events of each run in windows of time; a streaming input needs a watermark."""
    found = events.groupBy("run_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("processed"), F.count_if(~F.col("ok")).alias("failed"))
    return found.select("run_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "processed", "failed")
