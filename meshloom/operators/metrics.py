"""Complexity metrics of assets: what must be computed, which assets pass, and how values are distributed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.sources.shared import shared_folder

#: Metrics that statistics cover, in order.
STATISTIC_METRICS = ("material_count", "vvd", "vfc", "vsc", "vertex_count", "face_count", "occupied")
BINS = 50
#: Slices of a metric's values in which they are ranked, about equally many in each.
RANK_BINS = 128


def metrics_status(assets: DataFrame, required: tuple[str, ...], resolution: int) -> DataFrame:
    """``assets`` with ``needs_compute``, ``missing_metrics``, ``available_metrics``, ``resolution_mismatch`` and ``reason``.

    Expects ``has_metrics``, ``voxel_resolution``, ``material_count`` and the metrics as columns.
    """
    every = F.array(*(F.lit(m) for m in required))
    missing = F.array_compact(F.array(*(F.when(F.col(m).isNull(), m) for m in required)))
    none, other = ~F.coalesce("has_metrics", F.lit(False)), ~F.col("voxel_resolution").eqNullSafe(F.lit(resolution))
    reason = (
        F.when(none, "no_existing_metrics")
        .when(other, "resolution_mismatch")
        .when(F.size(missing) > 0, "missing_metrics")
        .when(F.col("material_count").isNull(), "missing_material_count")
        .otherwise("complete")
    )
    stale = none | other
    return assets.withColumns(
        {
            "reason": reason,
            "needs_compute": reason != "complete",
            "missing_metrics": F.when(stale, every).otherwise(missing),
            "available_metrics": F.when(stale, F.array().cast("array<string>")).otherwise(F.array_except(every, missing)),
            "resolution_mismatch": ~none & other,
        }
    )


def merge_metrics(old: DataFrame, new: DataFrame, fields: tuple[str, ...], key: str = "model_id", now: Column | None = None) -> DataFrame:
    """Old metrics with the fields of ``new`` laid over them; from nothing, where the resolution has changed.

    Rows without new metrics stay as they are; ``last_updated`` is ``now`` for the others.
    """
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "left")
    got = F.col(f"b.{key}").isNotNull()
    changed = got & ~F.col("a.voxel_resolution").eqNullSafe(F.col("b.voxel_resolution"))
    merged = [F.when(changed, F.col(f"b.{f}")).otherwise(F.coalesce(F.col(f"b.{f}"), F.col(f"a.{f}"))).alias(f) for f in fields]
    stamp = [F.when(got, now if now is not None else F.current_timestamp()).alias("last_updated")]
    return joined.select(F.col(f"a.{key}"), *merged, *stamp)


def refreshed_metrics(old: DataFrame, asked: DataFrame, compute: Callable[[DataFrame], DataFrame], required: tuple[str, ...], resolution: int, key: str = "model_id") -> DataFrame:
    """``old`` with the metrics of the ``asked`` assets that need computing; assets that are complete are left alone.

    ``compute`` gets the keys that are due and returns their metrics, which are laid over the old ones. What it
    returns is written to the shared folder, so it is computed once.
    """
    state = asked.select(key).distinct().join(old.withColumn("has_metrics", F.lit(True)), key, "left")
    path = shared_folder(old.sparkSession, "metrics")
    compute(metrics_status(state, required, resolution).where("needs_compute").select(key)).write.parquet(path)
    fresh = old.sparkSession.read.parquet(path)
    merged = merge_metrics(old, fresh, tuple(c for c in old.columns if c != key), key).drop("last_updated")
    return merged.unionByName(fresh.join(old.select(key), key, "left_anti").select(*old.columns))


def metric_filter(assets: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """``assets`` with ``passed``, ``failures`` (in the order of ``ranges``) and ``details`` for each metric.

    Ranges are inclusive; a missing value fails.
    """
    failures, details, passed = [], [], F.lit(True)
    for name, (low, high) in ranges.items():
        value = F.col(name)
        inside = F.coalesce((value >= low) & (value <= high), F.lit(False))
        failures.append(F.when(value.isNull(), f"{name} missing").when(~inside, f"{name} out of range"))
        details.append(F.struct(value.cast("double").alias("value"), F.lit(float(low)).alias("min"), F.lit(float(high)).alias("max"), inside.alias("passed")).alias(name))
        passed &= inside
    return assets.withColumns({"passed": passed, "failures": F.array_compact(F.array(*failures)).cast("array<string>"), "details": F.struct(*details)})


def filter_outcome(filtered: DataFrame) -> DataFrame:
    """``metric_filter``'s rows with ``outcome``: missing_metrics, passed or criteria_not_met."""
    outcome = F.when(~F.coalesce("has_metrics", F.lit(False)), "missing_metrics").when(F.col("passed"), "passed").otherwise("criteria_not_met")
    return filtered.withColumn("outcome", outcome)


def filter_summary(outcomes: DataFrame) -> DataFrame:
    """Totals of a filter run; rows without metrics count apart from failed ones."""
    return outcomes.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("outcome") == "passed").alias("passed"),
        F.count_if(F.col("outcome") == "criteria_not_met").alias("failed"),
        F.count_if(F.col("outcome") == "missing_metrics").alias("missing_metrics"),
    )


def compute_summary(status: DataFrame, failed: Column) -> DataFrame:
    """Totals of a metric run: rows that need no computing are skipped, of the others those with ``failed`` failed."""
    due = F.col("needs_compute")
    return status.agg(
        F.count("*").alias("total"),
        F.count_if(due & ~failed).alias("computed"),
        F.count_if(~due).alias("skipped"),
        F.count_if(due & failed).alias("failed"),
    )


def _long(assets: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(metric, value) of all values that aren't null."""
    wide = assets.select(*(F.col(m).cast("double").alias(m) for m in metrics))
    return wide.unpivot([], list(metrics), "metric", "value").where("value is not null")


def _counted(assets: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(metric, value, n): how often each different value occurs, written to the shared folder, so that the assets are made once however often it is read."""
    path = shared_folder(assets.sparkSession, "values")
    _long(assets, metrics).groupBy("metric", "value").agg(F.count("*").alias("n")).write.parquet(path)
    return assets.sparkSession.read.parquet(path)


def ranked_values(assets: DataFrame, metrics: tuple[str, ...] = STATISTIC_METRICS) -> DataFrame:
    """(metric, value, n, below, upto, count, min, max, mean): each different value, how often it occurs,
    the values before it and up to it, and the metric's totals.

    Equal values are counted first, and all else is made from these counts, which
    are written, so the assets are made once. A metric's different values are cut at their
    approximate quantiles into RANK_BINS slices of about equally many; the counts
    of the slices are summed over a table of bounded size, and values are ranked
    within their slice, so no metric's values meet in one task.
    """
    counted = _counted(assets, metrics)
    totals = counted.groupBy("metric").agg(
        F.sum("n").alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"),
        F.percentile_approx("value", [i / RANK_BINS for i in range(1, RANK_BINS)]).alias("cuts"),
    )
    sliced = counted.join(F.broadcast(totals), "metric")  # a row for each metric
    sliced = sliced.withColumn("slice", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    slices = sliced.groupBy("metric", "slice").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("metric").orderBy("slice")) - F.col("n")
    slices = slices.select("metric", "slice", before.alias("before"))  # at most RANK_BINS rows a metric
    within = F.sum("n").over(Window.partitionBy("metric", "slice").orderBy("value"))
    ranked = sliced.withColumn("within", within).join(F.broadcast(slices), ["metric", "slice"])
    upto = F.col("before") + F.col("within")
    return ranked.select("metric", "value", "n", (upto - F.col("n")).alias("below"), upto.alias("upto"), "count", "min", "max", "mean")


def at_rank(quantile: float) -> Column:
    """Of ranked values the one at place floor(n q), from 0."""
    place = F.floor(F.col("count") * F.lit(quantile))
    return F.max(F.when((F.col("below") <= place) & (place < F.col("upto")), F.col("value")))


def nearest_rank(assets: DataFrame, quantiles: dict[str, float], metrics: tuple[str, ...] = STATISTIC_METRICS) -> DataFrame:
    """Per metric and quantile q the value at place floor(n q), from 0, of the ascending values."""
    return ranked_values(assets, metrics).groupBy("metric").agg(F.max("count").alias("count"), *(at_rank(q).alias(k) for k, q in quantiles.items()))


def metric_statistics(assets: DataFrame, metrics: tuple[str, ...] = STATISTIC_METRICS) -> DataFrame:
    """Per metric with values: count, min, max, mean, population deviation, median and quartiles by rank."""
    gap = F.col("value") - F.col("mean")
    return ranked_values(assets, metrics).groupBy("metric").agg(
        F.max("count").alias("count"),
        F.max("min").alias("min"),
        F.max("max").alias("max"),
        F.max("mean").alias("mean"),
        F.sqrt(F.sum(F.col("n") * gap * gap) / F.max("count")).alias("std_dev"),
        at_rank(0.5).alias("median"),
        at_rank(0.25).alias("q25"),
        at_rank(0.75).alias("q75"),
    )


def metric_histogram(assets: DataFrame, metrics: tuple[str, ...] = STATISTIC_METRICS, bins: int = BINS) -> DataFrame:
    """(metric, bin, center, n, density) for every bin of every metric with values.

    Bins cover the range widened by a tenth at each end and rounded outwards. The
    density is the share of values; a range of no width has none.
    """
    values = _counted(assets, metrics)
    spread = F.col("top") - F.col("bottom")
    bounds = values.groupBy("metric").agg(F.min("value").alias("bottom"), F.max("value").alias("top"), F.sum("n").alias("count"))
    bounds = bounds.select("metric", "count", F.floor(F.col("bottom") - spread * 0.1).alias("low"), F.ceil(F.col("top") + spread * 0.1).alias("high"))
    bounds = bounds.withColumn("width", (F.col("high") - F.col("low")) / bins)
    joined = values.join(F.broadcast(bounds), "metric").where("width > 0")  # a row for each metric
    filled = joined.groupBy("metric", F.least(F.floor((F.col("value") - F.col("low")) / F.col("width")), F.lit(bins - 1)).alias("bin")).agg(F.sum("n").alias("n"))
    every = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    found = every.join(filled, ["metric", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.select("metric", "bin", (F.col("low") + (F.col("bin") + 0.5) * F.col("width")).alias("center"), "n", (F.col("n") / F.col("count")).alias("density"))
