"""Metrics per order, taken as models whose parts are the order's lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators import geometry, metrics
from meshloom.plans.registry import query
from meshloom.plans.views import view
from meshloom.sources.shared import shared_folder

REQUIRED, RESOLUTION = ("vvd", "vfc", "vsc"), 64
RANGES = {"material_count": (2, 5), "vvd": (3.0, 40.0), "vfc": (0.5, 1.5), "vsc": (0.8, 1.0)}
FIELDS = ("voxel_resolution", "material_count", "vertex_count", "vvd", "vfc", "vsc")

_FAILURES = ", ".join(
    f"case when {m} is null then '{m} missing' when {m} not between {a} and {b} then '{m} out of range' end" for m, (a, b) in RANGES.items()
)
_PASSED = "coalesce(" + " and ".join(f"{m} between {a} and {b}" for m, (a, b) in RANGES.items()) + ", false)"
_OUTCOME = f"case when not has_metrics then 'missing_metrics' when {_PASSED} then 'passed' else 'criteria_not_met' end"
_MISSING = "concat_ws(',', case when vvd is null then 'vvd' end, case when vfc is null then 'vfc' end, case when vsc is null then 'vsc' end)"
_REASON = f"""case when not has_metrics then 'no_existing_metrics' when voxel_resolution <> {RESOLUTION} then 'resolution_mismatch'
    when vvd is null or vfc is null or vsc is null then 'missing_metrics' when material_count is null then 'missing_material_count' else 'complete' end"""
_LONG = " union all ".join(f"select '{m}' as metric, {m} as value from V_METRICS where {m} is not null" for m in metrics.STATISTIC_METRICS)
_RANKED = f"ranked as (select *, row_number() over (partition by metric order by value) - 1 as place, count(*) over (partition by metric) as n from ({_LONG}))"
_RANKS = "max(case when place = cast(floor(n * 0.5) as bigint) then value end) as median, max(case when place = cast(floor(n * 0.25) as bigint) then value end) as q25, max(case when place = cast(floor(n * 0.75) as bigint) then value end) as q75"


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "V_METRICS")


@query(
    "metrics_status",
    f"""select model_id, reason <> 'complete' as needs_compute, reason = 'resolution_mismatch' as resolution_mismatch, reason,
        case when reason in ('no_existing_metrics', 'resolution_mismatch') then 'vvd,vfc,vsc' else missing end as missing_metrics,
        case when reason in ('no_existing_metrics', 'resolution_mismatch') then '' else available end as available_metrics
        from (select *, {_REASON} as reason, {_MISSING} as missing, {_MISSING.replace("is null", "is not null")} as available from V_METRICS)""",
)
def metrics_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.metrics_status(_assets(spark, sf_dir), REQUIRED, RESOLUTION)
    joined = [F.concat_ws(",", c).alias(c) for c in ("missing_metrics", "available_metrics")]
    return found.select("model_id", "needs_compute", "resolution_mismatch", "reason", *joined)


@query("metric_filter", f"select model_id, {_PASSED} as passed, concat_ws(',', {_FAILURES}) as failures, vvd as vvd_value, coalesce(vvd between 3 and 40, false) as vvd_passed from V_METRICS")
def metric_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.metric_filter(_assets(spark, sf_dir), RANGES)
    return found.select("model_id", "passed", F.concat_ws(",", "failures").alias("failures"), F.col("details.vvd.value").alias("vvd_value"), F.col("details.vvd.passed").alias("vvd_passed"))


@query("filter_outcome", f"select model_id, {_OUTCOME} as outcome from V_METRICS")
def filter_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.filter_outcome(metrics.metric_filter(_assets(spark, sf_dir), RANGES)).select("model_id", "outcome")


@query(
    "filter_summary",
    f"""select count(*) as total, count(*) filter (outcome = 'passed') as passed, count(*) filter (outcome = 'criteria_not_met') as failed,
        count(*) filter (outcome = 'missing_metrics') as missing_metrics from (select {_OUTCOME} as outcome from V_METRICS)""",
)
def filter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.filter_summary(metrics.filter_outcome(metrics.metric_filter(_assets(spark, sf_dir), RANGES)))


@query(
    "compute_summary",
    f"""select count(*) as total, count(*) filter (due and occupied is not null) as computed, count(*) filter (not due) as skipped, count(*) filter (due and occupied is null) as failed
        from (select occupied, {_REASON} <> 'complete' as due from V_METRICS)""",
)
def compute_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.compute_summary(metrics.metrics_status(_assets(spark, sf_dir), REQUIRED, RESOLUTION), F.col("occupied").isNull())


@query(
    "metric_ratios",
    """select model_id, vertex_count / nullif(occupied, 0) as vvd, face_count / nullif(occupied, 0) as vfc, surface / nullif(occupied, 0) as vsc,
        case when coalesce(occupied, 0) = 0 then 'voxelization_failed' end as error from (select *, case when model_id % 13 = 0 then 0 else occ end as occupied from (select * exclude (occupied), occupied as occ from V_METRICS))""",
)
def metric_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _assets(spark, sf_dir).select(
        "model_id", "vertex_count", "face_count", F.when(F.col("model_id") % 13 == 0, 0.0).otherwise(F.col("occupied")).alias("occupied_voxels"), F.col("surface").alias("surface_voxels")
    )
    return geometry.metric_ratios(counts).select("model_id", "vvd", "vfc", "vsc", "error")


@query(
    "merge_metrics",
    """select a.model_id, case when changed then b_res else coalesce(b_res, a.voxel_resolution) end as voxel_resolution,
        case when changed then b_mat else coalesce(b_mat, a.material_count) end as material_count, case when changed then b_vert else coalesce(b_vert, a.vertex_count) end as vertex_count,
        case when changed then b_vvd else coalesce(b_vvd, a.vvd) end as vvd, case when changed then null else a.vfc end as vfc, case when changed then null else a.vsc end as vsc,
        case when b_id is not null then timestamp '2024-06-01 00:00:00' end as last_updated
        from (select a.*, b.model_id as b_id, b.voxel_resolution as b_res, b.material_count as b_mat, b.vertex_count as b_vert, b.vvd as b_vvd,
            b.model_id is not null and a.voxel_resolution <> b.voxel_resolution as changed
            from V_METRICS a left join (select model_id, 64 as voxel_resolution, material_count + 1 as material_count, vertex_count, vvd * 2 as vvd from V_METRICS where model_id % 3 = 0) b on a.model_id = b.model_id) a""",
)
def merge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _assets(spark, sf_dir)
    none = F.lit(None).cast("double")
    new = old.where("model_id % 3 = 0").select("model_id", F.lit(64).alias("voxel_resolution"), (F.col("material_count") + 1).alias("material_count"), "vertex_count", (F.col("vvd") * 2).alias("vvd"), none.alias("vfc"), none.alias("vsc"))
    return metrics.merge_metrics(old, new, FIELDS, now=F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))


@query("nearest_rank", f"with {_RANKED} select metric, max(n) as count, {_RANKS} from ranked group by metric")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.nearest_rank(_assets(spark, sf_dir), {"median": 0.5, "q25": 0.25, "q75": 0.75})


@query(
    "metric_statistics",
    f"""with {_RANKED} select metric, max(n) as count, min(value) as min, max(value) as max, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std_dev, {_RANKS}
        from ranked group by metric""",
)
def metric_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.metric_statistics(_assets(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "std_dev")})


@query(
    "metric_histogram",
    f"""with vals as ({_LONG}),
        ends as (select metric, count(*) as cnt, cast(floor(min(value) - (max(value) - min(value)) * 0.1::double) as bigint) as low, cast(ceil(max(value) + (max(value) - min(value)) * 0.1::double) as bigint) as high from vals group by metric),
        bounds as (select *, (high - low) / 50 as width from ends),
        filled as (select v.metric, least(cast(floor((value - low) / width) as bigint), 49) as bin, count(*) as n from vals v join bounds b on v.metric = b.metric where width > 0 group by all)
        select b.metric, cast(r.range as bigint) as bin, low + (r.range + 0.5::double) * width as center, coalesce(n, 0) as n, coalesce(n, 0) / cnt as density
        from bounds b cross join range(0, 50) r left join filled f on f.metric = b.metric and f.bin = r.range""",
)
def metric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metric_histogram(_assets(spark, sf_dir))


_COMPUTED = ("material_count", "vvd", "vfc", "vsc")


@query("stream_metrics", f"select model_id, 64 as voxel_resolution, {', '.join(f'coalesce({m}, 0) as {m}' for m in _COMPUTED)}, vertex_count, face_count, occupied, surface from V_METRICS")
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the streaming job: all assets are asked for, those with metrics are known."""
    path = shared_folder(spark, "assets")
    _assets(spark, sf_dir).write.parquet(path)  # made once, read for what is known, asked for and computed
    rows = spark.read.parquet(path)

    def compute(due: DataFrame) -> DataFrame:
        fresh = rows.drop("has_metrics").join(due, "model_id").withColumn("voxel_resolution", F.lit(64))
        return fresh.withColumns({m: F.coalesce(m, F.lit(0.0)) for m in _COMPUTED})

    return metrics.refreshed_metrics(rows.where("has_metrics").drop("has_metrics"), rows.select("model_id"), compute, REQUIRED, RESOLUTION)
