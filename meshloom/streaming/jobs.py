"""The streaming jobs: a catalog kept up to date, metrics of new assets, progress and stalls of runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meshloom.operators.geometry import complexity_metrics
from meshloom.operators.metrics import refreshed_metrics
from meshloom.operators.runs import STALL_MS, sessions, tumbling_progress
from meshloom.sources.storage import merge_records

#: Parts of a table, by the hash of a row's key; a batch rewrites those that it touches, so a part should be about a file.
BUCKETS = 64
_POINTERS = "version long, bucket int, path string, writer string, batch long"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    """What finished batches wrote: a row for each bucket that a batch rewrote, with the batch and the query that ran it."""
    path = f"{root}/versions"
    return spark.read.schema(_POINTERS).json(path) if _exists(spark, path) else spark.createDataFrame([], _POINTERS)


def _latest(spark: SparkSession, root: str) -> dict[int, tuple[int, str]]:
    """Of each bucket of a table below ``root`` the newest version and its folder."""
    last = _pointers(spark, root).groupBy("bucket").agg(F.max(F.struct("version", "path")).alias("x"))
    return {r["bucket"]: (r["version"], r["path"]) for r in last.select("bucket", "x.*").collect()}  # a row for each bucket


def _writer(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the query of a checkpoint: another checkpoint, or an emptied one, is another query."""
    return spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]


def _versioned(root: str, checkpoint: str, key: str, change: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A batch function that writes ``change(old, new)`` for the buckets of the new keys.

    A batch that its query runs again changes nothing. Batches of other queries over the
    same root, which number theirs from 0, too, are told apart by the query's id, and add
    to what is there. One query at a time may write.
    """

    def run(new: DataFrame, batch: int) -> None:
        spark, bucket = new.sparkSession, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        writer = _writer(spark, checkpoint)
        done = _pointers(spark, root).agg(F.max("version"), F.bool_or((F.col("writer") == writer) & (F.col("batch") >= batch))).first()
        if done[1]:
            return
        touched = [r[0] for r in new.select(bucket).distinct().collect()]
        if not touched:
            return
        version, latest = 0 if done[0] is None else done[0] + 1, _latest(spark, root)
        paths = [latest[b][1] for b in touched if b in latest]
        table = change(spark.read.parquet(*paths) if paths else None, new)
        path = f"{root}/v{version:08d}"
        table.repartition(len(touched), bucket).withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(path)  # what a lost attempt left there was never pointed to
        written = [r[0] for r in spark.read.parquet(path).select("_bucket").distinct().collect()]
        rows = [(version, b, f"{path}/_bucket={b}", writer, batch) for b in written]
        spark.createDataFrame(rows, _POINTERS).coalesce(1).write.mode("append").json(f"{root}/versions")

    return run


def stream_catalog(records: DataFrame, root: str, checkpoint: str, key: str = "id", order: tuple[str, ...] = ("updated_at", "version_no"), buckets: int = BUCKETS) -> StreamingQuery:
    """Folds new records into the catalog at ``root``: the latest of each id.

    A new checkpoint over the same root reads its source from the start and adds what is new.
    """
    change = lambda old, new: merge_records(old, new, key, *order)
    return records.writeStream.foreachBatch(_versioned(root, checkpoint, key, change, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_metrics(assets: DataFrame, root: str, checkpoint: str, compute: Callable[[DataFrame], DataFrame], required: tuple[str, ...], resolution: int, buckets: int = BUCKETS) -> StreamingQuery:
    """Computes metrics of the assets that need it and keeps them at ``root``; assets that are complete are left alone.

    ``compute`` gets the assets ``(model_id)`` and returns their metrics with ``material_count`` and ``voxel_resolution``.
    """

    def change(old: DataFrame | None, new: DataFrame) -> DataFrame:
        if old is None:
            return compute(new.select("model_id").distinct())
        return refreshed_metrics(old, new, compute, required, resolution)

    return assets.writeStream.foreachBatch(_versioned(root, checkpoint, "model_id", change, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def model_metrics(vertex: DataFrame, mesh: DataFrame, resolution: int, face_index: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """A function for ``stream_metrics``: the complexity metrics of the models that are due, from their own meshes only."""

    def compute(due: DataFrame) -> DataFrame:
        own = [t if t is None else t.join(due.select("model_id").distinct(), "model_id", "left_semi") for t in (vertex, mesh, face_index)]
        return complexity_metrics(*own, resolution=resolution)

    return compute


def stream_progress(events: DataFrame, delay: str = "30 minutes", width: str = "10 minutes") -> DataFrame:
    """Windows of each run's progress, each once its time is over."""
    return tumbling_progress(events.withWatermark("ts", delay), width)


def stream_stalls(events: DataFrame, delay: str = "30 minutes", gap: str = "10 minutes") -> DataFrame:
    """Stretches of each run without a stall, each once a stall has ended it."""
    return sessions(events.withWatermark("ts", delay), gap)


def stall_alarms(events: DataFrame, limit_ms: int = STALL_MS, delay: str = "0 seconds", clock: DataFrame | None = None) -> DataFrame:
    """A stream of alarms ``(run_id, stalled_since, due)``: a run has had no event for more than ``limit_ms``.

    An alarm comes once for a stall, as soon as the watermark has passed ``due`` and
    without another event of the run: it is the end of a session whose gap is the limit.
    The watermark follows the events of all runs; where those may all fall silent, a
    ``clock`` with a column ``ts`` drives it. ``delay`` is how late an event may come, and
    a later one counts as long as its own stall would not be told; a run's state is its
    open sessions. Events without a time or a run raise no alarm.
    """
    kind, ms = events.schema["run_id"].dataType, F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp"))).alias("ts")
    rows = events.select("run_id", ms)
    if clock is not None:
        rows = rows.unionByName(clock.select(F.lit(None).cast(kind).alias("run_id"), ms))
    # sessions that touch are one, but end at their gap: the millisecond makes the limit itself no stall
    stretches = rows.withWatermark("ts", f"{delay} 1 millisecond").groupBy("run_id", F.session_window("ts", f"{limit_ms} milliseconds"))
    # rows without a run are left out by their count: a filter by run_id would be moved before the watermark, which they drive
    found = stretches.agg(F.max("ts").alias("stalled_since"), F.count("run_id").alias("n")).where("n > 0")
    return found.select("run_id", "stalled_since", F.timestamp_millis(F.unix_millis("stalled_since") + limit_ms).alias("due"))


def start_alarms(alarms: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends alarms to Parquet files, as far as the source goes."""
    return alarms.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)


def read_latest(spark: SparkSession, root: str) -> DataFrame | None:
    paths = [path for _, path in _latest(spark, root).values()]
    return spark.read.parquet(*paths) if paths else None


__all__ = ["read_latest", "stall_alarms", "start_alarms", "stream_catalog", "stream_metrics", "stream_progress", "stream_stalls"]
