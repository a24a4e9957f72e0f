"""Each streaming job gives what its batch twin gives, and a restart adds nothing."""

import datetime as dt
import os
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meshloom.operators import catalog, geometry, runs
from meshloom.plans.views import view
from meshloom.streaming import jobs


@pytest.fixture
def parts(spark, small, tmp_path):
    """Writes a view in three files, which a stream takes one at a time."""

    def write(name, *order):
        path = str(tmp_path / name)
        rows = view(spark, small, name)
        rows.repartitionByRange(3, *order).sortWithinPartitions(*order).write.parquet(path)
        for i, file in enumerate(sorted(Path(path).glob("*.parquet"))):
            os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))  # a stream takes the oldest first
        return rows, lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), path

    return write


def test_catalog(spark, parts, tmp_path):
    rows, stream, _ = parts("V_VERSION", "version_no")
    root, checkpoint = str(tmp_path / "catalog"), str(tmp_path / "ck")
    jobs.stream_catalog(stream(), root, checkpoint, buckets=8).awaitTermination()
    want = catalog.latest_wins(rows, "id", "updated_at", "version_no")
    got = jobs.read_latest(spark, root)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    jobs.stream_catalog(stream(), root, checkpoint, buckets=8).awaitTermination()
    assert jobs.read_latest(spark, root).count() == want.count()


def test_metrics_are_computed_once(spark, parts, tmp_path):
    rows, stream, path = parts("V_METRICS", "model_id")
    root, asked = str(tmp_path / "metrics"), []
    known = spark.read.parquet(path)

    def compute(due):
        asked.append(due.count())
        found = known.join(due, "model_id").withColumn("voxel_resolution", F.lit(64)).drop("has_metrics")
        return found.withColumns({m: F.coalesce(m, F.lit(0.0)) for m in ("material_count", "vvd", "vfc", "vsc")})

    run = lambda ck: jobs.stream_metrics(stream(), root, str(tmp_path / ck), compute, ("vvd", "vfc", "vsc"), 64, buckets=8).awaitTermination()
    run("one")
    assert sum(asked) == rows.count() == jobs.read_latest(spark, root).count()
    asked.clear()
    run("one")  # nothing new
    assert asked == []


def test_progress(spark, parts, tmp_path):
    rows, stream, _ = parts("V_RUN_EVENT", "ts")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    last = rows.agg(F.max("ts")).first()[0]
    source = stream().withColumn("ts", F.col("ts").cast("timestamp"))
    out = str(tmp_path / "out")
    jobs.stream_progress(source).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    closed = F.col("window_end") <= F.lit(last) - F.expr("interval 30 minutes")
    want = runs.tumbling_progress(rows).where(closed)
    got = spark.read.parquet(out)
    assert got.count() > 0
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_stalls(spark, parts, tmp_path):
    rows, stream, _ = parts("V_RUN_EVENT", "ts")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    last = rows.agg(F.max("ts")).first()[0]
    source = stream().withColumn("ts", F.col("ts").cast("timestamp"))
    out = str(tmp_path / "out")
    jobs.stream_stalls(source).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    closed = F.col("ended") + F.expr("interval 10 minutes") <= F.lit(last) - F.expr("interval 30 minutes")
    want = runs.sessions(rows).where(closed)
    got = spark.read.parquet(out)
    assert got.count() > 0
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_another_checkpoint_over_one_root_loses_nothing(spark, tmp_path):
    root, kind = str(tmp_path / "catalog"), "id string, updated_at long, version_no long"

    def feed(name, rows, ck):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / name))
        jobs.stream_catalog(spark.readStream.schema(kind).parquet(str(tmp_path / name)), root, str(tmp_path / ck)).awaitTermination()
        return {tuple(r) for r in jobs.read_latest(spark, root).collect()}

    assert feed("one", [("a", 1, 1), ("c", 1, 1)], "ck1") == {("a", 1, 1), ("c", 1, 1)}
    assert feed("two", [("b", 2, 2), ("a", 3, 2)], "ck2") == {("a", 3, 2), ("b", 2, 2), ("c", 1, 1)}
    jobs.stream_catalog(spark.readStream.schema(kind).parquet(str(tmp_path / "two")), root, str(tmp_path / "ck2")).awaitTermination()
    assert jobs.read_latest(spark, root).count() == 3
    assert jobs._pointers(spark, root).agg(F.count_distinct("version", "writer", "batch")).first()[0] == 2


def test_geometry_is_computed_for_due_models_only(spark, small, tmp_path):
    """The metrics are those of the meshes; a second run computes none, a new model only itself."""
    vertex, mesh, asked = view(spark, small, "V_VERTEX"), view(spark, small, "V_MESH"), []
    mesh = mesh.select("model_id", "mesh_id", F.array("material_id").alias("material_ids"), F.lit(None).cast("array<double>").alias("matrix"))
    models = sorted(r[0] for r in mesh.select("model_id").distinct().collect())

    def compute(due):
        asked.append(sorted(r[0] for r in due.select("model_id").distinct().collect()))
        return jobs.model_metrics(vertex, mesh, 8)(due)

    root, source = str(tmp_path / "metrics"), str(tmp_path / "models")
    stream = lambda: spark.readStream.schema(mesh.select("model_id").schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda ck: jobs.stream_metrics(stream(), root, str(tmp_path / ck), compute, ("vvd", "vfc", "vsc"), 8, buckets=4).awaitTermination()
    put = lambda names: spark.createDataFrame([(n,) for n in names], mesh.select("model_id").schema).coalesce(1).write.mode("append").parquet(source)
    put(models[:4])
    run("ck")
    put(models[2:])
    run("ck")
    run("again")  # asks for all models again
    assert [a for a in asked if a] == [models[:4], models[4:]]
    want = geometry.complexity_metrics(vertex, mesh, resolution=8)
    got = jobs.read_latest(spark, root).select(*want.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_alarms_come_when_the_time_has_passed(spark, tmp_path):
    """A clock of its own drives the watermark: an alarm comes once, and not before ten minutes have passed."""
    kind, at = "run_id long, ts timestamp", lambda minute, second=0: dt.datetime(2024, 1, 1, 10 + minute // 60, minute % 60, second)
    source, ticks, out, ck = (str(tmp_path / n) for n in ("events", "ticks", "out", "ck"))

    def step(events, now):
        for path, rows in ((source, events), (ticks, [(None, now)])):
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
        streams = [spark.readStream.schema(kind).parquet(p) for p in (source, ticks)]
        jobs.start_alarms(jobs.stall_alarms(streams[0], clock=streams[1]), out, ck).awaitTermination()
        return sorted((r["run_id"], r["stalled_since"], r["due"]) for r in spark.read.schema("run_id long, stalled_since timestamp, due timestamp").parquet(out).collect())

    first = (1, at(0), at(10))
    assert step([(1, at(0)), (2, at(3)), (None, at(0)), (3, None)], at(10)) == []  # ten minutes and not more
    assert step([(2, at(11))], at(12)) == [first]
    assert step([(1, at(20)), (2, at(21))], at(21, 30)) == [first]  # 2's events are ten minutes apart
    assert step([], at(30)) == [first]
    assert step([(2, at(31))], at(40)) == [first, (1, at(20), at(30))]
    assert step([], at(41, 1)) == [first, (1, at(20), at(30)), (2, at(31), at(41))]


def test_alarms_against_gaps(spark, parts, tmp_path):
    rows, stream, _ = parts("V_RUN_EVENT", "ts")
    out = str(tmp_path / "out")
    jobs.start_alarms(jobs.stall_alarms(stream(), delay="30 minutes"), out, str(tmp_path / "ck")).awaitTermination()
    ms = runs.millis(F.col("ts"))
    end = rows.agg(F.max(ms)).first()[0] - 30 * 60_000
    after = F.coalesce(F.lead(ms).over(Window.partitionBy("run_id").orderBy("ts")), F.lit(1 << 60))
    want = rows.select("run_id", ms.alias("ms"), after.alias("after")).where((F.col("after") - F.col("ms") > 600_000) & (F.lit(end) - F.col("ms") > 600_000))
    got = spark.read.parquet(out).select("run_id", F.unix_millis("stalled_since").alias("ms"), (F.unix_millis("due") - 600_000).alias("after"))
    want = want.select("run_id", "ms", F.col("ms").alias("after"))
    assert got.count() > 500 and got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_alarms_keep_no_rows_in_python(spark, parts):
    """Events are merged to sessions by Spark; a state in Python took each row on its own."""
    _, stream, _ = parts("V_RUN_EVENT", "ts")
    plan = jobs.stall_alarms(stream(), delay="30 minutes")._jdf.queryExecution().analyzed().toString()
    assert "session_window" in plan and "TransformWithState" not in plan


def test_alarms_at_the_limit(spark, tmp_path):
    """Stalls are told by whole milliseconds; an event of the limit's last one ends none, and a clock's rows are of no run."""
    at, kind = lambda ms: dt.datetime(2024, 1, 1, 10) + dt.timedelta(milliseconds=ms), "run_id long, ts timestamp"
    rows = [(1, at(0.9)), (1, at(600_000.1)), (2, at(0)), (2, at(600_001)), (None, at(5)), (3, None)]
    for name, found in (("events", rows), ("ticks", [(None, at(1_200_001))])):
        spark.createDataFrame(found, kind).coalesce(1).write.parquet(str(tmp_path / name))
    events, ticks = (spark.readStream.schema(kind).parquet(str(tmp_path / n)) for n in ("events", "ticks"))
    jobs.start_alarms(jobs.stall_alarms(events, clock=ticks), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, at(600_000), at(1_200_000)), (2, at(0), at(600_000))]
