"""Geometry over the embeddings, read as 21 vertices of a mesh each, on a grid of 16 cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators import geometry as g
from meshloom.operators.metrics import metric_filter
from meshloom.plans.registry import query
from meshloom.plans.views import view
from meshloom.sources.shared import shared_folder
from meshloom.streaming import jobs

R = 16
RANGES = {"material_count": (2, 7), "vvd": (0.5, 50.0), "vfc": (0.2, 20.0), "vsc": (0.0, 1.0)}

TRIANGLES = """
    tri as (select model_id, mesh_id, vi // 3 as tri,
        max(case when vi % 3 = 0 then x end) as x0, max(case when vi % 3 = 0 then y end) as y0, max(case when vi % 3 = 0 then z end) as z0,
        max(case when vi % 3 = 1 then x end) as x1, max(case when vi % 3 = 1 then y end) as y1, max(case when vi % 3 = 1 then z end) as z1,
        max(case when vi % 3 = 2 then x end) as x2, max(case when vi % 3 = 2 then y end) as y2, max(case when vi % 3 = 2 then z end) as z2
        from V_VERTEX group by model_id, mesh_id, vi // 3)"""
BOX = """
    box as (select *, max_x - min_x as size_x, max_y - min_y as size_y, max_z - min_z as size_z,
        (min_x + max_x) / 2 as center_x, (min_y + max_y) / 2 as center_y, (min_z + max_z) / 2 as center_z,
        greatest(max_x - min_x, max_y - min_y, max_z - min_z) as max_dim
        from (select model_id, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, min(z) as min_z, max(z) as max_z from V_VERTEX group by model_id))"""
def cells_sql(r: int) -> str:
    """Cells of the boxes of ``tri`` in a grid of ``r`` cells over ``box``."""
    span = ",\n        ".join(
        f"greatest(0, cast(floor((least({p}) + 0.5) * {r}) as int)) as lo_{a}, least({r} - 1, cast(floor((greatest({p}) + 0.5) * {r}) as int)) as hi_{a}"
        for a in "xyz"
        for p in [", ".join(f"({a}{c}-center_{a})/max_dim" for c in range(3))]
    )
    return f"""
    span as (select distinct t.model_id, {span}
        from tri t join box b on t.model_id = b.model_id where max_dim > 0),
    span_x as (select * exclude (lo_x, hi_x), unnest(range(lo_x, hi_x + 1)) as vx from span where lo_x <= hi_x and lo_y <= hi_y and lo_z <= hi_z),
    span_y as (select * exclude (lo_y, hi_y), unnest(range(lo_y, hi_y + 1)) as vy from span_x),
    cells as (select distinct model_id, cast(vx as int) as vx, cast(vy as int) as vy, cast(vz as int) as vz from (select model_id, vx, vy, unnest(range(lo_z, hi_z + 1)) as vz from span_y))"""


def surface_sql(r: int) -> str:
    return f"""
    hits as (select c.model_id, c.vx, c.vy, c.vz, count(n.model_id) as neighbors from cells c
        cross join (values (1,0,0), (-1,0,0), (0,1,0), (0,-1,0), (0,0,1), (0,0,-1)) as d(dx, dy, dz)
        left join cells n on n.model_id = c.model_id and n.vx = c.vx + dx and n.vy = c.vy + dy and n.vz = c.vz + dz group by all),
    surf as (select *, neighbors < 6 or vx in (0, {r} - 1) or vy in (0, {r} - 1) or vz in (0, {r} - 1) as surface from hits)"""


CELLS, SURFACE = cells_sql(R), surface_sql(R)
METRICS = """
    stats as (select model_id, count(*) as vertex_count, cast(floor(count(*) / 3) as bigint) as face_count, count(distinct mesh_id) as mesh_count from V_VERTEX group by model_id),
    mats as (select model_id, count(distinct material_id) as material_count from V_MESH group by model_id),
    voxels as (select model_id, count(*) as occupied_voxels, count(*) filter (surface) as surface_voxels from surf group by model_id),
    metrics as (select m.model_id, material_count, vertex_count, face_count, mesh_count, occupied_voxels, surface_voxels,
        vertex_count / occupied_voxels as vvd, face_count / occupied_voxels as vfc, surface_voxels / occupied_voxels as vsc
        from mats m join stats using (model_id) join voxels using (model_id))"""


def _mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "V_MESH").select("*", F.array("material_id").alias("material_ids"), F.lit(None).cast("array<double>").alias("matrix"))


def _vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "V_VERTEX")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertex = _vertex(spark, sf_dir)
    return g.voxelize(g.triangles(vertex), g.model_bbox(vertex), R)


@query("triangles", f"with {TRIANGLES} select model_id, mesh_id, cast(tri as bigint) as tri, x0, y0, z0, x1, y1, z1, x2, y2, z2 from tri")
def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.triangles(_vertex(spark, sf_dir))


@query("model_bbox", f"with {BOX} select * from box")
def model_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.model_bbox(_vertex(spark, sf_dir), _mesh(spark, sf_dir))


@query("voxelize", f"with {TRIANGLES}, {BOX}, {CELLS} select * from cells")
def voxelize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


@query("surface_voxels", f"with {TRIANGLES}, {BOX}, {CELLS}, {SURFACE} select model_id, vx, vy, vz, surface from surf")
def surface_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.surface_voxels(_cells(spark, sf_dir), R)


@query("surface_neighbors", f"with {TRIANGLES}, {BOX}, {CELLS}, {SURFACE} select * from surf")
def surface_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.surface_by_neighbors(_cells(spark, sf_dir), R)


WORDS = "cast(case when {0} >= 9223372036854775808::hugeint then {0} - 18446744073709551616::hugeint else {0} end as bigint)"


def _bits(condition: str) -> str:
    """SQL for the number whose bits are the cells of a line that meet a condition."""
    return WORDS.format(f"coalesce(sum(1::hugeint << vz) filter ({condition}), 0::hugeint)")


def _lines(spark: SparkSession, sf_dir: str, resolution: int) -> DataFrame:
    vertex = _vertex(spark, sf_dir)
    return g.voxel_lines(g.triangles(vertex), g.model_bbox(vertex), resolution)


@query("voxel_lines", f"with {TRIANGLES}, {BOX}, {cells_sql(64)} select model_id, vx, vy, {_bits('true')} as w0 from cells group by all")
def voxel_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of 64 cells as bits of lines."""
    return _lines(spark, sf_dir, 64)


@query("surface_lines", f"with {TRIANGLES}, {BOX}, {cells_sql(64)}, {surface_sql(64)} select model_id, vx, vy, {_bits('true')} as w0, {_bits('surface')} as s0 from surf group by all")
def surface_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.surface_lines(_lines(spark, sf_dir, 64), 64)


@query("complexity_64", f"with {TRIANGLES}, {BOX}, {cells_sql(64)}, {surface_sql(64)}, {METRICS} select *, 64 as voxel_resolution, cast(null as varchar) as error from metrics")
def complexity_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.complexity_metrics(_vertex(spark, sf_dir), _mesh(spark, sf_dir), resolution=64)


# Scenes: meshes with index buffers, of which some name a vertex that isn't there, turned, scaled and put beside each other.


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    zero, one = F.lit(0.0), F.lit(1.0)
    matrix = F.when(F.col("c").isNotNull(), F.array("c", "s", zero, zero, -F.col("s"), "c", zero, zero, zero, zero, F.lit(0.25), zero, "tx", "ty", "tz", one))
    mesh = view(spark, sf_dir, "V_PLACE").select("model_id", "mesh_id", F.array("material_id").alias("material_ids"), matrix.alias("matrix"))
    return _vertex(spark, sf_dir).withColumn("part", F.input_file_name()), mesh, view(spark, sf_dir, "V_FACE")


def _moved(x: str, y: str, z: str) -> tuple[str, str, str]:
    return (
        f"case when c is null then {x} else c * {x} + -s * {y} + 0.0::double * {z} + tx end",
        f"case when c is null then {y} else s * {x} + c * {y} + 0.0::double * {z} + ty end",
        f"case when c is null then {z} else 0.0::double * {x} + 0.0::double * {y} + 0.25::double * {z} + tz end",
    )


PLACED_TRIANGLES = """
    corner as (select model_id, mesh_id, vi as k, x, y, z from V_VERTEX where mesh_id % 2 = 1
        union all select f.model_id, f.mesh_id, f.k, x, y, z from V_FACE f join V_VERTEX v on f.model_id = v.model_id and f.mesh_id = v.mesh_id and f.vi = v.vi),
    moved as (select c.model_id, c.mesh_id, k, {}, {}, {} from corner c join V_PLACE p on c.model_id = p.model_id and c.mesh_id = p.mesh_id),
    tri as (select model_id, mesh_id, cast(k // 3 as bigint) as tri, {} from moved group by model_id, mesh_id, k // 3 having count(*) = 3)""".format(
    *(f"{m} as {a}" for m, a in zip(_moved("x", "y", "z"), "xyz", strict=True)),
    ", ".join(f"max(case when k % 3 = {c} then {a} end) as {a}{c}" for c in range(3) for a in "xyz"),
)
PLACED_BOX = """
    own as (select model_id, mesh_id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(z) as z0, max(z) as z1 from V_VERTEX group by model_id, mesh_id),
    edge as (select p.*, case when i % 2 = 0 then x0 else x1 end as x, case when i // 2 % 2 = 0 then y0 else y1 end as y, case when i // 4 = 0 then z0 else z1 end as z
        from own o join V_PLACE p on o.model_id = p.model_id and o.mesh_id = p.mesh_id, range(0, 8) r(i)),
    sides as (select model_id, {}, {}, {} from edge),
    box as (select *, max_x - min_x as size_x, max_y - min_y as size_y, max_z - min_z as size_z,
        (min_x + max_x) / 2 as center_x, (min_y + max_y) / 2 as center_y, (min_z + max_z) / 2 as center_z, greatest(max_x - min_x, max_y - min_y, max_z - min_z) as max_dim
        from (select model_id, {} from sides group by model_id))""".format(
    *(f"{m} as {a}" for m, a in zip(_moved("x", "y", "z"), "xyz", strict=True)), ", ".join(f"min({a}) as min_{a}, max({a}) as max_{a}" for a in "xyz")
)
PLACED_METRICS = METRICS.replace(
    "cast(floor(count(*) / 3) as bigint) as face_count, count(distinct mesh_id) as mesh_count from V_VERTEX group by model_id",
    "cast(floor(sum(case when mesh_id % 2 = 0 and vi = 0 then 31 / 3 when mesh_id % 2 = 1 then 1 / 3 end)) as bigint) as face_count, count(distinct mesh_id) as mesh_count from V_VERTEX group by model_id",
)


@query("placed_triangles", f"with {PLACED_TRIANGLES} select * from tri")
def placed_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.triangles(*_placed(spark, sf_dir))


@query("placed_bbox", f"with {PLACED_BOX} select * from box")
def placed_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertex, mesh, _ = _placed(spark, sf_dir)
    return g.model_bbox(vertex, mesh)


@query("line_cells", f"with {PLACED_TRIANGLES}, {PLACED_BOX}, {cells_sql(100)}, {surface_sql(100)} select model_id, vx, vy, vz, surface from surf")
def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of 100 cells, two words a line, and back to cells."""
    vertex, mesh, face_index = _placed(spark, sf_dir)
    return g.line_cells(g.surface_lines(g.voxel_lines(g.triangles(vertex, mesh, face_index), g.model_bbox(vertex, mesh), 100), 100), 100)


@query("complexity_512", f"with {PLACED_TRIANGLES}, {PLACED_BOX}, {cells_sql(512)}, {surface_sql(512)}, {PLACED_METRICS} select *, 512 as voxel_resolution, cast(null as varchar) as error from metrics")
def complexity_512(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes on the finest grid: eight words a line."""
    return g.complexity_metrics(*_placed(spark, sf_dir), resolution=512)


@query("voxel_counts", f"with {TRIANGLES}, {BOX}, {CELLS}, {SURFACE} select model_id, count(*) as occupied_voxels, count(*) filter (surface) as surface_voxels from surf group by model_id")
def voxel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.voxel_counts(g.surface_voxels(_cells(spark, sf_dir), R))


@query("geometry_stats", "select model_id, count(*) as vertex_count, cast(floor(count(*) / 3) as bigint) as face_count, count(distinct mesh_id) as mesh_count from V_VERTEX group by model_id")
def geometry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.geometry_stats(_vertex(spark, sf_dir))


@query("material_count", "select model_id, count(distinct material_id) as material_count from V_MESH group by model_id")
def material_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.material_count(_mesh(spark, sf_dir))


@query("material_list", "select model_id, mesh_id, material_id, cast(row_number() over (partition by model_id order by mesh_id) as int) as position from V_MESH")
def material_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.material_list(_mesh(spark, sf_dir)).select("model_id", "mesh_id", "material_id", "position")


@query("complexity_metrics", f"with {TRIANGLES}, {BOX}, {CELLS}, {SURFACE}, {METRICS} select *, {R} as voxel_resolution, cast(null as varchar) as error from metrics")
def complexity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.complexity_metrics(_vertex(spark, sf_dir), _mesh(spark, sf_dir), resolution=R)


@query("stream_complexity", f"with {TRIANGLES}, {BOX}, {CELLS}, {SURFACE}, {METRICS} select *, {R} as voxel_resolution, cast(null as varchar) as error from metrics")
def stream_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of models, half of which are asked for twice: each batch computes the metrics that are missing from the models' meshes."""
    vertex, mesh, root = _vertex(spark, sf_dir), _mesh(spark, sf_dir), shared_folder(spark, "metrics")
    models = mesh.select("model_id").distinct()
    for asked in (models.where(F.pmod(F.hash("model_id"), F.lit(2)) == 0), models):
        asked.write.mode("append").parquet(f"{root}/models")
        stream = spark.readStream.schema(models.schema).parquet(f"{root}/models")
        jobs.stream_metrics(stream, f"{root}/table", f"{root}/checkpoint", jobs.model_metrics(vertex, mesh, R), ("vvd", "vfc", "vsc"), R, buckets=8).awaitTermination()
    return jobs.read_latest(spark, f"{root}/table")


@query(
    "filtered_complexity",
    f"""with {TRIANGLES}, {BOX}, {CELLS}, {SURFACE}, {METRICS}
        select model_id, material_count, occupied_voxels, surface_voxels, vvd, vfc, vsc,
            material_count between 2 and 7 and vvd between 0.5 and 50 and vfc between 0.2 and 20 and vsc between 0 and 1 as passed,
            concat_ws(',', case when material_count not between 2 and 7 then 'material_count out of range' end, case when vvd not between 0.5 and 50 then 'vvd out of range' end,
                case when vfc not between 0.2 and 20 then 'vfc out of range' end, case when vsc not between 0 and 1 then 'vsc out of range' end) as failures
        from metrics""",
)
def filtered_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: meshes to metrics, and the reasons of those that don't pass."""
    found = metric_filter(complexity_metrics(spark, sf_dir), RANGES)
    return found.select("model_id", "material_count", "occupied_voxels", "surface_voxels", "vvd", "vfc", "vsc", "passed", F.concat_ws(",", "failures").alias("failures")).orderBy("model_id")


@query(
    "fit_transform",
    f"""with {BOX}, fit as (select model_id, case when max_dim > 0 then 4.0::double / max_dim else 1.0 end as scale, center_x, center_y, center_z from box)
        select v.model_id, mesh_id, vi, x * scale + -center_x * scale as x, y * scale + -center_y * scale as y, z * scale + -center_z * scale as z
        from V_VERTEX v join fit f on v.model_id = f.model_id""",
)
def fit_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertex = _vertex(spark, sf_dir)
    return g.fitted(vertex, g.model_bbox(vertex), 4.0)
