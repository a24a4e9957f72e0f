"""Asset folders, prompt libraries, and versioned tables."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from meshloom.operators.catalog import latest_wins

LABELS = "array<struct<text:string,materialName:string,targetMaterialName:string>>"
METRICS = (
    "struct<materialCount:long,voxelResolution:int,vertexCount:long,faceCount:long,meshCount:long,occupiedVoxels:long,surfaceVoxels:long,"
    "VVD:double,VFC:double,VSC:double,computedAt:timestamp,lastUpdated:timestamp,error:string>"
)
SIDECAR = f"name string, size long, updatedAt timestamp, uploadTime timestamp, labels {LABELS}, hasLabels boolean, filterMetrics {METRICS}, filteredAt timestamp, sourceType string"
PROMPTS = (
    "version string, lastUpdated string, description string, selectionRule string, ignoreKeywords array<string>, "
    "prompts array<struct<id:string,content:string,weight:int,description:string,createdAt:string,updatedAt:string>>"
)
#: Sidecars that a task holds at once.
SIDECARS = 1000
# Fixed value: the keyword that is ignored where a library names none.
DEFAULT_KEYWORDS = ("Unknown Object",)


def write_assets(assets: DataFrame, roots: list[str], tier: str) -> int:
    """Writes ``(id, content, sidecar)`` as a tier's files, a sidecar that isn't null as ``<id>.json``; returns the number of assets.

    A library may be spread over several roots, so that no folder holds all files: an asset
    goes with its sidecar to the root that its id's hash names. Tasks write their own rows; a
    task that runs again writes the same files once more.
    """
    folders = [f"{r.rstrip('/')}/{tier}" for r in roots]
    spark = assets.sparkSession
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = [_opened(f) for f in folders]
        n = 0
        for batch in batches:
            for k, i, content, sidecar in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where, at = opened[k]
                for name, data in ((i, content or b""), (f"{i}.json", None if sidecar is None else sidecar.encode())):
                    if data is not None:
                        with where.open_output_stream(f"{at}/{name}") as f:
                            f.write(data)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    root = F.pmod(F.xxhash64("id"), F.lit(len(roots))).cast("int")
    return assets.select(root.alias("root"), "id", "content", "sidecar").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """A folder's file system, and its path there."""
    return pafs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")


def list_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """``(folder, name, size, modified)`` of the files right in the folders, empty ones too.

    A data source of its own, since Spark's skip empty files: each folder is listed by one
    task, which hands its names on in batches. Folders are of any file system that pyarrow
    knows (local, HDFS, S3 and others); one that doesn't exist has no files.
    """

    class Reader(DataSourceReader):
        def __init__(self, folders: list[str]):
            self.folders = folders

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(f) for f in self.folders]

        def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
            folder = partition.value
            where, at = _opened(folder)
            found = [x for x in where.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if x.is_file]
            for i in range(0, len(found), 10_000):
                part = found[i : i + 10_000]
                columns = [pa.array([folder] * len(part)), pa.array([x.base_name for x in part]), pa.array([x.size for x in part], pa.int64()), pa.array([x.mtime for x in part], pa.timestamp("us", "UTC"))]
                yield pa.RecordBatch.from_arrays(columns, ["folder", "name", "size", "modified"])

    class Files(DataSource):
        @classmethod
        def name(cls) -> str:
            return "asset_files"

        def schema(self) -> str:
            return "folder string, name string, size long, modified timestamp"

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(json.loads(self.options["folders"]))

    spark.dataSource.register(Files)
    return spark.read.format("asset_files").option("folders", json.dumps(folders)).load()


def read_sidecars(files: DataFrame) -> DataFrame:
    """``files`` with ``text``: the content of ``<folder>/<id>.json`` where ``has_sidecar``, read by the tasks; null if the file has gone since."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = {}
        for batch in batches:
            for part in (batch.slice(i, SIDECARS) for i in range(0, batch.num_rows, SIDECARS)):
                texts = []
                for folder, name, there in zip(*(part.column(c).to_pylist() for c in ("folder", "id", "has_sidecar")), strict=True):
                    text = None
                    if there:
                        if folder not in opened:
                            opened[folder] = _opened(folder)
                        where, at = opened[folder]
                        with contextlib.suppress(FileNotFoundError), where.open_input_stream(f"{at}/{name}.json") as f:
                            text = f.read().decode("utf-8-sig", "replace")
                    texts.append(text)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "text"])

    kinds = ", ".join(f"`{n}` {k}" for n, k in files.dtypes)
    return files.mapInArrow(run, f"{kinds}, text string")


def scan_tier(spark: SparkSession, root: str | list[str], tier: str) -> DataFrame:
    """The assets of a tier's folder: one row per file that isn't a sidecar, with what its sidecar says.

    A library in several roots has a folder of the tier in each. Only names, lengths and times
    of files are read, of empty files as well. A sidecar is the JSON object in ``<file>.json``;
    a broken, empty or missing one leaves the defaults. Sub-folders are skipped. The time of
    creation is the sidecar's upload time, or else the file's, as file systems don't keep a time
    of birth.

    Files meet their sidecars by name in a shuffle, then tasks open the sidecars: neither names
    nor splits of files pass through the driver, which Spark's own readers would list there.
    """
    listed = list_files(spark, [f"{r.rstrip('/')}/{tier}" for r in ([root] if isinstance(root, str) else root)])
    sidecar = F.col("name").endswith(".json")
    base = F.when(sidecar, F.expr("left(name, length(name) - 5)")).otherwise(F.col("name"))
    own = lambda c: F.max(F.when(~sidecar, F.col(c))).alias(c)  # noqa: E731  a name is one file at most
    files = listed.groupBy("folder", base.alias("id")).agg(own("size"), own("modified"), F.bool_or(sidecar).alias("has_sidecar")).where("size is not null")
    fields = [f"said.{n}" for n in ("updatedAt", "uploadTime", "labels", "hasLabels", "filterMetrics", "filteredAt", "sourceType")]
    joined = read_sidecars(files).withColumn("said", F.from_json("text", SIDECAR)).select("id", "size", "modified", "has_sidecar", *fields)
    labeled = F.coalesce("hasLabels", F.lit(False))
    return joined.select(
        "id",
        F.col("id").alias("name"),
        "size",
        F.lit(tier).alias("type"),
        F.when(labeled, "labeled").otherwise("raw").alias("status"),
        F.coalesce("uploadTime", "modified").alias("createdAt"),
        F.coalesce("updatedAt", "modified").alias("updatedAt"),
        F.coalesce("labels", F.array().cast(LABELS)).alias("labels"),
        labeled.alias("hasLabels"),
        "filterMetrics",
        "filteredAt",
        "sourceType",
        F.lit(True).alias("isFromServer"),
        F.col("id").alias("serverFileId"),
        "has_sidecar",
    )


def load_prompts(spark: SparkSession, path: str, defaults: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A prompt library's prompts ``(pos, prompt_id, content, weight)``, keywords to ignore, and selection rule.

    ``defaults`` holds the prompts for a library without any.
    """
    library = spark.read.schema(PROMPTS).option("multiLine", True).json(path)
    own = library.select(F.posexplode("prompts").alias("pos", "p")).select((F.col("pos") + 1).alias("pos"), F.col("p.id").alias("prompt_id"), F.col("p.content").alias("content"), F.col("p.weight").alias("weight"))
    prompts = own.unionByName(defaults.where(~own.exists()))
    words = F.when(F.coalesce(F.size("ignoreKeywords"), F.lit(0)) > 0, F.col("ignoreKeywords")).otherwise(F.array(*map(F.lit, DEFAULT_KEYWORDS)))
    return prompts, library.select(F.explode(words).alias("keyword")), library.select(F.coalesce("selectionRule", F.lit("weighted")).alias("rule"))


def write_report(rows: DataFrame, path: str) -> None:
    """Appends run reports as JSON lines."""
    rows.write.mode("append").json(path)


def write_version(table: DataFrame, root: str, version: int) -> str:
    """Writes a table as a new version; the version that is being read is never touched."""
    path = f"{root.rstrip('/')}/v{version:08d}"
    table.write.mode("errorifexists").parquet(path)
    return path


def merge_records(old: DataFrame | None, new: DataFrame, key: str, *order: str) -> DataFrame:
    """The latest record of each key of both tables."""
    return latest_wins(new if old is None else old.unionByName(new, allowMissingColumns=True), key, *order)
