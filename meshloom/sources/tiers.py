"""Tiers as one Parquet table, partitioned by tier: a change rewrites the tiers that it touches and no other.

Rows are put together and written to the shared folder first, then moved into their
partitions by an overwrite of just those (Spark's dynamic mode). So a change that is
lost on the way leaves the table as it was or can be moved again; one change at a time
may run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators.catalog import TIERS, copy_to_filtered, promote_to_labeled, upsert
from meshloom.sources.shared import shared_folder

ASSET = "id string, size long, has_sidecar boolean, has_labels boolean, moved_at timestamp, filtered_at timestamp, source_type string"


def read_tiers(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(f"{ASSET}, tier string").parquet(root)


def write_tiers(rows: DataFrame, root: str, touched: tuple[str, ...] = TIERS) -> None:
    """Makes ``rows`` (of any columns of ASSET, and ``tier``) all that the ``touched`` tiers hold; the others stay as they are."""
    spark, staged = rows.sparkSession, shared_folder(rows.sparkSession, "tiers")
    names = [f.split()[0] for f in ASSET.split(", ")]
    kinds = dict(f.split() for f in ASSET.split(", "))
    full = rows.select("tier", *(F.col(n).cast(kinds[n]) if n in rows.columns else F.lit(None).cast(kinds[n]).alias(n) for n in names))
    full.where(F.col("tier").isin(*touched)).write.parquet(staged)
    found = spark.read.parquet(staged)
    held = {r["tier"] for r in found.select("tier").distinct().collect()}  # tiers are three
    found.repartition("tier", F.pmod(F.xxhash64("id"), F.lit(spark.sparkContext.defaultParallelism))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tier").parquet(root)
    for tier in set(touched) - held:  # a tier without rows has no partition that could be overwritten
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/tier={tier}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _put(spark: SparkSession, root: str, tier: str, new: DataFrame, replace: bool = False) -> None:
    old = read_tiers(spark, root).where(F.col("tier") == tier)
    write_tiers(new if replace else upsert(old, new, "id"), root, (tier,))


def promote(spark: SparkSession, root: str, requests: DataFrame, now: Column) -> DataFrame:
    """Writes the labeled rows of ``promote_to_labeled`` over those of the same id; returns the requests that failed.

    Of several requests for an id that with the largest payload counts.
    """
    found = promote_to_labeled(read_tiers(spark, root), requests.groupBy("id").agg(F.max("payload_size").alias("payload_size")), now)
    path = shared_folder(spark, "promoted")
    found.write.parquet(path)  # the table changes before the failures are read
    done = spark.read.parquet(path)
    _put(spark, root, "labeled", done.where("error is null").select("tier", "id", "size", "has_labels", "moved_at", F.lit(True).alias("has_sidecar")))
    return done.where("error is not null").select("id", "error")


def copy_filtered(spark: SparkSession, root: str, requests: DataFrame, now: Column, source: str = "labeled", replace: bool = False) -> DataFrame:
    """Writes the filtered rows of ``copy_to_filtered``, in place of the whole tier if ``replace``; returns the requests that failed."""
    found = copy_to_filtered(read_tiers(spark, root), requests.select("id").distinct(), now, source)
    path = shared_folder(spark, "copied")
    found.write.parquet(path)
    done = spark.read.parquet(path)
    _put(spark, root, "filtered", done.where("error is null").select("tier", "id", "size", "filtered_at", "source_type", F.col("filtered_at").isNotNull().alias("has_sidecar")), replace)
    return done.where("error is not null").select("id", "error")


def delete(spark: SparkSession, root: str, requests: DataFrame) -> DataFrame:
    """Removes the ids from every tier that holds one of them; returns the requests that named nothing."""
    rows, path = read_tiers(spark, root), shared_folder(spark, "missed")
    requests.join(rows.select("id"), "id", "left_anti").write.parquet(path)
    touched = tuple(r["tier"] for r in rows.join(requests.select("id"), "id", "left_semi").select("tier").distinct().collect())
    if touched:
        write_tiers(rows.join(requests.select("id"), "id", "left_anti"), root, touched)
    return spark.read.parquet(path)
