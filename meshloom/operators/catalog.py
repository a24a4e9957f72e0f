"""The asset catalog: rows of three tiers, keyed by ``(tier, id)``.

Requests name ids; what can't be done comes back as a row with an error, never as
an exception.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshloom.sources.shared import shared_folder

# The tiers, from the least to the most refined, and the formats taken.
TIERS = ("raw", "labeled", "filtered")
FORMATS = ("glb", "gltf", "obj", "fbx", "stl")


def tier_rank(tier: Column) -> Column:
    """1, 2, 3 for the tiers in order; null for another name."""
    return F.nullif(F.array_position(F.array(*map(F.lit, TIERS)), tier), F.lit(0))


def all_tiers(tiers: dict[str, DataFrame]) -> DataFrame:
    """The rows of all tiers, tagged with ``type``, with ``tier_rank`` to sort by; nothing is merged."""
    tagged = [tiers[t].withColumn("type", F.lit(t)).withColumn("tier_rank", F.lit(i + 1)) for i, t in enumerate(TIERS) if t in tiers]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def resolve_assets(assets: DataFrame, tier: str = "tier", key: str = "id") -> DataFrame:
    """One row per id, from its most refined tier."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(tier_rank(F.col(tier)).desc_nulls_last()))
    return assets.withColumn("_place", first).where("_place = 1").drop("_place")


def batch_lookup(requests: DataFrame, assets: DataFrame, base_url: str = "/files") -> DataFrame:
    """For each request ``(position, id)`` the asset's name, size, tier and address, or an error; order kept in ``position``.

    Only requested assets are compared, and their tiers meet before the shuffle.
    """
    asked = assets.join(requests.select("id").distinct(), "id", "left_semi")
    first = F.max_by(F.struct("size", "tier"), F.coalesce(tier_rank(F.col("tier")), F.lit(0)))
    best = asked.groupBy(F.col("id").alias("_id")).agg(first.alias("_best")).select("_id", "_best.size", F.col("_best.tier").alias("type"))
    joined = requests.join(best, requests["id"] == best["_id"], "left")
    found = F.col("_id").isNotNull()
    return joined.select(
        "position",
        "id",
        F.col("_id").alias("name"),
        "size",
        "type",
        F.when(found, F.concat(F.lit(f"{base_url}/"), F.col("type"), F.lit("/"), F.col("id"))).alias("download_url"),
        F.when(~found, "not found").alias("error"),
    )


def latest_wins(records: DataFrame, key: str, *order: str) -> DataFrame:
    """Of each key's records the last in ``order``; the last column should settle ties."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc_nulls_last(c) for c in order)))
    return records.withColumn("_place", last).where("_place = 1").drop("_place")


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``, which must hold a key once."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def check_updates(requests: DataFrame) -> DataFrame:
    """Metadata updates with ``tier`` (labeled, if none is given) and ``error`` for those that can't be taken."""
    tier = F.coalesce("tier", F.lit("labeled"))
    error = F.when(F.col("id").isNull() | F.col("metadata").isNull(), "id and metadata are required").when(tier_rank(tier).isNull(), "unknown tier")
    return requests.withColumn("tier", tier).withColumn("error", error)


def update_metadata(sidecars: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sidecars ``(tier, id, metadata)`` with those of valid requests replaced, and the rejected requests.

    Of several requests for one sidecar the one with the greatest ``position`` counts.
    """
    checked = check_updates(requests)
    good = checked.where("error is null")
    last = F.row_number().over(Window.partitionBy("tier", "id").orderBy(F.desc("position")))
    good = good.withColumn("_place", last).where("_place = 1").select("tier", "id", "metadata")
    return upsert(sidecars.select("tier", "id", "metadata"), good, "tier", "id"), checked.where("error is not null")


def promote_to_labeled(assets: DataFrame, requests: DataFrame, moved_at: Column) -> DataFrame:
    """For each request ``(id, payload_size)`` the row of the labeled tier: a copy, so the raw row stays.

    The size is the new payload's or else the raw row's; with neither, ``error``
    says so and the rest is null.
    """
    raw = assets.where("tier = 'raw'").select(F.col("id").alias("_id"), F.col("size").alias("_size"))
    joined = requests.join(raw, requests["id"] == raw["_id"], "left")
    good = F.col("payload_size").isNotNull() | F.col("_id").isNotNull()
    return joined.select(
        "id",
        F.when(good, "labeled").alias("tier"),
        F.when(good, F.col("id")).alias("filename"),
        F.coalesce("payload_size", "_size").alias("size"),
        F.when(good, F.lit(True)).alias("has_labels"),
        F.when(good, moved_at).alias("moved_at"),
        F.when(~good, "no payload and no raw asset").alias("error"),
    )


def copy_to_filtered(assets: DataFrame, requests: DataFrame, filtered_at: Column, source: str = "labeled") -> DataFrame:
    """For each request ``(id)`` the row of the filtered tier, copied from ``source``.

    Only a row with a sidecar (``has_sidecar``) is stamped with the time and its source.
    """
    if source not in ("raw", "labeled"):
        raise ValueError("assets are copied from raw or labeled")
    rows = assets.where(F.col("tier") == source).select(F.col("id").alias("_id"), "size", "has_sidecar")
    joined = requests.join(rows, requests["id"] == rows["_id"], "left")
    found = F.col("_id").isNotNull()
    return joined.select(
        "id",
        F.when(found, "filtered").alias("tier"),
        "size",
        F.when(F.col("has_sidecar"), filtered_at).alias("filtered_at"),
        F.when(F.col("has_sidecar"), source).alias("source_type"),
        F.when(~found, f"not in {source}").alias("error"),
    )


def delete_assets(assets: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The assets that stay when the requested ids go from all tiers, and the requests that named none."""
    return assets.join(requests.select("id"), "id", "left_anti"), requests.join(assets.select("id"), "id", "left_anti")


def tier_inventory(assets: DataFrame, samples: int = 3) -> DataFrame:
    """Per tier the number of files, of glb files, and the first names of those.

    The least names are kept while counting, so no tier's names are collected.
    """
    glb = assets.where(F.lower("id").endswith(".glb"))
    first = F.row_number().over(Window.partitionBy("tier").orderBy("id"))
    names = glb.select("tier", "id").withColumn("place", first).where(F.col("place") <= samples)
    names = names.groupBy("tier").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("sample_names"))
    counts = assets.groupBy("tier").agg(F.count("*").alias("files"), F.count_if(F.lower("id").endswith(".glb")).alias("glb_files"))
    return counts.join(names, "tier", "left")


def numbered(assets: DataFrame, *order: Column) -> DataFrame:
    """``assets`` with ``place``, from 1, in ``order``, which must be total.

    A global row number without a single task for all rows: rows are sorted over
    the cluster and written once to the shared folder with their partition and
    place there; the partitions' counts are summed, and each row adds its own
    place. Counts and rows are read from what was written, so that both mean the
    same partitions.
    """
    spark, path = assets.sparkSession, shared_folder(assets.sparkSession, "numbered")
    slot = F.monotonically_increasing_id()
    assets.orderBy(*order).withColumns({"_part": F.shiftright(slot, 33), "_at": slot.bitwiseAND((1 << 33) - 1)}).write.parquet(path)
    rows = spark.read.parquet(path)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    return rows.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").withColumn("place", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def page(assets: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """The rows of a page, from 1, with ``total`` and ``total_pages``; no rows outside the range."""
    total = assets.agg(F.count("*")).scalar()
    rows = assets.orderBy(*order).offset((number - 1) * size).limit(size) if number > 0 else assets.limit(0)
    return rows.withColumn("total", total).withColumn("total_pages", F.ceil(F.col("total") / size))


def page_index(assets: DataFrame, *order: Column) -> str:
    """Writes ``assets`` in ``order``, which must be total, for ``indexed_page``; returns the folder.

    Rows are sorted over the cluster; a partition of the sort is a folder of its own, and a
    small table holds how many rows each has.
    """
    spark, path = assets.sparkSession, shared_folder(assets.sparkSession, "pages")
    slot = F.monotonically_increasing_id()
    rows = assets.orderBy(*order).withColumns({"_part": F.shiftright(slot, 33), "_at": slot.bitwiseAND((1 << 33) - 1)})
    rows.limit(0).write.parquet(f"{path}/none")  # has the columns, even if there are no rows
    rows.write.partitionBy("_part").parquet(f"{path}/rows")
    spark.read.schema(rows.schema).parquet(f"{path}/rows").groupBy("_part").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/index")
    return path


def indexed_page(spark: SparkSession, path: str, number: int, size: int) -> DataFrame:
    """The rows of a page of ``page_index``, with ``place, total, total_pages``.

    The index, a row for each partition, tells which partitions the page is in; only their
    files are read, however deep the page lies.
    """
    counts = spark.read.parquet(f"{path}/index")
    upto = F.sum("n").over(Window.orderBy("_part"))
    parts = counts.select("_part", (upto - F.col("n")).alias("before"), upto.alias("upto"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    first, last = (number - 1) * size, number * size if number > 0 else 0
    on = {r["_part"]: r["before"] for r in parts.where((F.col("before") < last) & (F.col("upto") > first)).collect()}
    rows = spark.read.schema(spark.read.parquet(f"{path}/none").schema).parquet(f"{path}/rows")
    before = F.create_map(*(F.lit(x) for pair in on.items() for x in pair))[F.col("_part")] if on else F.lit(0)
    place = before + F.col("_at") + 1
    return rows.where(F.col("_part").isin(*on)).withColumn("place", place).where((F.col("place") > first) & (F.col("place") <= last)).drop("_part", "_at").withColumns({"total": F.lit(total).cast("long"), "total_pages": F.ceil(F.lit(total) / size)})


def batch_numbers(assets: DataFrame, size: int, *order: Column) -> DataFrame:
    """``assets`` with ``batch_number``: the page of ``size`` rows that each is on."""
    return numbered(assets, *order).withColumn("batch_number", F.floor((F.col("place") - 1) / size) + 1)


def untagged(assets: DataFrame) -> DataFrame:
    """Assets with neither ``has_labels`` nor a label."""
    return assets.where(~F.coalesce("has_labels", F.lit(False)) & (F.coalesce(F.size("labels"), F.lit(0)) <= 0))


def without_labeled(raw: DataFrame, labeled: DataFrame, key: str = "id") -> DataFrame:
    """Raw assets that aren't in the labeled tier yet; repeated raw rows stay repeated."""
    return raw.join(labeled.select(key), key, "left_anti")


def workspace_flag(assets: DataFrame, workspace: DataFrame) -> DataFrame:
    """``assets`` with ``is_in_workspace``: does a record name the asset by its own id or by its server's file id?

    The alternatives become one set of keys, so the join is an equality.
    """
    keys = workspace.select(F.col("id").alias("_key")).union(workspace.select("server_file_id")).where("_key is not null").distinct().withColumn("_in", F.lit(True))
    return assets.join(keys, assets["id"] == keys["_key"], "left").withColumn("is_in_workspace", F.coalesce("_in", F.lit(False))).drop("_key", "_in")


def workspace_put(workspace: DataFrame, records: DataFrame) -> DataFrame:
    """The workspace with sanitized records put in; of several for an id, that with the greatest ``version``.

    Labels keep their text and the two material names; type, folder and flags have defaults.
    """
    fields = ("text", "material_name", "target_material_name")
    clean = latest_wins(records, "id", "version").select(
        "id",
        F.coalesce("name", "id").alias("name"),
        F.coalesce("size", F.lit(0).cast("long")).alias("size"),
        F.coalesce("type", F.lit("unknown")).alias("type"),
        F.coalesce("folder", F.lit("uploaded-models")).alias("folder"),
        F.transform(F.coalesce("labels", F.array().cast("array<struct<text:string,material_name:string,target_material_name:string>>")), lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias("labels"),
        F.coalesce("has_labels", F.lit(False)).alias("has_labels"),
        F.coalesce("is_temporary", F.lit(False)).alias("is_temporary"),
        F.coalesce("is_from_server", F.lit(False)).alias("is_from_server"),
        "server_file_id",
        "batch_number",
    )
    return upsert(workspace, clean, "id")


def workspace_list(workspace: DataFrame, folder: str | None = "uploaded-models") -> DataFrame:
    """Records of a folder, or of all, without their payload."""
    rows = workspace if folder is None else workspace.where(F.col("folder") == folder)
    return rows.drop("file_blob")


def workspace_purge(workspace: DataFrame, folder: str | None = None, temporary: bool = False, batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The records that stay, and one row with the number ``deleted``: those of the folder, temporary, or of the batch."""
    gone = F.lit(False)
    if folder is not None:
        gone |= F.coalesce(F.col("folder") == folder, F.lit(False))
    if temporary:
        gone |= F.coalesce("is_temporary", F.lit(False))
    if batch is not None:
        gone |= F.coalesce(F.col("batch_number") == batch, F.lit(False))
    return workspace.where(~gone), workspace.agg(F.count_if(gone).alias("deleted"))


def catalog_merge(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New fields that aren't null laid over old rows; ``is_new`` rows come first."""
    a, b = old.alias("a"), new.alias("b")
    rest = [c for c in old.columns if c != key]
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    merged = [F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in new.columns else F.col(f"a.{c}").alias(c) for c in rest]
    return joined.select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *merged, F.col(f"a.{key}").isNull().alias("is_new"))


def catalog_patch(catalog: DataFrame, patches: DataFrame) -> DataFrame:
    """Rows with the status and progress of their patch, where it has one, without those whose patch says ``remove``.

    Patches of unknown ids change nothing. A patch's id must be unique.
    """
    p = patches.select(F.col("id").alias("_id"), F.col("status").alias("_status"), F.col("progress").alias("_progress"), "remove")
    joined = catalog.join(p, catalog["id"] == p["_id"], "left").where("not coalesce(remove, false)")
    return joined.withColumn("status", F.coalesce("_status", "status")).withColumn("progress", F.coalesce("_progress", "progress")).drop("_id", "_status", "_progress", "remove")


def register_upload(uploads: DataFrame, now: Column) -> DataFrame:
    """New catalog rows with defaults; an id that isn't given comes from the name and the batch, so that a retry repeats it."""
    made = F.substring(F.sha2(F.concat_ws("|", "name", F.col("batch").cast("string")), 256), 1, 16)
    return uploads.select(
        F.coalesce("id", made).alias("id"),
        "name",
        F.coalesce("size", F.lit(0).cast("long")).alias("size"),
        F.lit("pending").alias("status"),
        F.lit(0).alias("progress"),
        F.array().cast("array<struct<text:string,material_name:string,target_material_name:string>>").alias("labels"),
        F.lit(False).alias("has_labels"),
        now.alias("updated_at"),
    )
