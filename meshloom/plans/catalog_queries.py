"""The catalog over the documents, read as assets in three tiers, and uploads in chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.functions.text import extension, label_status
from meshloom.operators import catalog, chunks
from meshloom.plans.registry import query
from meshloom.plans.views import run_sql, view
from meshloom.sources import containers, storage, tiers
from meshloom.sources.shared import shared_folder
from meshloom.streaming import jobs

NOW = "2024-06-01 00:00:00"
#: About as many assets of scan_tier lie in a folder, which one task lists.
FILES = 50_000
_RANK = "case tier when 'raw' then 1 when 'labeled' then 2 else 3 end"
_BEST = f"best as (select * from (select *, row_number() over (partition by id order by {_RANK} desc) as place from V_TIER) where place = 1)"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "V_TIER")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "V_REQUEST")


@query(
    "scan_tier",
    """select a.id, case when a.doc_id % 13 = 0 then 0 else strlen(d.text) end as size, a.doc_id % 3 = 0 as has_sidecar,
        case when a.doc_id % 6 = 0 then 'labeled' else 'raw' end as status, case when a.doc_id % 6 = 0 then a.lang end as label_text,
        case when a.doc_id % 6 = 0 then a.source end as source_type, case when a.doc_id % 6 = 0 then cast(a.n_chars as bigint) end as vertex_count
        from (select *, size as n_chars from V_ASSET) a join documents d on a.doc_id = d.doc_id""",
)
def scan_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document becomes a file, some of them empty; a third has sidecars, half of which are no JSON; then the folders are scanned."""
    rows = view(spark, sf_dir, "V_FILE")
    label = F.array(F.struct(F.col("lang").alias("text")))
    said = F.to_json(F.struct(label.alias("labels"), F.lit(True).alias("hasLabels"), F.col("source").alias("sourceType"), F.struct(F.col("size").alias("vertexCount")).alias("filterMetrics")))
    sidecar = F.when(F.col("doc_id") % 6 == 0, said).when(F.col("doc_id") % 3 == 0, "{broken")
    content = F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("text")).cast("binary")
    root = shared_folder(spark, "assets")
    roots = [f"{root}/{i}" for i in range(rows.count() // FILES + 1)]
    storage.write_assets(rows.select("id", content.alias("content"), sidecar.alias("sidecar")), roots, "raw")
    found = storage.scan_tier(spark, roots, "raw")
    return found.select("id", "size", "has_sidecar", "status", F.get("labels", F.lit(0))["text"].alias("label_text"), F.col("sourceType").alias("source_type"), F.col("filterMetrics.vertexCount").alias("vertex_count"))


@query("scan_all_tiers", f"select id, size, tier as type, cast({_RANK} as int) as tier_rank from V_TIER")
def scan_all_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tiers(spark, sf_dir)
    return catalog.all_tiers({t: rows.where(F.col("tier") == t).select("id", "size") for t in catalog.TIERS})


@query("resolve_asset", f"with {_BEST} select tier, id, size from best")
def resolve_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.resolve_assets(_tiers(spark, sf_dir)).select("tier", "id", "size")


@query(
    "batch_lookup",
    f"""with {_BEST} select position, r.id, b.id as name, b.size, tier as type, case when b.id is not null then concat('/files/', tier, '/', r.id) end as download_url,
        case when b.id is null then 'not found' end as error from V_REQUEST r left join best b on r.id = b.id""",
)
def batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.batch_lookup(_requests(spark, sf_dir).select("position", "id"), _tiers(spark, sf_dir))


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(
        spark,
        sf_dir,
        """select position, case when position % 7 = 0 then null else id end as id, case position % 4 when 0 then 'raw' when 1 then null when 2 then 'labeled' else 'attic' end as tier,
        case when position % 11 = 0 then null else concat('{{"n":', cast(position as varchar(12)), '}}') end as metadata from V_REQUEST""",
    )


_UPDATES = """upd as (select position, case when position % 7 = 0 then null else id end as id, coalesce(case position % 4 when 0 then 'raw' when 1 then null when 2 then 'labeled' else 'attic' end, 'labeled') as tier,
    case when position % 11 = 0 then null else concat('{"n":', cast(position as varchar(12)), '}') end as metadata from V_REQUEST)"""


@query(
    "update_metadata",
    f"""with {_UPDATES}, good as (select tier, id, metadata from upd where id is not null and metadata is not null and tier <> 'attic')
        select tier, id, lang as metadata from V_TIER t where not exists (select 1 from good g where g.id = t.id and g.tier = t.tier) union all select * from good""",
)
def update_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    sidecars = _tiers(spark, sf_dir).select("tier", "id", F.col("lang").alias("metadata"))
    return catalog.update_metadata(sidecars, _updates(spark, sf_dir))[0]


@query(
    "update_rejects",
    f"""with {_UPDATES} select position, id, tier, case when id is null or metadata is null then 'id and metadata are required' else 'unknown tier' end as error from upd
        where id is null or metadata is null or tier = 'attic'""",
)
def update_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    sidecars = _tiers(spark, sf_dir).select("tier", "id", F.col("lang").alias("metadata"))
    return catalog.update_metadata(sidecars, _updates(spark, sf_dir))[1].select("position", "id", "tier", "error")


@query(
    "promote_to_labeled",
    f"""select id, case when good then 'labeled' end as tier, case when good then id end as filename, coalesce(payload_size, size) as size, case when good then true end as has_labels,
        case when good then timestamp '{NOW}' end as moved_at, case when not good then 'no payload and no raw asset' end as error
        from (select r.id, payload_size, t.size, payload_size is not null or t.id is not null as good from V_REQUEST r left join (select * from V_TIER where tier = 'raw') t on r.id = t.id)""",
)
def promote_to_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.promote_to_labeled(_tiers(spark, sf_dir), _requests(spark, sf_dir), _now())


@query(
    "copy_to_filtered",
    f"""select r.id, case when t.id is not null then 'filtered' end as tier, size, case when has_sidecar then timestamp '{NOW}' end as filtered_at,
        case when has_sidecar then 'labeled' end as source_type, case when t.id is null then 'not in labeled' end as error
        from V_REQUEST r left join (select *, doc_id % 2 = 0 as has_sidecar from V_TIER where tier = 'labeled') t on r.id = t.id""",
)
def copy_to_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = _tiers(spark, sf_dir).withColumn("has_sidecar", F.col("doc_id") % 2 == 0)
    return catalog.copy_to_filtered(assets, _requests(spark, sf_dir).select("id"), _now())


@query("delete_assets", "select tier, id from V_TIER t where not exists (select 1 from V_REQUEST r where r.id = t.id)")
def delete_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.delete_assets(_tiers(spark, sf_dir), _requests(spark, sf_dir))[0].select("tier", "id")


@query("delete_not_found", "select position, id from V_REQUEST r where not exists (select 1 from V_TIER t where r.id = t.id)")
def delete_not_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.delete_assets(_tiers(spark, sf_dir), _requests(spark, sf_dir))[1].select("position", "id")


def _tier_table(spark: SparkSession, sf_dir: str) -> str:
    root = shared_folder(spark, "tier-table")
    tiers.write_tiers(_tiers(spark, sf_dir).select("tier", "id", "size", (F.col("doc_id") % 2 == 0).alias("has_sidecar")), root)
    return root


def _table_rows(spark: SparkSession, root: str) -> DataFrame:
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("moved_at", "filtered_at")]
    return tiers.read_tiers(spark, root).select("tier", "id", "size", "has_sidecar", "has_labels", *times, "source_type")


_TABLE = "select tier, id, size, doc_id % 2 = 0 as has_sidecar, cast(null as boolean) as has_labels, cast(null as timestamp) as moved_at, cast(null as timestamp) as filtered_at, cast(null as varchar) as source_type from V_TIER"


@query(
    "tier_promote",
    f"""with moved as (select 'labeled' as tier, r.id, coalesce(payload_size, t.size) as size, true as has_sidecar, true as has_labels, timestamp '{NOW}' as moved_at, cast(null as timestamp) as filtered_at, cast(null as varchar) as source_type
            from V_REQUEST r left join (select * from V_TIER where tier = 'raw') t on r.id = t.id where payload_size is not null or t.id is not null)
        select * from ({_TABLE}) t where not (tier = 'labeled' and id in (select id from moved)) union all select * from moved""",
)
def tier_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of tiers after the requested assets were promoted in it."""
    root = _tier_table(spark, sf_dir)
    tiers.promote(spark, root, _requests(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return _table_rows(spark, root)


_COPIED = f"""copied as (select 'filtered' as tier, r.id, t.size, coalesce(has_sidecar, false) as has_sidecar, cast(null as boolean) as has_labels, cast(null as timestamp) as moved_at,
            case when has_sidecar then timestamp '{NOW}' end as filtered_at, case when has_sidecar then 'labeled' end as source_type
            from V_REQUEST r join (select *, doc_id % 2 = 0 as has_sidecar from V_TIER where tier = 'labeled') t on r.id = t.id)"""


@query("tier_copy", f"with {_COPIED} select * from ({_TABLE}) t where not (tier = 'filtered' and id in (select id from copied)) union all select * from copied")
def tier_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _tier_table(spark, sf_dir)
    tiers.copy_filtered(spark, root, _requests(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return _table_rows(spark, root)


@query("tier_replace", f"with {_COPIED} select * from ({_TABLE}) t where tier <> 'filtered' union all select * from copied")
def tier_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered tier holds nothing but what was copied last."""
    root = _tier_table(spark, sf_dir)
    tiers.copy_filtered(spark, root, _requests(spark, sf_dir), F.lit(NOW).cast("timestamp"), replace=True)
    return _table_rows(spark, root)


@query("tier_delete", f"select * from ({_TABLE}) t where not exists (select 1 from V_REQUEST r where r.id = t.id)")
def tier_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _tier_table(spark, sf_dir)
    tiers.delete(spark, root, _requests(spark, sf_dir).select("id"))
    return _table_rows(spark, root)


@query(
    "tier_inventory",
    """select tier, count(*) as files, count(*) filter (lower(id) like '%.glb') as glb_files,
        array_to_string((array_agg(id order by id) filter (lower(id) like '%.glb'))[1:3], ',') as sample_names from V_TIER group by tier""",
)
def tier_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.tier_inventory(_tiers(spark, sf_dir))


@query("by_extension", "select id, lower(regexp_extract(id, '([^.]*)$', 1)) as extension from V_ASSET where lower(regexp_extract(id, '([^.]*)$', 1)) in ('glb', 'gltf', 'obj', 'fbx', 'stl')")
def by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "V_ASSET").select("id", extension(F.col("id")).alias("extension")).where(F.col("extension").isin(*catalog.FORMATS))


@query("untagged", "select id from V_ASSET a left join labels l on a.doc_id = l.doc_id where not coalesce(l.quality = 1, false) and coalesce(l.toxic, 0) = 0")
def untagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "select a.id, l.quality = 1 as has_labels, l.toxic as toxic from V_ASSET a left join labels l on a.doc_id = l.doc_id")
    return catalog.untagged(rows.withColumn("labels", F.array_repeat(F.lit("x"), F.coalesce("toxic", F.lit(0))))).select("id")


@query("label_status", "select a.id, case when coalesce(l.quality = 1, false) then 'labeled' when source in ('src1', 'src2') then 'processing' when source = 'src3' then 'failed' else 'unlabeled' end as label_status from V_ASSET a left join labels l on a.doc_id = l.doc_id")
def label_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(
        spark,
        sf_dir,
        """select a.id, l.quality = 1 as has_labels, case source when 'src1' then 'processing' when 'src2' then 'uploading' when 'src3' then 'error' else 'pending' end as status
        from V_ASSET a left join labels l on a.doc_id = l.doc_id""",
    )
    return rows.select("id", label_status(F.col("has_labels"), F.col("status")).alias("label_status"))


@query("resume_anti", "select r.id, r.size from V_TIER r where tier = 'raw' and not exists (select 1 from V_TIER l where l.tier = 'labeled' and l.id = r.id)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tiers(spark, sf_dir)
    return catalog.without_labeled(rows.where("tier = 'raw'"), rows.where("tier = 'labeled'")).select("id", "size")


@query("workspace_flag", "select a.id, exists (select 1 from V_WORKSPACE w where w.id = a.id) or exists (select 1 from V_WORKSPACE w where w.server_file_id = a.id) as is_in_workspace from V_ASSET a")
def workspace_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.workspace_flag(view(spark, sf_dir, "V_ASSET").select("id"), view(spark, sf_dir, "V_WORKSPACE"))


@query(
    "workspace_put",
    """select id, name, size, type, folder, label_text, has_labels, is_temporary, is_from_server, server_file_id, batch_number from (
        select a.id, a.id as name, a.size, coalesce(case when a.doc_id % 3 = 0 then 'obj' end, 'unknown') as type, coalesce(case when a.doc_id % 2 = 0 then 'mine' end, 'uploaded-models') as folder,
            case when a.doc_id % 4 = 0 then a.lang else '' end as label_text, false as has_labels, false as is_temporary, a.doc_id % 5 = 0 as is_from_server, cast(null as varchar) as server_file_id, cast(7 as bigint) as batch_number
        from V_ASSET a
        union all select w.id, null, null, null, folder, '', null, is_temporary, null, server_file_id, batch_number from V_WORKSPACE w
            where not exists (select 1 from V_ASSET a where a.id = w.id))""",
)
def workspace_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = view(spark, sf_dir, "V_ASSET")
    kind = "array<struct<text:string,material_name:string,target_material_name:string>>"
    label = F.array(F.struct(F.col("lang").alias("text"), F.lit(None).alias("material_name"), F.lit(None).alias("target_material_name"))).cast(kind)
    none = F.lit(None)
    records = assets.select(
        "id",
        none.cast("string").alias("name"),
        "size",
        F.when(F.col("doc_id") % 3 == 0, "obj").alias("type"),
        F.when(F.col("doc_id") % 2 == 0, "mine").alias("folder"),
        F.when(F.col("doc_id") % 4 == 0, label).alias("labels"),
        none.cast("boolean").alias("has_labels"),
        none.cast("boolean").alias("is_temporary"),
        (F.col("doc_id") % 5 == 0).alias("is_from_server"),
        none.cast("string").alias("server_file_id"),
        F.lit(7).cast("long").alias("batch_number"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("version"),
    )
    put = catalog.workspace_put(view(spark, sf_dir, "V_WORKSPACE"), records)
    text = F.concat_ws(",", F.transform("labels", lambda x: x["text"])).alias("label_text")
    return put.select("id", "name", "size", "type", "folder", text, "has_labels", "is_temporary", "is_from_server", "server_file_id", "batch_number")


@query("workspace_list", "select id, server_file_id, folder, is_temporary, batch_number from V_WORKSPACE where folder = 'uploaded-models'")
def workspace_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.workspace_list(view(spark, sf_dir, "V_WORKSPACE"))


@query("workspace_purge", "select id, folder, is_temporary, batch_number from V_WORKSPACE where not (folder = 'archive' or is_temporary or batch_number = 3)")
def workspace_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.workspace_purge(view(spark, sf_dir, "V_WORKSPACE"), "archive", True, 3)[0].select("id", "folder", "is_temporary", "batch_number")


@query("workspace_purged", "select count(*) filter (folder = 'archive' or is_temporary or batch_number = 3) as deleted from V_WORKSPACE")
def workspace_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.workspace_purge(view(spark, sf_dir, "V_WORKSPACE"), "archive", True, 3)[1]


_LATEST = "last as (select * from (select *, row_number() over (partition by id order by updated_at desc, version_no desc) as place from V_VERSION) where place = 1)"


@query("latest_wins", f"with {_LATEST} select id, version_no, updated_at, status from last")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest_wins(view(spark, sf_dir, "V_VERSION"), "id", "updated_at", "version_no")


@query("stream_catalog", f"with {_LATEST} select id, version_no, updated_at, status from last")
def stream_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams with checkpoints of their own fold their half of the records into one catalog."""
    rows, root = view(spark, sf_dir, "V_VERSION"), shared_folder(spark, "catalog")
    for half in (0, 1):
        rows.where(F.col("version_no") % 2 == half).write.parquet(f"{root}/source{half}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/source{half}")
        jobs.stream_catalog(stream, f"{root}/table", f"{root}/checkpoint{half}", buckets=8).awaitTermination()
    return jobs.read_latest(spark, f"{root}/table").select("id", "version_no", "updated_at", "status")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, "select c_custkey * 2 as id, c_name as name, c_mktsegment as status, cast(0 as int) as progress from customer")


@query(
    "catalog_merge",
    f"""with {_LATEST} select coalesce(n.id, o.id) as id, o.name, coalesce(n.status, o.status) as status, o.id is null as is_new
        from (select c_custkey * 2 as id, c_name as name, c_mktsegment as status from customer) o
        full join (select id, case when id % 3 <> 0 then status end as status from last) n on o.id = n.id""",
)
def catalog_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = latest_wins(spark, sf_dir).select("id", F.when(F.col("id") % 3 != 0, F.col("status")).alias("status"))
    return catalog.catalog_merge(_customers(spark, sf_dir).drop("progress"), new)


@query(
    "catalog_patch",
    f"""with {_LATEST} select o.id, name, coalesce(p.status, o.status) as status, coalesce(p.progress, o.progress) as progress
        from (select c_custkey * 2 as id, c_name as name, c_mktsegment as status, cast(0 as int) as progress from customer) o
        left join (select id, case when id % 3 = 0 then status end as status, cast(case when id % 5 = 0 then 50 end as int) as progress, id % 7 = 0 as remove from last) p on o.id = p.id
        where not coalesce(remove, false)""",
)
def catalog_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    last, i = latest_wins(spark, sf_dir), F.col("id")
    patches = last.select("id", F.when(i % 3 == 0, F.col("status")).alias("status"), F.when(i % 5 == 0, F.lit(50)).alias("progress"), (i % 7 == 0).alias("remove"))
    return catalog.catalog_patch(_customers(spark, sf_dir), patches)


@query(
    "register_upload",
    f"""select coalesce(case when doc_id % 2 = 0 then id end, substr(sha256(concat(id, '|', cast(cast(doc_id // 10 as bigint) as varchar))), 1, 16)) as id, id as name, coalesce(size, 0) as size,
        'pending' as status, cast(0 as int) as progress, cast(0 as int) as n_labels, false as has_labels, timestamp '{NOW}' as updated_at from V_ASSET""",
)
def register_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads = view(spark, sf_dir, "V_ASSET").select(
        F.when(F.col("doc_id") % 2 == 0, F.col("id")).alias("id"), F.col("id").alias("name"), "size", F.floor(F.col("doc_id") / 10).alias("batch")
    )
    return catalog.register_upload(uploads, _now()).withColumn("n_labels", F.size("labels")).drop("labels")


@query("newest_first", "select id, created_at, row_number() over (order by created_at desc, id) as place from V_ASSET")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.numbered(view(spark, sf_dir, "V_ASSET").select("id", "created_at"), F.desc("created_at"), F.col("id"))


@query(
    "page",
    """select id, created_at, total, total_pages from (select id, created_at, row_number() over (order by created_at desc, id) as place, count(*) over () as total,
        cast(ceil(count(*) over () / 50.0) as bigint) as total_pages from V_ASSET) where place between 51 and 100""",
)
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.page(view(spark, sf_dir, "V_ASSET").select("id", "created_at"), 2, 50, F.desc("created_at"), F.col("id"))


@query(
    "deep_page",
    """select tier, id, size, place, total, cast(ceil(total / 40.0) as bigint) as total_pages from (select tier, id, size, row_number() over (order by tier, id) as place, count(*) over () as total from V_TIER)
        where place > (total - 1) // 40 * 40 or place between 81 and 120""",
)
def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page and the third, from an index over the sorted table."""
    path = catalog.page_index(_tiers(spark, sf_dir).select("tier", "id", "size"), F.col("tier"), F.col("id"))
    third = catalog.indexed_page(spark, path, 3, 40)
    last = third.select("total_pages").first()[0]
    return third.unionByName(catalog.indexed_page(spark, path, last, 40)).distinct()


@query("batch_number", "select id, cast((row_number() over (order by created_at desc, id) - 1) // 50 + 1 as bigint) as batch_number from V_ASSET")
def batch_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.batch_numbers(view(spark, sf_dir, "V_ASSET").select("id", "created_at"), 50, F.desc("created_at"), F.col("id")).select("id", "batch_number")


# ---- uploads


@query(
    "chunk_plan",
    """select file_id, chunk_index, total_chunks, chunk_index * 1000 as start_byte, least((chunk_index + 1) * 1000, size) as end_byte
        from (select doc_id as file_id, n_chars as size, cast(ceil(n_chars / 1000.0) as bigint) as total_chunks, unnest(range(0, cast(ceil(n_chars / 1000.0) as bigint))) as chunk_index from documents where n_chars > 0)""",
)
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_plan(run_sql(spark, sf_dir, "select doc_id as file_id, n_chars as size from documents"), 1000)


#: Chunks that have arrived, and for each document an upload of no chunks, too.
_LEFT = "rows as (select file_id, chunk_index, total_chunks, data from V_CHUNK_LEFT union all select -1 - doc_id, cast(null as int), 0, cast(null as varchar(1)) from documents)"


def _left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"with {_LEFT} select * from rows")


@query(
    "chunk_status",
    f"""with {_LEFT} select file_id, total_chunks, coalesce(array_to_string(list_sort(list(chunk_index) filter (chunk_index is not null)), ','), '') as uploaded,
        array_to_string(list_filter(range(0, total_chunks), lambda i: not list_contains(list(chunk_index), i)), ',') as missing, count(chunk_index) > 0 as should_resume from rows group by file_id, total_chunks""",
)
def chunk_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = [F.concat_ws(",", F.col(c).cast("array<string>")).alias(c) for c in ("uploaded", "missing")]
    return chunks.chunk_status(_left(spark, sf_dir)).select("file_id", "total_chunks", *joined, "should_resume")


def _assembled(size: str) -> str:
    return f"""with {_LEFT} select file_id, case when n = total_chunks then md5(content) end as md5, case when n = total_chunks then {size}(content) end as size,
        case when n < total_chunks then concat('missing chunk ', cast(first_missing as varchar)) end as error
        from (select file_id, total_chunks, count(chunk_index) as n, coalesce(string_agg(data, '' order by chunk_index), '') as content,
            list_filter(range(0, total_chunks), lambda i: not list_contains(list(chunk_index), i))[1] as first_missing from rows group by file_id, total_chunks)"""


@query("assemble_chunks", _assembled("length"))
def assemble_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.assemble_chunks(_left(spark, sf_dir)).select("file_id", F.md5("content").alias("md5"), "size", "error")


@query("assemble_binary", _assembled("strlen"))
def assemble_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chunks as bytes, sized in bytes."""
    rows = _left(spark, sf_dir).withColumn("data", F.col("data").cast("binary"))
    return chunks.assemble_chunks(rows).select("file_id", F.md5("content").alias("md5"), "size", "error")


@query("cancel_upload", "select file_id, chunk_index, total_chunks from V_CHUNK where file_id % 3 <> 0")
def cancel_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "V_CHUNK")
    gone = run_sql(spark, sf_dir, "select doc_id as file_id from documents where doc_id % 3 = 0")
    return chunks.cancel_upload(rows, gone).select("file_id", "chunk_index", "total_chunks")


# ---- containers


def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container per document with its language as a node's label; some are damaged, each in its own way."""
    docs = run_sql(spark, sf_dir, "select doc_id as file_id, lang, source from documents")
    item = lambda name, label: F.struct(name.alias("name"), F.struct(label.alias("semanticLabel")).alias("extras"))
    nodes = F.array(item(F.concat(F.lit("node "), F.col("source")), F.col("lang")), item(F.lit("bare"), F.lit(None).cast("string")))
    content = containers.build_glb(F.to_json(F.struct(nodes.alias("nodes"), F.array(item(F.col("source"), F.when(F.col("file_id") % 2 == 0, F.col("source")))).alias("meshes"))))
    way, size = F.col("file_id") % 11, F.length("content")
    head = lambda a, new, rest: F.concat(F.substring("content", 1, a), F.unhex(F.lit(new)), F.substring("content", rest, 1 << 30))
    broken = (
        F.when(way == 1, F.substring("content", 1, 10))
        .when(way == 2, head(0, "676C5447", 5))
        .when(way == 3, head(4, "01000000", 9))
        .when(way == 4, F.substring(F.col("content"), F.lit(1), size - 4))
        .when(way == 5, head(16, "42494E00", 21))
        .when(way == 6, head(12, "FFFFFFFF", 17))
        .when(way == 7, head(20, "5B", 22))
        .otherwise(F.col("content"))
    )
    path = shared_folder(spark, "containers")
    docs.withColumn("content", content).select("file_id", broken.alias("content")).write.parquet(path)
    return spark.read.parquet(path)


@query(
    "glb_validate",
    """select doc_id as file_id, doc_id % 11 = 0 or doc_id % 11 > 7 as valid, case doc_id % 11 when 1 then 'too short' when 2 then 'bad magic' when 3 then 'unsupported version' when 4 then 'length mismatch'
        when 5 then 'first chunk is not JSON' when 6 then 'chunk exceeds file' when 7 then 'broken JSON' end as error from documents""",
)
def glb_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.glb_validate(_containers(spark, sf_dir))


@query(
    "glb_labels",
    """select doc_id as file_id, 'node' as kind, cast(0 as int) as position, concat('node ', source) as name, lang as label from documents where doc_id % 11 = 0 or doc_id % 11 > 7
        union all select doc_id, 'mesh', cast(0 as int), source, source from documents where (doc_id % 11 = 0 or doc_id % 11 > 7) and doc_id % 2 = 0""",
)
def glb_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.glb_labels(_containers(spark, sf_dir))
