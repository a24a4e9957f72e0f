"""Assets, meshes, results and runs derived from the tables, as views for queries and their SQL.

The text of a view is the same for Spark and DuckDB, but for those in ``SPARK``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "V_ASSET": """
        select concat('m', lpad(cast(d.doc_id as varchar(12)), 7, '0'), '.',
            case d.doc_id % 5 when 0 then 'glb' when 1 then 'GLTF' when 2 then 'obj' when 3 then 'fbx' else 'stl' end) as id,
            d.doc_id, d.n_chars as size, timestamp '2024-01-01 00:00:00' + d.doc_id * interval '1' minute as created_at, d.lang, d.source
        from documents d""",
    "V_TIER": """
        select 'raw' as tier, a.* from V_ASSET a
        union all select 'labeled', a.* from V_ASSET a join labels l on a.doc_id = l.doc_id
        union all select 'filtered', a.* from V_ASSET a join labels l on a.doc_id = l.doc_id where l.quality = 1 and l.toxic = 0""",
    "V_REQUEST": """
        select doc_id as position, case when doc_id % 5 = 0 then concat('x', id) else id end as id, cast(case when doc_id % 4 = 0 then size * 2 end as bigint) as payload_size
        from V_ASSET""",
    "V_METRICS": """
        select o.o_orderkey as model_id, l.model is not null as has_metrics, case when o.o_orderkey % 7 = 0 then 32 else 64 end as voxel_resolution,
            l.material_count, l.vertex_count, l.face_count, l.occupied, l.surface,
            l.vertex_count / l.occupied as vvd, l.face_count / l.occupied as vfc, case when o.o_orderkey % 11 = 0 then null else l.surface / l.occupied end as vsc
        from orders o left join (select l_orderkey as model, cast(count(distinct l_suppkey) as double) as material_count, cast(sum(l_quantity) as double) as vertex_count,
            cast(count(*) as double) as face_count, cast(count(distinct l_partkey) as double) as occupied, cast(count(distinct l_linenumber) as double) as surface
            from lineitem group by l_orderkey) l on o.o_orderkey = l.model""",
    "V_RESULT": """
        select conv_id as file_id, turn, concat('mat_', cast(turn as varchar(12))) as material_name,
            case when (conv_id * 31 + turn) % 13 = 0 then '' else text end as text, case when (conv_id * 31 + turn) % 13 = 0 then 'timeout' end as error
        from conversations where role = 'assistant'""",
    "V_ATTEMPT": """
        select conv_id as request_id, cast(turn + 1 as bigint) as attempt, (conv_id + turn) % 3 = 0 as ok,
            case when (conv_id + turn) % 3 = 0 then text end as text, case when (conv_id + turn) % 3 <> 0 then concat('e', cast(turn as varchar(12))) end as error
        from conversations""",
    "V_NODE": """
        select p_brand as model_id, p_partkey as node_idx, case when p_partkey % 2 = 1 then replace(p_name, ' ', '_') when p_partkey % 4 = 0 then replace(p_name, ' ', '\u00a0\u3000') else p_name end as node_name from part""",
    "V_NODE_LABEL": """
        select p_brand as model_id, p_name as label_key, min(p_type) as label from part where p_partkey % 3 <> 0 group by p_brand, p_name""",
    "V_OBJ_LINE": """
        select p_brand as file_id, p_partkey as line_no,
            concat('usemtl ', replace(p_name, ' ', '_'), case when p_partkey % 3 = 0 then concat('  # Label:  ', p_type, '\u00a0 \u3000item ') else '' end) as line from part""",
    "V_RUN_EVENT": """
        select user_id as run_id, event_id, ts, event_type <> 'error' as ok from events""",
    "V_WORKSPACE": """
        select case when doc_id % 4 = 0 then id else concat('w', cast(doc_id as varchar(12))) end as id, case when doc_id % 6 = 0 then id end as server_file_id,
            case when doc_id % 2 = 0 then 'uploaded-models' else 'archive' end as folder, doc_id % 5 = 0 as is_temporary, cast(floor(doc_id / 10) as bigint) + 1 as batch_number
        from V_ASSET""",
    "V_VERSION": """
        select o_custkey as id, o_orderkey as version_no, o_orderdate as updated_at, o_orderstatus as status from orders""",
    "V_PROMPT": """
        select * from (values (1, 'p1', 1), (2, 'p2', 3), (3, 'p3', 1), (4, 'p4', 3), (5, 'p5', 3), (6, 'p6', 7)) as t(pos, prompt_id, weight)""",
    "V_MESH": """
        select label as model_id, vec_id as mesh_id, concat('mesh_', cast(vec_id as varchar(12))) as mesh_name, concat('u', cast(vec_id % 7 as varchar(12))) as material_id from embeddings""",
    "V_VERTEX": """
        select label as model_id, vec_id as mesh_id, cast(vi as int) as vi, cast(embedding[3*vi+1] as double) as x, cast(embedding[3*vi+2] as double) as y, cast(embedding[3*vi+3] as double) as z
        from embeddings, range(0, 21) r(vi)""",
    "V_PLACE": """
        select model_id, mesh_id, material_id, case when mesh_id % 50 <> 49 then cast(0.15 as double) end as c, case when mesh_id % 50 <> 49 then cast(0.2 as double) end as s,
            cast(mesh_id % 7 as double) * 6 as tx, cast(cast(floor(mesh_id / 7) as bigint) % 7 as double) * 6 as ty, cast(mesh_id % 5 as double) * 8 as tz from V_MESH""",
    "V_FACE": """
        select model_id, mesh_id, cast(k as int) as k, cast((k * k + mesh_id) % 22 as int) as vi from V_MESH, range(0, 31) r(k) where mesh_id % 2 = 0""",
    "V_CHUNK": """
        select doc_id as file_id, chunk_index, cast(ceil(length(text)/1000.0) as int) as total_chunks, substr(text, cast(chunk_index*1000+1 as int), 1000) as data
        from (select doc_id, text, cast(unnest(range(0, cast(ceil(length(text)/1000.0) as int))) as int) as chunk_index from documents where length(text) > 0)""",
    "V_CHUNK_LEFT": """
        select * from V_CHUNK where (file_id + chunk_index) % 17 <> 0""",
    "V_SCENE": """
        select m.model_id, m.mesh_id, m.mesh_name, case when m.mesh_id % 3 = 0 then concat('user ', m.mesh_name) when m.mesh_id % 3 = 1 then ' ' end as user_label,
            case when m.mesh_id % 4 = 1 then concat('semantic ', m.material_id) end as semantic_label, case when m.mesh_id % 5 < 2 then m.material_id else '' end as material_label
        from V_MESH m""",
    "V_MESH_RESULT": """
        select m.model_id, c.turn as result_order, case when m.mesh_id % 2 = 0 then m.mesh_name else cast(m.mesh_id as varchar(12)) end as target,
            case when (m.mesh_id + c.turn) % 7 = 0 then '' else concat('label ', cast(c.conv_id as varchar(12)), ' ', cast(c.turn as varchar(12))) end as label
        from V_MESH m join conversations c on m.mesh_id = c.conv_id""",
}

#: Views whose text differs in Spark: arrays count from 0 there, and rows are exploded in another way. Several distinct counts
#: would copy each line for each of them before a shuffle; as the last of dense ranks they need one shuffle of the lines.
#: V_FILE is V_ASSET with the text beside it, which a join of the documents with themselves would shuffle.
SPARK = {
    "V_FILE": VIEWS["V_ASSET"].replace("d.source\n", "d.source, d.text\n") + " where d.doc_id is not null",
    "V_METRICS": """
        select o.o_orderkey as model_id, l.model is not null as has_metrics, case when o.o_orderkey % 7 = 0 then 32 else 64 end as voxel_resolution,
            l.material_count, l.vertex_count, l.face_count, l.occupied, l.surface,
            l.vertex_count / l.occupied as vvd, l.face_count / l.occupied as vfc, case when o.o_orderkey % 11 = 0 then null else l.surface / l.occupied end as vsc
        from orders o left join (select l_orderkey as model, cast(max(case when l_suppkey is null then 0 else supp end) as double) as material_count, cast(sum(l_quantity) as double) as vertex_count,
            cast(count(*) as double) as face_count, cast(max(case when l_partkey is null then 0 else part end) as double) as occupied, cast(max(case when l_linenumber is null then 0 else line end) as double) as surface
            from (select l_orderkey, l_quantity, l_suppkey, l_partkey, l_linenumber, dense_rank() over (partition by l_orderkey order by l_suppkey nulls last) as supp,
                dense_rank() over (partition by l_orderkey order by l_partkey nulls last) as part, dense_rank() over (partition by l_orderkey order by l_linenumber nulls last) as line
                from lineitem where l_orderkey is not null)
            group by l_orderkey) l on o.o_orderkey = l.model""",
    "V_FACE": """
        select model_id, mesh_id, k, cast((k * k + mesh_id) % 22 as int) as vi from (select model_id, mesh_id, explode(sequence(0, 30)) as k from V_MESH where mesh_id % 2 = 0)""",
    "V_VERTEX": """
        select model_id, mesh_id, vi, cast(embedding[3*vi] as double) as x, cast(embedding[3*vi+1] as double) as y, cast(embedding[3*vi+2] as double) as z
        from (select label as model_id, vec_id as mesh_id, embedding, explode(sequence(0, 20)) as vi from embeddings)""",
    "V_CHUNK": """
        select doc_id as file_id, chunk_index, cast(ceil(length(text)/1000.0) as int) as total_chunks, substr(text, chunk_index*1000+1, 1000) as data
        from (select doc_id, text, explode(sequence(0, cast(ceil(length(text)/1000.0) as int)-1)) as chunk_index from documents where length(text) > 0)""",
}

_NAME = re.compile(r"\bV_[A-Z_]+\b")


def _needed(text: str, texts: dict[str, str]) -> list[str]:
    """The views that a text names, each after those that it names itself."""
    order: list[str] = []
    for name in dict.fromkeys(_NAME.findall(text)):
        order += [n for n in [*_needed(texts[name], texts), name] if n not in order]
    return order


def with_views(body: str, texts: dict[str, str] = VIEWS) -> str:
    """A statement with the views that it names in front; it may begin with ``with`` itself."""
    heads = [f"{n} as ({texts[n].strip()})" for n in _needed(body, texts)]
    body = body.strip()
    if body[:5].lower() == "with ":
        return "with " + ",\n".join([*heads, body[5:]])
    return ("with " + ",\n".join(heads) + "\n" if heads else "") + body


def run_sql(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    """The rows of a statement over views and tables, read from a folder."""
    text = with_views(body, VIEWS | SPARK).replace("timestamp '", "timestamp_ntz '")  # as DuckDB's, without a time zone
    used = set(re.findall(rf"(?:from|join)\s+({'|'.join(TABLES)})\b", text))
    text = re.sub(rf"\b(from|join)\s+({'|'.join(TABLES)})\b", r"\1 {\2}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"select * from {name}")
