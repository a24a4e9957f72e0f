"""Labels over the conversations, meshes and parts: cleaning, matching, prompts and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.functions import text as t
from meshloom.operators import labels
from meshloom.plans.registry import query
from meshloom.plans.views import run_sql, view
from meshloom.sources import containers
from meshloom.sources.shared import shared_folder
from meshloom.sources.storage import load_prompts

KEYWORDS = ["the  of", "with", "  ", "ing in"]
_PATTERN = r"(the\s+of|with|ing\s+in)"
_GOOD = "coalesce(error, '') = '' and coalesce(text, '') <> ''"
# Fixed value: white space, as the text functions take it.
_WS = r"[\x{09}-\x{0D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _collapsed(text: str) -> str:
    return f"trim(regexp_replace({text}, '{_WS}+', ' ', 'g'))"


def _norm(name: str) -> str:
    return _collapsed(f"regexp_replace({name}, '[_\\->]', ' ', 'g')")


#: Labels of nodes by key and by normalized key, the last in order of each.
_KNOWN = f"""told as (select model_id, label_key, label, 1 as label_order from V_NODE_LABEL union all select model_id, replace(label_key, ' ', '-'), concat('later ', label), 2 from V_NODE_LABEL where length(label_key) % 3 = 0),
        known as (select model_id, key, arg_max(label, label_order) as label from (select model_id, label_key as key, label, label_order from told union all select model_id, {_norm('label_key')}, label, label_order from told) group by model_id, key)"""


def _node_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, "select model_id, label_key, label, 1 as label_order from V_NODE_LABEL union all select model_id, replace(label_key, ' ', '-'), concat('later ', label), 2 from V_NODE_LABEL where length(label_key) % 3 = 0")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "V_RESULT")


@query("ignore_keywords", f"select file_id, turn, coalesce(regexp_matches(text, '{_PATTERN}', 'i'), false) as ignored from V_RESULT")
def ignore_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("file_id", "turn", t.has_keyword(F.col("text"), KEYWORDS).alias("ignored"))


def _library(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A library of prompts, written as its JSON file and loaded: a prompt for each nation, keywords from the regions besides the fixed ones."""
    fields = F.struct(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("Name the parts of "), "n_name").alias("content"), (F.col("n_regionkey") + 1).alias("weight"))
    prompts = run_sql(spark, sf_dir, "select * from nation").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", fields.alias("p")))).alias("x")).select(F.col("x.p").alias("prompts"))
    words = run_sql(spark, sf_dir, "select * from region").agg(F.sort_array(F.collect_list("r_name")).alias("names"))
    rows = prompts.crossJoin(words).select(F.to_json(F.struct(F.lit("weighted").alias("selectionRule"), F.concat(F.array(*map(F.lit, KEYWORDS)), "names").alias("ignoreKeywords"), "prompts")).alias("value"))  # a row each
    path = shared_folder(spark, "prompts")
    rows.coalesce(1).write.text(path)
    none = spark.createDataFrame([], "pos int, prompt_id string, content string, weight int")
    return load_prompts(spark, path, none)


@query("load_prompts", "select cast(row_number() over (order by n_nationkey) as int) as pos, concat('p', n_nationkey) as prompt_id, concat('Name the parts of ', n_name) as content, cast(n_regionkey + 1 as int) as weight, 'weighted' as rule from nation")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, rule = _library(spark, sf_dir)
    return found.withColumn("rule", rule.scalar())


@query(
    "keyword_table",
    rf"""select file_id, turn, coalesce(regexp_matches(text, (select '(the\s+of|with|ing\s+in|' || string_agg(r_name, '|') || ')' from region), 'i'), false) as ignored,
        coalesce(regexp_matches(text, '(with\.|ing\s+in)', 'i'), false) as ignored_literally from V_RESULT""",
)
def keyword_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords as a table: those of the library, and some that are no patterns."""
    words = _library(spark, sf_dir)[1]
    fixed = spark.createDataFrame([("with.",), (" ING  in ",), ("",), (None,)], "keyword string")
    return _results(spark, sf_dir).select("file_id", "turn", t.has_keyword_of(F.col("text"), words).alias("ignored"), t.has_keyword_of(F.col("text"), fixed, literal=True).alias("ignored_literally"))


@query("valid_labels", f"select file_id, turn, text from V_RESULT where {_GOOD} and not regexp_matches(text, '{_PATTERN}', 'i')")
def valid_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.valid_labels(_results(spark, sf_dir), KEYWORDS).select("file_id", "turn", "text")


@query(
    "file_label_outcome",
    f"""with found as (select file_id, count(*) filter ({_GOOD}) as successes, count(*) filter (not ({_GOOD})) as failures from V_RESULT group by file_id),
            bad as (select distinct conv_id as file_id from conversations where conv_id % 17 = 0 union select distinct -1 - conv_id from conversations where conv_id % 29 = 0)
        select coalesce(b.file_id, f.file_id) as file_id, coalesce(successes, 0) as successes, coalesce(failures, 0) as failures,
            case when b.file_id is not null then 'error' when successes = 0 then 'skipped' else 'done' end as outcome
        from found f full join bad b on f.file_id = b.file_id""",
)
def file_label_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some files failed after results, some before any (those with an id below zero)."""
    bad = run_sql(spark, sf_dir, "select conv_id as file_id from conversations where conv_id % 17 = 0 union all select -1 - conv_id from conversations where conv_id % 29 = 0")
    return labels.file_label_outcome(_results(spark, sf_dir), bad)


@query("batch_state", f"select count(*) as total, count(*) filter ({_GOOD}) as successes, case when count(*) filter ({_GOOD}) = 0 then 'error' when count(*) filter ({_GOOD}) < count(*) then 'warning' else 'success' end as state from V_RESULT")
def batch_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.batch_state(_results(spark, sf_dir))


@query(
    "attempt_outcome",
    """select request_id, coalesce(bool_or(ok), false) as ok, case when bool_or(ok) then coalesce(arg_min(text, attempt) filter (ok), '') else '' end as text,
        case when not bool_or(ok) then arg_max(error, attempt) filter (not ok) end as error from V_ATTEMPT where attempt <= 3 group by request_id""",
)
def attempt_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.attempt_outcome(view(spark, sf_dir, "V_ATTEMPT"))


_LABEL = "coalesce(nullif(user_label, ''), nullif(semantic_label, ''), nullif(material_label, ''))"


@query("label_precedence", f"select model_id, mesh_id, {_LABEL} as label from V_SCENE")
def label_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.scene_label_index(view(spark, sf_dir, "V_SCENE")).select("model_id", "mesh_id", "label")


@query("scene_label_index", f"select model_id, count(*) as meshes, count({_LABEL}) as labeled from V_SCENE group by model_id")
def scene_label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labels.scene_label_index(view(spark, sf_dir, "V_SCENE"))
    return found.groupBy("model_id").agg(F.count("*").alias("meshes"), F.count("label").alias("labeled"))


_EDITS = """edits as (select m.model_id, m.mesh_id, c.turn as position, case when (m.mesh_id + c.turn) % 5 = 0 then '\u00a0\t\n' else concat('\t ', c.text, '\u3000 ') end as text
    from V_MESH m join conversations c on m.mesh_id = c.conv_id)"""


@query(
    "label_edit",
    f"""with {_EDITS}, bare as (select *, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') as told from edits),
        last as (select model_id, mesh_id, left(told, 2000) as label, row_number() over (partition by model_id, mesh_id order by position desc) as place from bare where told <> '')
        select model_id, mesh_id, mesh_name as label from V_MESH m where not exists (select 1 from last l where l.model_id = m.model_id and l.mesh_id = m.mesh_id)
        union all select model_id, mesh_id, label from last where place = 1""",
)
def label_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = run_sql(spark, sf_dir, f"with {_EDITS} select * from edits")
    return labels.label_edit(view(spark, sf_dir, "V_MESH").select("model_id", "mesh_id", F.col("mesh_name").alias("label")), edits, "model_id", "mesh_id")


@query(
    "label_to_mesh",
    """select model_id, mesh_id, arg_max(label, result_order) as label from (
            select r.model_id, m.mesh_id, r.label, r.result_order from V_MESH_RESULT r join V_MESH m on m.model_id = r.model_id and m.mesh_name = r.target where r.label <> ''
            union all select r.model_id, m.mesh_id, r.label, r.result_order from V_MESH_RESULT r join V_MESH m on m.model_id = r.model_id and cast(m.mesh_id as varchar(12)) = r.target where r.label <> '')
        group by model_id, mesh_id""",
)
def label_to_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    meshes = view(spark, sf_dir, "V_MESH").withColumn("mesh_order", F.col("mesh_id"))
    return labels.label_to_mesh(meshes, view(spark, sf_dir, "V_MESH_RESULT"))


@query(
    "label_to_node",
    f"""with {_KNOWN}
        select n.model_id, node_idx, node_name, coalesce(e.label, l.label) as label, case when e.label is not null then 'exact' when l.label is not null then 'normalized' end as match_type
        from V_NODE n left join known e on n.model_id = e.model_id and n.node_name = e.key left join known l on n.model_id = l.model_id and {_norm('n.node_name')} = l.key""",
)
def label_to_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_to_node(view(spark, sf_dir, "V_NODE"), _node_labels(spark, sf_dir)).select("model_id", "node_idx", "node_name", "label", "match_type")


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container for each model: its nodes, some with extras and an older label, its meshes by the same names, and bytes behind them."""
    extras = F.when(F.col("node_idx") % 5 == 0, F.struct(F.lit("old").alias("semanticLabel"), F.array(F.lit(1.5), F.col("node_idx").cast("double")).alias("size"))).when(F.col("node_idx") % 5 == 1, F.struct(F.lit(None).cast("string").alias("semanticLabel"), F.array(F.lit(2.0)).alias("size")))
    item = F.struct("node_idx", F.struct(F.col("node_name").alias("name"), F.col("node_idx").alias("mesh"), extras.alias("extras")).alias("item"))
    found = view(spark, sf_dir, "V_NODE").groupBy("model_id").agg(F.sort_array(F.collect_list(item)).alias("x"))
    json = F.to_json(F.struct(F.struct(F.lit("2.0").alias("version")).alias("asset"), F.col("x.item").alias("nodes"), F.transform("x", lambda x: F.struct(x["item"]["name"].alias("name"))).alias("meshes")))
    path = shared_folder(spark, "models")
    found.select("model_id", containers.build_glb(json, F.encode(F.col("model_id"), "UTF-8")).alias("content")).write.parquet(path)
    return spark.read.parquet(path)


@query(
    "glb_relabel",
    f"""with {_KNOWN}, placed as (select *, cast(row_number() over (partition by model_id order by node_idx) - 1 as int) as position from V_NODE),
        found as (select n.*, coalesce(e.label, l.label) as label from placed n left join known e on n.model_id = e.model_id and n.node_name = e.key left join known l on n.model_id = l.model_id and {_norm('n.node_name')} = l.key)
        select model_id as file_id, 'node' as kind, position, node_name as name, coalesce(label, case when node_idx % 5 = 0 then 'old' end) as label from found where label is not null or node_idx % 5 = 0
        union all select model_id, 'mesh', position, node_name, label from found where label is not null""",
)
def glb_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written into the containers of all models and read from what was written."""
    files = containers.glb_relabel(_models(spark, sf_dir).withColumnRenamed("model_id", "file_id"), _node_labels(spark, sf_dir))
    path = shared_folder(spark, "relabeled")
    files.write.parquet(path)
    return containers.glb_labels(spark.read.parquet(path))


@query("norm_name", f"select node_idx, {_norm('node_name')} as norm_name from V_NODE")
def norm_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "V_NODE").select("node_idx", t.norm_name(F.col("node_name")).alias("norm_name"))


@query("collapse_ws", f"select file_id, line_no, {_collapsed('line')} as line from V_OBJ_LINE")
def collapse_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "V_OBJ_LINE").select("file_id", "line_no", t.collapse_ws(F.col("line")).alias("line"))


@query(
    "obj_labels",
    """select file_id, material, arg_max(label, line_no) as label from (select file_id, line_no, regexp_extract(line, '^\\s*usemtl\\s+([^\\s#]+)', 1, 'i') as material,
        """
    + _collapsed("regexp_extract(line, '^\\s*usemtl\\s+[^\\s#]+[^#]*#\\s*label:\\s*(.+)$', 1, 'i')")
    + " as label from V_OBJ_LINE) where material <> '' and label <> '' group by file_id, material",
)
def obj_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.obj_labels(view(spark, sf_dir, "V_OBJ_LINE"))


@query(
    "obj_relabel",
    """with told as (select model_id as file_id, replace(label_key, ' ', '_') as material, label from V_NODE_LABEL)
        select l.file_id, line_no, case when t.label is not null then concat('usemtl ', t.material, ' # label: ', t.label) else line end as line, t.label is not null as replaced
        from V_OBJ_LINE l left join told t on l.file_id = t.file_id and regexp_extract(line, '^usemtl ([^\\s#]+)', 1) = t.material""",
)
def obj_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every material has an older label, too, which sorts after the one that counts."""
    told = view(spark, sf_dir, "V_NODE_LABEL").select(F.col("model_id").alias("file_id"), F.concat(F.translate("label_key", " ", "_"), F.lit(" # old")).alias("material"), "label", F.lit(2).alias("result_order"))
    older = told.withColumns({"label": F.concat(F.lit("zzz "), "label"), "result_order": F.lit(1)})
    return labels.obj_relabel(view(spark, sf_dir, "V_OBJ_LINE"), told.unionByName(older))


@query("label_from_material", "select p_partkey, case when p_partkey % 3 <> 2 then p_type end as label from part")
def label_from_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "select p_partkey, case p_partkey % 3 when 0 then concat(p_name, '  # LABEL:  ', p_type) when 1 then concat(p_name, '[Label:', p_type, ']') else p_name end as name from part")
    return rows.select("p_partkey", t.label_from_material(F.col("name")).alias("label"))


@query(
    "render_plan",
    """select model_id, mesh_id, cast(view_order as int) as view_order, view, px, py, pz, tx, ty, tz from V_MESH cross join (values (1, 'main', 0.0::double, 2.0::double, 6.0::double, 0.0::double, 0.0::double, 0.0::double),
        (2, 'top', 0, 10, 0.5, 0, 0, 0), (3, 'side', 8, 1, 0, 0, 0, 0), (4, 'axial', 6, 6, 6, 0, 0, 0)) as v(view_order, view, px, py, pz, tx, ty, tz)""",
)
def render_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.render_plan(view(spark, sf_dir, "V_MESH").select("model_id", "mesh_id"))


_DRAW = "cast(concat('0x', substr(md5(concat('42|', cast(file_id as varchar), '|', cast(turn as varchar))), 1, 8)) as bigint) / 4294967296.0::double"
_RANGES = "ranges as (select prompt_id, pos, (sum(w) over (order by pos) - w) / sum(w) over () as low, sum(w) over (order by pos) / sum(w) over () as high from (select *, {} as w from V_PROMPT))"


@query("assign_prompt", f"with {_RANGES.format('coalesce(nullif(weight, 0), 1)')}, drawn as (select file_id, turn, {_DRAW} as u from V_RESULT) select file_id, turn, prompt_id from drawn left join ranges on low <= u and u < high")
def assign_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labels.assign_prompt(_results(spark, sf_dir), view(spark, sf_dir, "V_PROMPT"), labels.uniform(42, F.col("file_id"), F.col("turn")))
    return found.select("file_id", "turn", "prompt_id")


@query("prompt_assign_join", f"with {_RANGES.format('1')}, drawn as (select file_id, turn, {_DRAW} as u from V_RESULT) select prompt_id, count(*) as drawn from drawn left join ranges on low <= u and u < high group by prompt_id")
def prompt_assign_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labels.assign_prompt(_results(spark, sf_dir), view(spark, sf_dir, "V_PROMPT"), labels.uniform(42, F.col("file_id"), F.col("turn")), "random")
    return found.groupBy("prompt_id").agg(F.count("*").alias("drawn"))


@query(
    "parse_response",
    """select file_id, turn, case when turn % 4 = 3 or (file_id + turn) % 9 = 0 then '' else trim(text) end as text,
        cast(case when turn % 4 = 3 then 0 else turn end as bigint) as prompt_tokens, cast(case when turn % 4 = 3 then 0 else length(text) end as bigint) as completion_tokens, cast(0 as bigint) as total_tokens,
        case when turn % 4 = 3 then 'no JSON' when (file_id + turn) % 9 = 0 then 'no choices' end as error from V_RESULT""",
)
def parse_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, turn = _results(spark, sf_dir), F.col("turn")
    usage = F.struct(turn.alias("prompt_tokens"), F.length("text").alias("completion_tokens"))
    plain = F.array(F.struct(F.struct(F.concat(F.lit("  "), F.col("text")).alias("content")).alias("message")))
    half = F.floor(F.length("text") / 2).cast("int")
    part = lambda kind, s: F.struct(F.lit(kind).alias("type"), s.alias("text"))
    parts = F.array(part("text", F.substring(F.col("text"), F.lit(1), half)), part("image", F.lit("?")), part("text", F.substring(F.col("text"), half + 1, F.length("text"))))
    split = F.array(F.struct(F.struct(parts.alias("content")).alias("message")))
    body = (
        F.when(turn % 4 == 3, F.concat(F.lit("<html>"), F.col("text")))
        .when((F.col("file_id") + turn) % 9 == 0, F.to_json(F.struct(F.array().cast("array<string>").alias("choices"), usage.alias("usage"))))
        .when(F.col("file_id") % 2 == 0, F.to_json(F.struct(split.alias("choices"), usage.alias("usage"))))
        .otherwise(F.to_json(F.struct(plain.alias("choices"), usage.alias("usage"))))
    )
    return rows.select("file_id", "turn", t.parse_response(body).alias("r")).select("file_id", "turn", "r.*")


@query(
    "build_request",
    """select file_id, turn, concat('{"model":"vlm","messages":[{"role":"user","content":[{"type":"text","text":"p', cast(turn as varchar), '"}',
        string_agg(concat(',{"type":"image_url","image_url":{"url":"', material_name, '/', view, '"}}'), '' order by view_order), ']}],"temperature":0.3,"max_tokens":4096}') as body
        from V_RESULT cross join (values (1, 'main'), (2, 'top'), (3, 'side'), (4, 'axial')) as v(view_order, view) group by file_id, turn, material_name""",
)
def build_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = labels.render_plan(_results(spark, sf_dir).select("file_id", "turn", "material_name"))
    captures = plan.select("file_id", "turn", "view_order", F.concat(F.lit("p"), F.col("turn").cast("string")).alias("prompt"), F.concat_ws("/", "material_name", "view").alias("image_url"))
    return labels.build_request(captures, "vlm", "file_id", "turn")


@query(
    "describe_error",
    """select request_id, attempt, concat(case when attempt % 2 = 0 then concat('[', cast(attempt as varchar), '] ') else '' end, coalesce(error, 'unknown error')) as message from V_ATTEMPT""",
)
def describe_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = view(spark, sf_dir, "V_ATTEMPT"), F.col("attempt")
    first, second = F.when(n % 3 == 0, F.col("error")).otherwise(" "), F.when(n % 3 != 0, F.col("error"))
    return rows.select("request_id", "attempt", t.describe_error(F.when(n % 2 == 0, n), first, second).alias("message"))
