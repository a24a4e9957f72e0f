"""Labels: prompts and requests, results and their cleaning, and the way to meshes, nodes and materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions.text import collapse_ws, has_keyword, norm_name, trimmed

# The views in their order, with the camera's position and target.
VIEWS = (
    ("main", (0.0, 2.0, 6.0), (0.0, 0.0, 0.0)),
    ("top", (0.0, 10.0, 0.5), (0.0, 0.0, 0.0)),
    ("side", (8.0, 1.0, 0.0), (0.0, 0.0, 0.0)),
    ("axial", (6.0, 6.0, 6.0), (0.0, 0.0, 0.0)),
)
# A request's parameters, and the length that an edited label may have.
TEMPERATURE, MAX_TOKENS, MAX_LABEL = 0.3, 4096, 2000
#: A material's line in an OBJ file: indent with the keyword, name, and what follows.
USEMTL = r"(?i)^(\s*usemtl\s+)([^\s#]+)(.*)$"
OBJ_LABEL = r"(?i)^\s*usemtl\s+[^\s#]+[^#]*#\s*label:\s*(.+)$"


def filled(text: Column) -> Column:
    """The text, or null if it is empty; blanks are a text."""
    return F.when(text != "", text)


def valid_labels(results: DataFrame, keywords: list[str], literal: bool = False) -> DataFrame:
    """Results without an error, with a text, and without a keyword to ignore."""
    error = F.coalesce(F.col("error"), F.lit("")) == ""
    return results.where(error & (F.coalesce(F.col("text"), F.lit("")) != "") & ~has_keyword(F.col("text"), keywords, literal))


def label_precedence(user_label: Column, semantic_label: Column, material_label: Column) -> Column:
    """A mesh's label: the user's, else the semantic one, else its material's; empty ones don't count."""
    return F.coalesce(filled(user_label), filled(semantic_label), filled(material_label))


def scene_label_index(meshes: DataFrame) -> DataFrame:
    """``meshes`` with ``label`` by precedence."""
    return meshes.withColumn("label", label_precedence(F.col("user_label"), F.col("semantic_label"), F.col("material_label")))


def label_edit(labels: DataFrame, edits: DataFrame, *keys: str) -> DataFrame:
    """Labels with those of edits that aren't blank laid over them, trimmed and cut to the allowed length.

    Of several edits of a mesh the last counts, by ``position``.
    """
    text = trimmed(F.col("text"))
    good = edits.where(text != "").select(*keys, F.left(text, F.lit(MAX_LABEL)).alias("label"), "position")
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("position")))
    good = good.withColumn("_place", last).where("_place = 1").select(*keys, "label")
    return labels.join(good.select(*keys), list(keys), "left_anti").select(*keys, "label").unionByName(good)


def label_to_mesh(meshes: DataFrame, results: DataFrame) -> DataFrame:
    """Per mesh the label of its last result.

    A result names a mesh by its name or its id; of several meshes the first in
    ``mesh_order`` takes it. Empty labels are skipped. Both lookups are equalities.
    """
    told = results.where(F.coalesce("label", F.lit("")) != "").select("model_id", "target", "label", "result_order")
    m = meshes.select("model_id", "mesh_id", "mesh_name", "mesh_order")
    keys = m.select("*", F.col("mesh_name").alias("target")).unionByName(m.select("*", F.col("mesh_id").cast("string").alias("target")))
    first = keys.where("target is not null").groupBy("model_id", "target").agg(F.min_by("mesh_id", "mesh_order").alias("mesh_id"))
    hits = told.join(first, ["model_id", "target"])
    return hits.groupBy("model_id", "mesh_id").agg(F.max_by("label", "result_order").alias("label"))


def label_to_node(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` with ``label`` and ``match_type``: exact by name, else normalized, else none (null).

    ``labels`` holds ``(model_id, label_key, label, label_order)``. A label is known by its key
    and by the normalized key; of several labels for one of these the last in order counts (of
    one order, the greatest). Empty labels and keys are no labels.
    """
    told = labels.where("label <> '' and label_key <> ''").select("model_id", "label", F.col("label_order").alias("_order"), F.explode(F.array("label_key", norm_name(F.col("label_key")))).alias("_key"))
    known = told.where("_key <> ''").groupBy("model_id", "_key").agg(F.max(F.struct("_order", "label"))["label"].alias("_label"))
    exact = known.select("model_id", F.col("_key").alias("node_name"), F.col("_label").alias("_exact"))
    loose = known.select("model_id", F.col("_key").alias("_norm"), F.col("_label").alias("_loose"))
    joined = nodes.withColumn("_norm", norm_name(F.col("node_name"))).join(exact, ["model_id", "node_name"], "left").join(loose, ["model_id", "_norm"], "left")
    kind = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_loose").isNotNull(), "normalized")
    return joined.withColumn("label", F.coalesce("_exact", "_loose")).withColumn("match_type", kind).drop("_exact", "_loose", "_norm")


def obj_labels(lines: DataFrame) -> DataFrame:
    """Per file and material the label of its last ``usemtl`` line that has one in a comment."""
    material = F.regexp_extract("line", USEMTL, 2)
    label = collapse_ws(F.regexp_extract("line", OBJ_LABEL, 1))
    found = lines.select("file_id", "line_no", material.alias("material"), label.alias("label")).where("material <> '' and label <> ''")
    return found.groupBy("file_id", "material").agg(F.max_by("label", "line_no").alias("label"))


def obj_relabel(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """``lines`` with the label of each material's ``usemtl`` line written into its comment, and ``replaced``.

    ``labels`` holds ``(file_id, material, label, result_order)``; of several labels for
    a material the last in ``result_order`` counts (of one order, the greatest label).
    What follows a ``#`` in the material is not part of its name. Indents stay, line
    breaks in labels become blanks.
    """
    base = F.trim(F.element_at(F.split("material", "#"), 1))
    told = labels.select("file_id", F.lower(base).alias("_material"), base.alias("_name"), collapse_ws(F.col("label")).alias("_label"), F.col("result_order").alias("_order")).where("_label <> '' and _material <> ''")
    told = told.groupBy("file_id", "_material").agg(F.max(F.struct("_order", "_label", "_name")).alias("_told"))
    keyed = lines.withColumn("_material", F.lower(F.nullif(F.regexp_extract("line", USEMTL, 2), F.lit(""))))
    joined = keyed.join(told, ["file_id", "_material"], "left")
    hit = F.col("_told").isNotNull()
    line = F.when(hit, F.concat(F.regexp_extract("line", USEMTL, 1), F.col("_told._name"), F.lit(" # label: "), F.col("_told._label"))).otherwise(F.col("line"))
    return joined.select("file_id", "line_no", line.alias("line"), hit.alias("replaced"))


def render_plan(meshes: DataFrame, views: tuple[str, ...] = tuple(v[0] for v in VIEWS)) -> DataFrame:
    """One capture per mesh and chosen view, in the fixed order of views."""
    chosen = [(i + 1, n, *p, *t) for i, (n, p, t) in enumerate(VIEWS) if n in views]
    table = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("view_order", "view", "px", "py", "pz", "tx", "ty", "tz"), row, strict=True))) for row in chosen))
    return meshes.select("*", F.inline(table))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone."""
    text = F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(2**32)


def prompt_ranges(prompts: DataFrame, rule: str = "weighted") -> DataFrame:
    """``prompts`` with the part [low, high) of the unit interval that draws each; a weight of 0 or null counts as 1."""
    weight = F.lit(1) if rule == "random" else F.coalesce(F.nullif("weight", F.lit(0)), F.lit(1))
    upto = F.sum("_w").over(Window.orderBy("pos"))  # a library has few prompts
    summed = prompts.withColumn("_w", weight).withColumn("_upto", upto)
    total = F.sum("_w").over(Window.partitionBy())
    return summed.withColumn("_all", total).select(*prompts.columns, ((F.col("_upto") - F.col("_w")) / F.col("_all")).alias("low"), (F.col("_upto") / F.col("_all")).alias("high"))


def assign_prompt(meshes: DataFrame, prompts: DataFrame, draw: Column, rule: str = "weighted") -> DataFrame:
    """``meshes`` with the ``prompt_id`` whose part of the unit interval ``draw`` falls in.

    A library is small enough for Spark to broadcast it by itself.
    """
    ranges = prompt_ranges(prompts, rule).select("prompt_id", "low", "high")
    drawn = meshes.withColumn("_draw", draw)
    return drawn.join(ranges, (F.col("low") <= F.col("_draw")) & (F.col("_draw") < F.col("high")), "left").drop("_draw", "low", "high")


def build_request(captures: DataFrame, model: str, *keys: str) -> DataFrame:
    """Per mesh the JSON body of its request: the prompt's text, then one part for each image in ``view_order``.

    A mesh has as many captures as there are views.
    """
    parts = captures.groupBy(*keys).agg(F.max("prompt").alias("prompt"), F.array_sort(F.collect_list(F.struct("view_order", "image_url"))).alias("images"))
    kind = "struct<type:string,text:string,image_url:struct<url:string>>"
    none = F.lit(None)
    text = F.struct(F.lit("text").alias("type"), F.col("prompt").alias("text"), none.alias("image_url")).cast(kind)
    images = F.transform("images", lambda i: F.struct(F.lit("image_url").alias("type"), none.alias("text"), F.struct(i["image_url"].alias("url")).alias("image_url")).cast(kind))
    message = F.struct(F.lit("user").alias("role"), F.concat(F.array(text), images).alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message).alias("messages"), F.lit(TEMPERATURE).alias("temperature"), F.lit(MAX_TOKENS).alias("max_tokens"))
    return parts.select(*keys, F.to_json(body).alias("body"))


def attempt_outcome(attempts: DataFrame, max_retries: int = 3, key: str = "request_id") -> DataFrame:
    """Per request the text of its first successful attempt, or its last error with an empty text."""
    tried = attempts.where(F.col("attempt") <= max_retries)
    found = tried.groupBy(key).agg(
        F.count_if("ok").alias("successes"),
        F.min_by("text", F.when(F.col("ok"), F.col("attempt"))).alias("text"),
        F.max_by("error", F.when(~F.col("ok"), F.col("attempt"))).alias("error"),
    )
    good = F.col("successes") > 0
    return found.select(key, good.alias("ok"), F.when(good, F.coalesce("text", F.lit(""))).otherwise("").alias("text"), F.when(~good, F.col("error")).alias("error"))


def good_result() -> Column:
    return (F.coalesce("error", F.lit("")) == "") & (F.coalesce("text", F.lit("")) != "")


def file_label_outcome(results: DataFrame, failed_files: DataFrame | None = None) -> DataFrame:
    """Per file its successes and failures, and done, or skipped without successes; error for files whose processing failed.

    A file that failed before it had any result has neither successes nor failures.
    """
    found = results.groupBy("file_id").agg(F.count_if(good_result()).alias("successes"), F.count_if(~good_result()).alias("failures"))
    outcome = F.when(F.col("successes") == 0, "skipped").otherwise("done")
    if failed_files is None:
        return found.withColumn("outcome", outcome)
    bad = failed_files.select(F.col("file_id").alias("_file")).distinct().withColumn("_bad", F.lit(True))
    joined = found.join(bad, F.col("file_id").eqNullSafe(F.col("_file")), "full")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("successes", "failures")]
    return joined.select(F.when(F.col("_bad"), F.col("_file")).otherwise(F.col("file_id")).alias("file_id"), *counts, F.when(F.col("_bad"), "error").otherwise(outcome).alias("outcome"))


def batch_state(results: DataFrame) -> DataFrame:
    """One row: success, warning (some failed) or error (all failed, or nothing to do)."""
    found = results.agg(F.count("*").alias("total"), F.count_if(good_result()).alias("successes"))
    state = F.when(F.col("successes") == 0, "error").when(F.col("successes") < F.col("total"), "warning").otherwise("success")
    return found.withColumn("state", state)
