"""Small cases with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from meshloom.functions import text as t
from meshloom.operators import catalog, chunks, geometry, labels, metrics, runs
from meshloom.plans import metric_queries
from meshloom.plans.views import view
from meshloom.sources import containers, storage, tiers

VERTEX = "model_id int, mesh_id int, vi int, x double, y double, z double"


def vertices(spark, *triangles, model=1, mesh=1):
    rows = [(model, mesh, i, *map(float, p)) for i, p in enumerate(p for tri in triangles for p in tri)]
    return spark.createDataFrame(rows, VERTEX)


def test_filter_truth_table(spark):
    rows = spark.createDataFrame([("A", 3, 5.0, 3.0, 0.5), ("B", 6, 4.0, 2.5, 0.3), ("C", 4, 8.0, 4.0, 0.7), ("D", None, 8.0, 4.0, 0.9)], "id string, material_count long, vvd double, vfc double, vsc double")
    found = metrics.metric_filter(rows, {"material_count": (2, 5), "vvd": (3, 10), "vfc": (2, 5), "vsc": (0.2, 0.8)})
    got = {r["id"]: (r["passed"], r["failures"]) for r in found.collect()}
    assert got == {"A": (True, []), "B": (False, ["material_count out of range"]), "C": (True, []), "D": (False, ["material_count missing", "vsc out of range"])}


def test_ratios(spark):
    rows = spark.createDataFrame([(1, 8192, 4096, 2048, 512), (2, 10, 5, 0, 0)], "model_id int, vertex_count long, face_count long, occupied_voxels long, surface_voxels long")
    a, b = geometry.metric_ratios(rows).orderBy("model_id").collect()
    assert (a["vvd"], a["vfc"], a["vsc"], a["error"]) == (4.0, 2.0, 0.25, None)
    assert (b["vvd"], b["vfc"], b["vsc"], b["error"]) == (None, None, None, "voxelization_failed")


def test_status_of_second_run_and_of_another_resolution(spark):
    rows = spark.createDataFrame([(1, True, 64, 2, 1.0), (2, False, None, None, None), (3, True, 64, None, 1.0), (4, True, 64, 2, None)], "model_id int, has_metrics boolean, voxel_resolution int, material_count long, vvd double")
    reasons = lambda r: [x["reason"] for x in metrics.metrics_status(rows, ("vvd",), r).orderBy("model_id").collect()]
    assert reasons(64) == ["complete", "no_existing_metrics", "missing_material_count", "missing_metrics"]
    assert reasons(32) == ["resolution_mismatch", "no_existing_metrics", "resolution_mismatch", "resolution_mismatch"]


def test_new_resolution_starts_from_nothing(spark):
    kind = "model_id int, voxel_resolution int, material_count long, vvd double, vsc double"
    old = spark.createDataFrame([(1, 64, 2, 1.0, 0.5), (2, 64, 2, 1.0, 0.5), (3, 64, 2, 1.0, 0.5)], kind)
    new = spark.createDataFrame([(1, 64, 3, None, 0.7), (2, 32, 3, 2.0, None)], kind)
    found = metrics.merge_metrics(old, new, ("voxel_resolution", "material_count", "vvd", "vsc")).orderBy("model_id").collect()
    assert [tuple(r)[1:5] for r in found] == [(64, 3, 1.0, 0.7), (32, 3, 2.0, None), (64, 2, 1.0, 0.5)]
    assert [r["last_updated"] is not None for r in found] == [True, True, False]


def test_triangle_on_the_upper_face_marks_nothing(spark):
    flat = vertices(spark, [(0, 0, 0), (0, 0, 0), (0, 0, 0)], [(1, 0, 0), (1, 1, 0), (1, 0, 1)])
    cells = geometry.voxelize(geometry.triangles(flat), geometry.model_bbox(flat), 4)
    assert {tuple(r)[1:] for r in cells.collect()} == {(0, 0, 0)}


def test_model_of_no_size(spark):
    dot = vertices(spark, [(2, 2, 2)] * 3)
    mesh = spark.createDataFrame([(1, 1, None, ["a", " ", "a"])], "model_id int, mesh_id int, matrix array<double>, material_ids array<string>")
    r = geometry.complexity_metrics(dot, mesh, resolution=8).first()
    assert (r["occupied_voxels"], r["vvd"], r["error"], r["material_count"]) == (0, None, "voxelization_failed", 1)
    assert geometry.fit_transform(geometry.model_bbox(dot)).first()["scale"] == 1.0


def test_cube_shell_and_neighbours_agree(spark):
    full = vertices(spark, [(0, 0, 0), (1, 1, 1), (0.5, 0.2, 0.9)], [(0.1, 0.1, 0.1), (0.3, 0.9, 0.2), (0.2, 0.4, 0.8)])
    cells = geometry.voxelize(geometry.triangles(full), geometry.model_bbox(full), 6)
    one = {tuple(r) for r in geometry.surface_voxels(cells, 6).collect()}
    two = {tuple(r) for r in geometry.surface_by_neighbors(cells, 6).drop("neighbors").collect()}
    assert one == two
    assert len(one) == 216
    assert sum(not r[-1] for r in one) == 4**3


def test_counts_do_not_change_when_a_model_moves(spark):
    tri = [[(0, 0, 0), (4, 0, 0), (0, 4, 1)], [(1, 1, 1), (2, 3, 2), (3, 1, 4)]]
    moved = [[tuple(c + 64 for c in p) for p in t] for t in reversed(tri)]
    count = lambda v: tuple(geometry.voxel_counts(geometry.surface_voxels(geometry.voxelize(geometry.triangles(v), geometry.model_bbox(v), 8), 8)).first())
    a, b = count(vertices(spark, *tri)), count(vertices(spark, *moved))
    assert a == b
    assert a[2] <= a[1] <= 512


def test_matrix_and_indices(spark):
    v = vertices(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(5, 5, 5), (6, 6, 6), (7, 7, 7)])
    index = spark.createDataFrame([(1, 1, k, i) for k, i in enumerate((0, 1, 2, 2, 1, 0, 3))], "model_id int, mesh_id int, k int, vi int")
    turn = [float(x) for x in (0, 1, 0, 0, -1, 0, 0, 0, 0, 0, 1, 0, 10, 20, 30, 1)]
    mesh = spark.createDataFrame([(1, 1, turn, ["a"])], "model_id int, mesh_id int, matrix array<double>, material_ids array<string>")
    found = geometry.triangles(v, mesh, index).orderBy("tri").collect()
    assert len(found) == 2
    assert [found[0][c] for c in ("x1", "y1", "z1", "x2", "y2", "z2")] == [10, 21, 30, 9, 20, 30]
    stats = geometry.geometry_stats(v, index).first()
    assert (stats["vertex_count"], stats["face_count"], stats["mesh_count"]) == (6, 2, 1)
    box = geometry.model_bbox(v, mesh).first()
    assert (box["min_x"], box["max_x"], box["min_y"], box["max_y"]) == (3, 10, 20, 27)


def test_quantiles_by_rank(spark):
    rows = spark.createDataFrame([(float(i),) for i in (3, 1, 4, 2)] + [(None,)], "v double")
    r = metrics.nearest_rank(rows, {"median": 0.5, "q25": 0.25, "q75": 0.75}, ("v",)).first()
    assert (r["count"], r["median"], r["q25"], r["q75"]) == (4, 3, 2, 4)


def test_quantiles_of_skewed_values(spark):
    values = sorted([1.0] * 50 + [1.0 + i / 1e6 for i in range(40)] + [1e9])
    r = metrics.nearest_rank(spark.createDataFrame([(v,) for v in values], "v double"), {"a": 0.1, "b": 0.7, "c": 0.999}, ("v",)).first()
    assert (r["a"], r["b"], r["c"]) == (values[9], values[63], values[90])


def test_histogram_of_no_width(spark):
    found = metrics.metric_histogram(spark.createDataFrame([(5.0,)] * 3, "v double"), ("v",)).collect()
    assert len(found) == 50
    assert {(r["n"], r["density"], r["center"]) for r in found} == {(0, 0.0, 5.0)}


def test_density_sums_to_one(spark):
    found = metrics.metric_histogram(spark.createDataFrame([(float(i % 7),) for i in range(100)], "v double"), ("v",))
    assert found.agg(F.sum("density")).first()[0] == pytest.approx(1)


def test_truncated_container(spark):
    made = spark.range(1).select(F.lit(1).alias("file_id"), containers.build_glb(F.lit('{"nodes":[{"name":"n","extras":{"semanticLabel":"chair é"}},{"name":"m"}],"meshes":[]}')).alias("content")).collect()[0]
    rows = [(1, made["content"]), (2, made["content"][:40]), (3, b""), (4, None)]
    files = spark.createDataFrame(rows, "file_id int, content binary")
    got = {r["file_id"]: r["error"] for r in containers.glb_validate(files).collect()}
    assert got == {1: None, 2: "length mismatch", 3: "too short", 4: "too short"}
    assert [tuple(r) for r in containers.glb_labels(files).collect()] == [(1, "node", 0, "n", "chair é")]


def test_chunks_round_trip(spark):
    texts = {1: "abcdefghij" * 3, 2: "x", 3: "äöü" * 7}
    plan = chunks.chunk_plan(spark.createDataFrame([(k, len(v)) for k, v in texts.items()] + [(4, 0)], "file_id int, size long"), 8).collect()
    rows = [(r["file_id"], r["chunk_index"], r["total_chunks"], texts[r["file_id"]][r["start_byte"] : r["end_byte"]]) for r in plan]
    table = spark.createDataFrame([*rows, rows[0]], "file_id int, chunk_index int, total_chunks int, data string")
    got = {r["file_id"]: (r["content"], r["error"]) for r in chunks.assemble_chunks(table).collect()}
    assert got == {k: (v, None) for k, v in texts.items()}
    broken = chunks.assemble_chunks(table.where("not (file_id = 1 and chunk_index = 1)")).where("file_id = 1").first()
    assert (broken["content"], broken["error"]) == (None, "missing chunk 1")


def test_scan_tier_lists_nothing_in_the_driver(spark, tmp_path):
    """Files over several roots, each with its sidecar; no plan holds the names of files, as those of Spark's readers do."""
    roots = [str(tmp_path / str(i)) for i in range(3)]
    assets = [(f"ü {i}%20+.glb", b"x" * i, json.dumps({"hasLabels": True, "sourceType": f"s{i}"}) if i % 2 else "[{}]" if i % 4 else None) for i in range(40)]
    assert storage.write_assets(spark.createDataFrame(assets, "id string, content binary, sidecar string"), roots, "raw") == 40
    counts = [len(list((tmp_path / str(i) / "raw").iterdir())) for i in range(3)]
    assert min(counts) > 0 and sum(counts) == 40 + 20 + 10
    found = storage.scan_tier(spark, roots, "raw")
    assert sorted((r["id"], r["size"], r["has_sidecar"], r["sourceType"]) for r in found.collect()) == sorted((n, len(c), s is not None, f"s{i}" if i % 2 else None) for i, (n, c, s) in enumerate(assets))
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()


def test_scan_tier_and_prompts(spark, tmp_path):
    tier = tmp_path / "labeled"
    (tier / "sub.glb").mkdir(parents=True)
    (tier / "a b.glb").write_bytes(b"12345")
    (tier / "a b.glb.json").write_text(json.dumps({"hasLabels": True, "labels": [{"text": "chair", "other": 1}], "filterMetrics": {"VVD": 2.5}, "sourceType": "raw"}))
    (tier / "c.obj").write_bytes(b"123")
    (tier / "c.obj.json").write_text("{broken")
    (tier / "d.stl").write_bytes(b"1")
    (tier / "empty.fbx").write_bytes(b"")
    (tier / "empty.fbx.json").write_text("")
    got = {r["id"]: r for r in storage.scan_tier(spark, str(tmp_path), "labeled").collect()}
    assert set(got) == {"a b.glb", "c.obj", "d.stl", "empty.fbx"}
    assert (got["empty.fbx"]["size"], got["empty.fbx"]["has_sidecar"], got["empty.fbx"]["hasLabels"], got["d.stl"]["has_sidecar"]) == (0, True, False, False)
    assert storage.scan_tier(spark, str(tmp_path), "labeled").where("updatedAt is null").count() == 0
    assert storage.list_files(spark, [str(tmp_path / "none")]).count() == 0
    a, c = got["a b.glb"], got["c.obj"]
    assert (a["size"], a["status"], a["labels"][0]["text"], a["filterMetrics"]["VVD"], a["sourceType"]) == (5, "labeled", "chair", 2.5, "raw")
    assert (c["size"], c["status"], c["labels"], c["hasLabels"], c["filterMetrics"]) == (3, "raw", [], False, None)

    defaults = spark.createDataFrame([(1, "d", "describe", 1)], "pos int, prompt_id string, content string, weight int")
    (tmp_path / "own.json").write_text(json.dumps({"selectionRule": "random", "ignoreKeywords": ["a"], "prompts": [{"id": "p", "content": "x", "weight": 3}]}))
    (tmp_path / "none.json").write_text(json.dumps({"prompts": [], "ignoreKeywords": []}))
    prompts, words, rule = storage.load_prompts(spark, str(tmp_path / "own.json"), defaults)
    assert ([r["prompt_id"] for r in prompts.collect()], [r[0] for r in words.collect()], rule.first()[0]) == (["p"], ["a"], "random")
    prompts, words, rule = storage.load_prompts(spark, str(tmp_path / "none.json"), defaults)
    assert ([r["prompt_id"] for r in prompts.collect()], [r[0] for r in words.collect()], rule.first()[0]) == (["d"], ["Unknown Object"], "weighted")


def test_keywords_of_a_table(spark):
    rows = spark.createDataFrame([("An  unknown  object",), ("a.b",), ("axb",), (None,)], "s string")
    table = lambda words: spark.createDataFrame([(w,) for w in words], "keyword string")
    hit = lambda words, literal=False: [r[0] for r in rows.select(t.has_keyword_of(F.col("s"), table(words), literal)).collect()]
    assert hit(["Unknown Object", " ", None]) == [True, False, False, False]
    assert hit(["a.b"]) == [False, True, True, False]
    assert hit(["a.b", "a.b", "("], literal=True) == [False, True, False, False]
    assert hit([]) == hit(["", None]) == [False] * 4


def test_a_tier_may_become_empty(spark, tmp_path):
    root, rows = str(tmp_path / "tiers"), [("raw", "a", 1), ("raw", "b", 2), ("labeled", "a", 3), ("filtered", "c", 4)]
    tiers.write_tiers(spark.createDataFrame(rows, "tier string, id string, size long"), root)
    before = {f.name for f in (tmp_path / "tiers" / "tier=filtered").iterdir()}
    missed = tiers.delete(spark, root, spark.createDataFrame([("a",), ("x",)], "id string"))
    assert [r["id"] for r in missed.collect()] == ["x"]
    assert {tuple(r) for r in tiers.read_tiers(spark, root).select("tier", "id", "size").collect()} == {("raw", "b", 2), ("filtered", "c", 4)}
    assert {f.name for f in (tmp_path / "tiers" / "tier=filtered").iterdir()} == before
    failed = tiers.promote(spark, root, spark.createDataFrame([("b", None), ("n", 9), ("q", None)], "id string, payload_size long"), F.lit("2024-01-01").cast("timestamp"))
    assert [r["id"] for r in failed.collect()] == ["q"]
    assert {tuple(r) for r in tiers.read_tiers(spark, root).where("has_labels").select("id", "size").collect()} == {("b", 2), ("n", 9)}


def test_pages_read_their_files_only(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id")).repartition(5)
    path = catalog.page_index(rows, F.desc("id"))
    for number, want in ((1, range(999, 969, -1)), (20, range(429, 399, -1)), (34, range(9, -1, -1)), (35, []), (0, []), (-2, [])):
        page = catalog.indexed_page(spark, path, number, 30)
        assert [r["id"] for r in page.orderBy("place").collect()] == list(want)
        assert len(page.inputFiles()) <= 2 or not want or "PartitionFilters: [" in page._jdf.queryExecution().executedPlan().toString()
    last = catalog.indexed_page(spark, path, 34, 30)
    assert {(r["total"], r["total_pages"]) for r in last.collect()} == {(1000, 34)}
    assert catalog.indexed_page(spark, catalog.page_index(rows.limit(0), F.desc("id")), 1, 30).count() == 0


def test_labels_into_containers(spark):
    doc = {"asset": {"version": "2.0"}, "nodes": [{"name": "leg_a", "mesh": 0}, {"name": "seat", "extras": {"k": [1, 2.5], "semanticLabel": "old"}}, {"mesh": 1}], "meshes": [{"name": "leg a", "extras": 5}], "accessors": [{"min": [1e-7, -0.25]}]}
    files = spark.createDataFrame([("f", json.dumps(doc)), ("plain", "{}")], "file_id string, json string").select("file_id", containers.build_glb(F.col("json"), F.encode(F.lit("bytes"), "UTF-8")).alias("content"))
    files = files.unionByName(spark.createDataFrame([("bad", b"glTF")], "file_id string, content binary"))
    told = spark.createDataFrame([("f", "leg-a", "bein é", 2), ("f", "leg a", "leg", 1), ("f", "seat", "", 3), ("f", "seat", "sitz", 1)], "model_id string, label_key string, label string, label_order int")
    before = {r["file_id"]: bytes(r["content"]) for r in files.collect()}
    after = {r["file_id"]: bytes(r["content"]) for r in containers.glb_relabel(files, told).collect()}
    assert after["bad"] == before["bad"] and after["plain"] == before["plain"]
    size = int.from_bytes(after["f"][12:16], "little")
    assert len(after["f"]) == int.from_bytes(after["f"][8:12], "little") and size % 4 == 0 and after["f"][20 + size :] == before["f"][-16:]
    doc["nodes"][0]["extras"] = doc["meshes"][0]["extras"] = {"semanticLabel": "bein é"}
    doc["nodes"][1]["extras"]["semanticLabel"] = "sitz"
    assert json.loads(after["f"][20 : 20 + size]) == doc
    again = spark.createDataFrame(list(after.items()), "file_id string, content binary")
    assert {r["error"] for r in containers.glb_validate(again).where("file_id <> 'bad'").collect()} == {None}


def test_later_labels_win(spark):
    nodes = spark.createDataFrame([(1, "a b"), (1, "a_b"), (1, "a-b"), (1, "c"), (1, None)], "model_id int, node_name string")
    told = spark.createDataFrame([(1, "a_b", "first", 1), (1, "a>b", "second", 2), (1, "a b", None, 3)], "model_id int, label_key string, label string, label_order int")
    found = {(r["node_name"], r["label"], r["match_type"]) for r in labels.label_to_node(nodes, told).collect()}
    assert found == {("a b", "second", "exact"), ("a_b", "first", "exact"), ("a-b", "second", "normalized"), ("c", None, None), (None, None, None)}


def test_keywords(spark):
    rows = spark.createDataFrame([("An  unknown  object",), ("a.b",), ("axb",), (None,)], "s string")
    hit = lambda words, literal=False: [r[0] for r in rows.select(t.has_keyword(F.col("s"), words, literal)).collect()]
    assert hit(["Unknown Object", " "]) == [True, False, False, False]
    assert hit(["a.b"]) == [False, True, True, False]
    assert hit(["a.b"], literal=True) == [False, True, False, False]
    assert hit([]) == [False] * 4


def test_prompts_cover_the_interval(spark):
    prompts = spark.createDataFrame([(1, "a", 0), (2, "b", None), (3, "c", 2)], "pos int, prompt_id string, weight int")
    ends = [(r["low"], r["high"]) for r in labels.prompt_ranges(prompts).orderBy("pos").collect()]
    assert ends == [(0, 0.25), (0.25, 0.5), (0.5, 1)]
    one = labels.assign_prompt(spark.range(5), prompts.where("pos = 1"), labels.uniform(1, F.col("id")))
    assert {r["prompt_id"] for r in one.collect()} == {"a"}


def test_obj_relabel_keeps_indent_and_case(spark):
    lines = spark.createDataFrame([(1, 1, "  UseMtl wood # label: old"), (1, 2, "v 1 2 3"), (1, 3, "usemtl Other")], "file_id int, line_no int, line string")
    told = spark.createDataFrame([(1, "Wood # x", "zzz old", 1), (1, "Wood # x", "a\nnew label", 2), (1, "wood", None, 3), (1, " ", "x", 4)], "file_id int, material string, label string, result_order int")
    assert [r["line"] for r in labels.obj_relabel(lines, told).orderBy("line_no").collect()] == ["  UseMtl Wood # label: a new label", "v 1 2 3", "usemtl Other"]


def test_numbered_over_many_partitions(spark):
    rows = spark.range(1000).repartition(7)
    assert [r["place"] for r in catalog.numbered(rows, F.desc("id")).orderBy(F.desc("id")).collect()] == list(range(1, 1001))


def test_empty_tables(spark, small):
    none = spark.createDataFrame([], VERTEX)
    assert geometry.voxelize(geometry.triangles(none), geometry.model_bbox(none), 8).count() == 0
    assert metrics.metric_statistics(spark.createDataFrame([], "v double"), ("v",)).count() == 0
    assert metrics.metric_histogram(spark.createDataFrame([], "v double"), ("v",)).count() == 0
    assert runs.progress_eta(spark.createDataFrame([], "run_id int, event_id int, ts timestamp, ok boolean")).count() == 0
    assert labels.batch_state(spark.createDataFrame([], "file_id int, text string, error string")).first()["state"] == "error"


def test_progress_keeps_events_without_run_or_time(spark):
    at = "2024-01-01 10:00:00"
    rows = [(1, 1, None, True), (1, 2, at, False), (1, 3, "2024-01-01 12:00:00", True), (None, 4, at, True), (None, 5, None, None)]
    events = spark.createDataFrame(rows, "run_id int, event_id int, ts string, ok boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    found = {r["event_id"]: (r["run_id"], r["processed"], r["succeeded"], r["percentage"], r["eta_seconds"]) for r in runs.progress_eta(events).collect()}
    assert found == {1: (1, 1, 1, 33, None), 2: (1, 2, 1, 67, 0), 3: (1, 3, 2, 100, 0), 5: (None, 1, 0, 50, None), 4: (None, 2, 1, 100, 0)}
    totals = spark.createDataFrame([(1, 4)], "run_id int, total long")
    assert {r["event_id"]: r["percentage"] for r in runs.progress_eta(events, totals).collect()} == {1: 25, 2: 50, 3: 75, 5: 50, 4: 100}
    assert [tuple(r) for r in runs.stall_gap(events).collect()] == [(1, 3, 7_200_000)]


def test_files_that_fail_before_any_result(spark):
    results = spark.createDataFrame([(1, "chair", None), (1, "", "timeout"), (2, "", "timeout"), (3, "table", None), (None, "lamp", None)], "file_id int, text string, error string")
    bad = spark.createDataFrame([(3,), (4,), (4,)], "file_id int")
    found = {tuple(r) for r in labels.file_label_outcome(results, bad).collect()}
    assert found == {(1, 1, 1, "done"), (2, 0, 1, "skipped"), (3, 1, 0, "error"), (4, 0, 0, "error"), (None, 1, 0, "done")}


def test_containers_with_lengths_beyond_any_file(spark):
    good = spark.createDataFrame([(1, '{"nodes":[{"name":"n","extras":{"semanticLabel":"chair"}}]}')], "file_id int, json string").select("file_id", containers.build_glb(F.col("json")).alias("content"))
    data = bytes(good.first()["content"])
    rows = [(i, data[:12] + bytes.fromhex(n) + data[16:]) for i, n in ((2, "FFFFFFFF"), (3, "FFFFFF7F"), (4, "ECFFFF7F"), (5, "00000080"))]
    files = good.unionByName(spark.createDataFrame(rows, "file_id int, content binary"))
    assert [r["file_id"] for r in containers.glb_labels(files).collect()] == [1]
    assert {r["error"] for r in containers.glb_validate(files).collect()} == {None, "chunk exceeds file"}


def test_metrics_view_shuffles_lines_once(spark, tmp_path):
    """Distinct counts pass over nulls, and each line is shuffled once, not once for each count."""
    lines = [(1, 5, 7, 1, 2.0), (1, 5, None, 2, 3.0), (1, None, 8, 2, 4.0), (1, 6, 8, 3, 1.0), (2, None, 9, None, 1.0), (None, 1, 1, 1, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1,), (2,), (3,), (None,)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    found = view(spark, str(tmp_path), "V_METRICS")
    counts = {r["model_id"]: (r["has_metrics"], r["material_count"], r["vertex_count"], r["face_count"], r["occupied"], r["surface"]) for r in found.collect()}
    none = (False, None, None, None, None, None)
    assert counts == {1: (True, 2, 10, 4, 2, 3), 2: (True, 0, 1, 1, 1, 0), 3: none, None: none}
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()


def test_values_are_counted_once(spark):
    """Ranks and histograms read written counts, so the assets aren't made again for each use of them."""
    rows = spark.range(40).select(F.lit(2.0).alias("vvd"), (F.col("id") % 4).cast("double").alias("vfc"))
    for found in (metrics.nearest_rank(rows, {"median": 0.5}, ("vvd", "vfc")), metrics.metric_histogram(rows, ("vvd", "vfc"))):
        assert "Range (" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["metric"]: r["median"] for r in metrics.nearest_rank(rows, {"median": 0.5}, ("vvd", "vfc")).collect()} == {"vvd": 2.0, "vfc": 2.0}


def test_stream_metrics_makes_assets_once(spark, small):
    """The rows come from written assets, not from the orders and their lines again."""
    plan = metric_queries.stream_metrics(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan
