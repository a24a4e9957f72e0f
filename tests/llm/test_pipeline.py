"""Each stage of the pipeline on documents of its own, and the whole."""

from helpers import odd_documents

import corpus_pipeline as pipeline
from meshloom.llm.simhash import near_groups


def stage(name):
    return dict(pipeline.STAGES)[name]


def test_stages_keep_the_columns(spark, small):
    docs = odd_documents(spark)
    for name, f in pipeline.STAGES[:-1]:
        found = f(spark, docs, small)
        assert found.columns == docs.columns, name
        assert found.dtypes == docs.dtypes, name
        assert f(spark, docs.limit(0), small).count() == 0, name
    assert stage("packing")(spark, docs.limit(0), small).count() == 0


def test_decisions(spark, small):
    docs = odd_documents(spark)
    kept = {r["doc_id"] for r in stage("language_id")(spark, docs, small).collect()}
    assert {2, 3, 4, -11} & kept == set() and {1, 5, 6, 9, None} <= kept
    kept = [r["doc_id"] for r in stage("near_dedup")(spark, docs, small).collect()]
    assert 5 not in kept and 1 in kept
    rows = {r["doc_id"]: r for r in stage("secrets")(spark, docs, small).collect()}
    assert len(rows) == len({r["doc_id"] for r in docs.collect()})
    assert "AKIA" not in rows[10]["text"] and rows[10]["n_chars"] == len(rows[10]["text"])


def test_run(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    marks = dict(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").collect())
    rows = pipeline.run(spark, folder).collect()
    kept = {r["doc_id"] for r in rows}
    clean = [i for i, t in marks.items() if not t]
    texts = dict(docs.select("doc_id", "text").collect())
    # no two documents that are kept have the same text, and a text that nobody calls toxic stays once
    assert len({texts[i] for i in kept}) == len(kept)
    held = {texts[i] for i in kept}
    assert sum(texts[i] in held for i in clean) / len(clean) > 0.9
    toxic = [i for i, t in marks.items() if t]
    assert sum(i in kept for i in toxic) / len(toxic) < 0.3
    assert len(pipeline.STAGES) == 5


def test_near_dedup_keeps_one_of_each_simhash_group(spark):
    """One row of each of op4's components: the smallest id, null ids last, one of repeated rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    long = " ".join(f"word{i}" for i in range(400))
    odd = [(None, long), (900003, long), (900003, long), (900002, long + " end"), (900007, None), (900006, " \t"), (900006, " \t"), (None, "only a null id")]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    kept = stage("near_dedup")(spark, docs, "").collect()
    groups = near_groups(docs.where("doc_id is not null")).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({r["component_id"] for r in groups})
    assert [r["text"] for r in kept if r["doc_id"] is None] == ["only a null id"]
