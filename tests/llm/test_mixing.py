"""Operator 12 against SQL and brute force."""

import hashlib
import math
import re
from collections import defaultdict

import duckdb
import pytest
from helpers import ODD, odd_documents

from meshloom.llm import mixing as mx, queries


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shares(sizes, weights=(5, 2, 1), percent=150, copies=2):
    """The target of each source, in order, by sharing what is over until none is."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    full, total = set(), sum(sizes.values()) * percent / 100
    while True:
        left, by = total - sum(copies * sizes[s] for s in full), sum(w for s, w in weight.items() if s not in full)
        found = {s: copies * sizes[s] if s in full else w * left / by for s, w in weight.items()}
        over = {s for s in sizes if found[s] > copies * sizes[s] * (1 + 1e-12)}
        if not over:
            return found
        full |= over


def exact(rows, seed=12, **more):
    """(id, size, source_size, target, taken) for rows of (id, source, text)."""
    rows = [(i, s, n_words(t)) for i, s, t in rows]
    sizes, members = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r[1]] += r[2]
        members[r[1]].append(r)
    out = []
    for source, target in shares(sizes, **more).items():
        size, docs = sizes[source], members[source]
        each = target / size if size else 0.0
        copies, rate = math.floor(each), each - math.floor(each)
        most = max(1, math.ceil(4 * size / len(docs)))
        sure, drawn = [], []
        for i, _, n in docs:
            chance = rate if n <= most else rate * n / most
            u = (int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            if chance >= 1:
                sure.append((i, n, math.floor(rate * n + 0.5)))
            elif n and chance > 0:
                q = (u / (1 - u)) / (chance / (1 - chance))
                drawn.append((q / (1 + q), i is None, i or 0, n, min(n, most)))
            else:
                out.append((i, n, size, target, copies * n))
        left = math.floor(target + 0.5) - copies * size - sum(p for *_, p in sure)
        out += [(i, n, size, target, copies * n + p) for i, n, p in sure]
        drawn.sort()
        k = 0
        while k < len(drawn):
            alike = drawn.count(drawn[k])
            _, none, i, n, part = drawn[k]
            part = min(part, max(left, 0) // alike)
            out += [(None if none else i, n, size, target, copies * n + part)] * alike
            left -= drawn[k][-1] * alike
            k += alike
    return out


def same(got, want):
    got = sorted([(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got], key=repr)
    want = sorted(want, key=repr)
    assert [(*g[:3], g[4]) for g in got] == [(*w[:3], w[4]) for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-12)


def near(got, slack=1.0):
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] + r["drawn"]
        taken[r["target"], r["source_size"]] += r["taken"]
    assert all(abs(n / max(1, round(n / t[0]) if t[0] else 1) - t[0]) <= slack for t, n in taken.items())


def test_op12(spark, small):
    got = queries.op12_mixing(spark, small).collect()
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "text").collect()
    same(got, exact(map(tuple, rows)))
    near(got)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    names = "doc_id, size, source_size, target, copies, drawn, taken"
    sql = con.execute(f"select {names} from ({mx.MIX_SQL}) order by doc_id").fetchall()
    assert sorted(tuple(r[c] for c in names.split(", ")) for r in got) == sql
    again = queries.op12_mixing(spark, small).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = [(i, "s", t) for i, t in ODD]
    got = mx.mix_sources(docs.repartition(3)).collect()
    same(got, exact(rows))
    assert mx.mix_sources(docs.limit(0)).count() == 0
    empty = mx.mix_sources(docs.where("text is null or doc_id = 3")).collect()
    assert {(r["size"], r["target"], r["taken"]) for r in empty} == {(0, 0.0, 0)}


@pytest.mark.parametrize("slices", [4, 4096])
def test_many_sources(spark, monkeypatch, slices):
    monkeypatch.setattr(mx, "SLICES", slices)
    sources = [None, "", "a", "b", "ä", "😀", "zz", "hot"]
    rows = [(i if i % 11 else None, "hot" if i % 3 == 0 else sources[i * i % 8], "w " * (3000 if i == 70 else i * 7919 % 90)) for i in range(1, 700)]
    rows += [(5, "a", "one two"), (5, "a", "one two"), *[(9, "hot", "tick tock tick")] * 40, (1, "few", "only these three")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, source string, text string, size string, most string")
    got = mx.mix_sources(docs.repartition(5)).collect()
    same(got, exact(rows))
    assert len({r["drawn"] for r in got}) > 20


def test_targets_stop_at_their_most(spark):
    sizes = {"a": 10, "b": 1000, "c": 100, "d": 5, "e": 700}
    table = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "id long, source string, size long")
    got = {r["source"]: r["target"] for r in mx.source_targets(table).collect()}
    assert got == pytest.approx(shares(sizes))
    assert got["a"] == 20 and got["d"] == 10 and sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert {r["source"]: r["target"] for r in mx.source_targets(table, percent=200).collect()} == {s: 2 * n for s, n in sizes.items()}


def test_sources_come_near_their_chance(spark):
    """Over many seeds a document's share of words is its source's."""
    rows = [(i, "a" if i % 2 else "b", 1 + i % 7 + 100 * (i == 3)) for i in range(60)]
    table = spark.createDataFrame(rows, "id long, source string, size long")
    total = defaultdict(int)
    for seed in range(8):
        for r in mx.mixture(table, weights=(1, 3), seed=seed).collect():
            total[r["id"] == 3] += r["taken"]
    target = {r["source"]: (r["target"], r["source_size"]) for r in mx.source_targets(table, weights=(1, 3)).collect()}["a" if 3 % 2 else "b"]
    assert total[True] / 8 == pytest.approx(rows[3][2] * target[0] / target[1], rel=0.15)


def test_texts_of_the_mix(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumnRenamed("lang", "copies")
    plan = mx.mix_sources(docs)
    got = mx.mixed_texts(docs, plan)
    assert got.columns == docs.columns
    words = defaultdict(int)
    for r in got.collect():
        words[r["doc_id"]] += n_words(r["text"])
    assert words == {r["doc_id"]: r["taken"] for r in plan.collect() if r["taken"]}
