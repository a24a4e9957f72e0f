"""Operator 13 against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, odd_documents

from meshloom.llm import queries, resampling as rs


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features_of(text, longest=1):
    words = words_of(text)
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def exact(docs, target, percent=10, seed=2024, longest=1, least=20, buckets=10_000):
    source, wanted = (Counter(f % buckets for t in texts for f in features_of(t, longest)) for texts in ([t for _, t in docs], target))
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets))))
    rows = []
    for i, t in docs:
        found = features_of(t, longest)
        weight = sum(gain(f % buckets) for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(t)) >= least))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = math.floor(percent * len(fit) / 100)
    return sorted([(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(fit)] + [(*r[:4], None) for r in rows if not r[4]], key=repr)


def test_op13(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = queries.op13_resampling(spark, small)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    assert sorted(map(tuple, got.collect()), key=repr) == exact(docs, target)


def test_crc_of_every_length():
    rng = np.random.default_rng(1)
    size = np.r_[0, 1, 2, 7, 8, 9, 63, 64, 65, 300, 5000, rng.integers(0, 12, 500)]
    flat = rng.integers(0, 4, size.sum()).astype(np.uint8)
    start = np.cumsum(size) - size
    assert rs.feature_crcs(flat, start, size).tolist() == [zlib.crc32(flat[a : a + n]) for a, n in zip(start.tolist(), size.tolist(), strict=True)]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_features_of_odd_texts(longest, monkeypatch):
    rng = random.Random(longest)
    texts = [t for _, t in ODD] + ["".join(rng.choice("aZé 9-\n\x00😀_`{") for _ in range(rng.randrange(40))) for _ in range(300)] + ["a", "b", "", None, "a"]
    array = pa.array(texts, pa.string())
    for part, own in ((array, texts), (array.slice(3, 50), texts[3:53]), (pa.array([None, ""], pa.string()), ["", ""])):
        crcs, of, words = rs.word_features(part, longest)
        assert words.tolist() == [len(words_of(t)) for t in own]
        assert [Counter(crcs[of == i].tolist()) for i in range(len(own))] == [Counter(features_of(t, longest)) for t in own]
    assert [len(b) for b in rs.text_blocks(array.slice(0, 9), 100)] and sum(len(b) for b in rs.text_blocks(array, 100)) == len(texts)


@pytest.mark.parametrize("longest", [1, 2])
def test_odd_documents(spark, longest):
    docs, target = odd_documents(spark).repartition(3), spark.createDataFrame([("The cat sat, the DOG sat.", 1), (None, 2), ("", 3)], "text string, weight long")
    got = rs.importance_resample(docs, target, percent=60, longest=longest, least_words=2)
    assert sorted(map(tuple, got.collect()), key=repr) == exact(ODD, ["The cat sat, the DOG sat."], 60, longest=longest, least=2)
    assert sorted(map(tuple, rs.importance_resample(docs, target.limit(0), percent=60, longest=longest, least_words=2).collect()), key=repr) == exact(ODD, [], 60, longest=longest, least=2)
    assert rs.importance_resample(docs.limit(0), target).count() == 0
