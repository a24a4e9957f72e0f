"""Toxicity scores by logistic regression on hashed word n-grams and skip-grams, learnt with FTRL-proximal.

Each coordinate has a learning rate of its own, and the L1 term leaves most
weights at zero, so the model that executors get is a short table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import blocks, crc_mod, ship, small

#: Hash buckets of features.
BITS = 20
#: Labelled documents of each class that the model is learnt from, at most.
SAMPLE = 4000
EPOCHS = 6
#: Buckets of all documents of the sample together that one task learns from, at most: 256 MB.
SAMPLE_BUCKETS = 64 << 20
#: Tasks that make the features of the sample.
FEATURE_TASKS = 64
ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 0.1
#: A clean document that is called toxic counts as so many toxic ones that are missed.
FALSE_COST = 5
#: Words kept with their hashes by a worker.
CACHE_WORDS = 150_000
BLOCK_CHARS = 1 << 19
_WORD = re.compile(r"\w+").findall


class WordHashes:
    """Hashes of words; those seen before are looked up."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def feature_buckets(texts: list[str], hashes: WordHashes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of every text's words, pairs of neighbours and pairs with one word between, and the text of each."""
    words = [_WORD(t.lower()) for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    h = hashes.of([w for ws in words for w in ws])
    doc = np.repeat(np.arange(len(texts)), n)
    shift = np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        mixed = lambda x: (x * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64)
        pair = h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]
        skip = h[:-2] * np.uint64(0x165667B19E3779F9) + h[2:] * np.uint64(3)
        found = [mixed(h), mixed(pair), mixed(skip)]
    near, far = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
    return np.concatenate([found[0], found[1][near], found[2][far]]), np.concatenate([doc, doc[:-1][near], doc[:-2][far]])


@dataclass
class ToxicityModel:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def table(self) -> np.ndarray:
        full = np.zeros(1 << self.bits, np.float64)
        full[self.buckets] = self.weights
        return full

    def scores(self, texts: list[str], hashes: WordHashes, table: np.ndarray) -> np.ndarray:
        """The probability of each text; a feature counts once in a text."""
        bucket, doc = feature_buckets(texts, hashes, self.bits)
        hit = table[bucket] != 0
        pair = np.unique(doc[hit] << self.bits | bucket[hit])
        total = np.bincount(pair >> self.bits, weights=table[pair & (1 << self.bits) - 1], minlength=len(texts)) if len(pair) else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -35, 35)))


def train_ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, seed: int = 1) -> ToxicityModel:
    """FTRL-proximal over documents' distinct buckets, in a shuffled order each epoch; the bias has no L1 term."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0
    rng = np.random.default_rng(seed)

    def weight(zi: np.ndarray, ni: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            x = rows[i]
            w = weight(z[x], n[x], L1)
            bias = float(weight(bias_z, bias_n, 0.0))
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - labels[i]
            step = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / ALPHA
            z[x] += g - step * w
            n[x] += g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += g * g
    full = weight(z, n, L1)
    kept = np.flatnonzero(full)
    return ToxicityModel(kept, full[kept], float(weight(bias_z, bias_n, 0.0)), bits)


def cut_between(margins: np.ndarray, labels: np.ndarray) -> float:
    """The margin at which missed and falsely called shares, the latter times FALSE_COST, are least; the middle of such."""
    order = np.argsort(margins)
    m, y = margins[order], labels[order]
    missed = np.r_[0, np.cumsum(y)] / max(1, y.sum())
    called = np.r_[0, np.cumsum(1 - y)]
    cost = missed + FALSE_COST * (called[-1] - called) / max(1, called[-1])
    best = np.flatnonzero(cost == cost.min())
    edges = np.r_[m[:1] - 1, m, m[-1:] + 1]
    return float((edges[best[0]] + edges[best[-1] + 1]) / 2)


def calibrated(rows: list[np.ndarray], labels: np.ndarray) -> ToxicityModel:
    """Trains on four fifths, finds the cut on the rest, then trains on all; the bias moves by the cut.

    So a score of a half means the cut, where missed and false calls cost the same; the score
    orders documents by their likelihood of being toxic but isn't that likelihood itself.
    """
    part = np.arange(len(rows)) % 5 == 4
    model = train_ftrl(rows, labels)
    if 0 < labels[part].sum() < part.sum() and 0 < labels[~part].sum() < (~part).sum():
        first = train_ftrl([rows[i] for i in np.flatnonzero(~part)], labels[~part])
        table = first.table()
        model.bias -= cut_between(np.array([table[rows[i]].sum() for i in np.flatnonzero(part)]) + first.bias, labels[part])
    return model


def train_toxicity(docs: DataFrame, labels: DataFrame, held_out: int | None = 0, folds: int = 5, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learns from labelled documents outside fold ``held_out`` (None: from all).

    At most ``sample`` documents of each class are taken, those whose ids have the
    smallest hashes. Their features are made in many tasks; one task learns from
    the features' buckets, at most SAMPLE_BUCKETS of them: documents of the sample that
    don't fit behind those before them, in the order of the hashes, teach nothing. Rows without a label or an id teach
    nothing; of several labels of an id the largest counts. Without both classes
    the model is a constant.
    """
    ship(docs.sparkSession)
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if held_out is not None:
        marks = marks.where(crc_mod(F.col(id_col), folds) != held_out)
    marks = marks.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("mark")).withColumn("order", F.xxhash64("id"))
    taken = [marks.where(F.col("mark") == k).orderBy("order", "id").limit(sample) for k in (0, 1)]
    picked = taken[0].unionByName(taken[1])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")  # at most 2 x sample rows
    rows = rows.groupBy("id", "mark", "order").agg(F.max("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small(batches):
            rows: list[np.ndarray] = []
            for block in blocks(((t or "",) for t in batch.column("text").to_pylist()), BLOCK_CHARS):
                bucket, doc = feature_buckets([t for (t,) in block], hashes)
                pair = np.unique(doc << BITS | bucket)
                rows += np.split((pair & (1 << BITS) - 1).astype(np.int32), np.searchsorted(pair, np.arange(1, len(block)) << BITS))
            columns = [batch.column("order"), batch.column("id"), batch.column("mark"), pa.array(rows, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["order", "id", "mark", "buckets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, marked, room = [], [], SAMPLE_BUCKETS
        for batch in batches:
            lists = batch.column("buckets")
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for a, b, mark in zip(ends[:-1].tolist(), ends[1:].tolist(), batch.column("mark").to_pylist(), strict=True):
                if b - a <= room:
                    room -= b - a
                    seen.append(values[a:b].copy())
                    marked.append(mark)
        mark = np.array(marked, np.float64)
        if 0 < mark.sum() < len(mark):
            model = calibrated(seen, mark)
        else:
            model = ToxicityModel(np.zeros(0, np.int64), np.zeros(0), 35.0 if len(mark) and mark[0] else -35.0)
        buckets, weights = [-1, *model.buckets.tolist()], [model.bias, *model.weights.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(weights, pa.float64())], ["bucket", "weight"])

    kind = rows.schema["id"].dataType.simpleString()
    made = rows.repartition(FEATURE_TASKS, "order").mapInArrow(features, f"order long, id {kind}, mark int, buckets array<int>")
    found = made.orderBy("order", "id").coalesce(1).mapInArrow(run, "bucket long, weight double").toPandas()
    bias = found.loc[found["bucket"] == -1, "weight"]
    rest = found[found["bucket"] >= 0]
    return ToxicityModel(rest["bucket"].to_numpy(), rest["weight"].to_numpy(), float(bias.iloc[0]) if len(bias) else -35.0)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of every whole text (a narrow map); a null text scores as an empty one."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most 2^BITS weights, in fact some thousands
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = WordHashes(), held.value.table()
        for batch in small(batches):
            out = np.zeros(batch.num_rows)
            for block in blocks(((i, t or "") for i, t in enumerate(batch.column(at).to_pylist())), BLOCK_CHARS):
                out[[i for i, _ in block]] = held.value.scores([t for _, t in block], hashes, table)
            yield batch.append_column(name, pa.array(out))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from the labels outside fold 0 of 5 and scores every document.

    Returns one row per input row: the id column, ``held_out`` (crc32 of the id
    as text, modulo 5, is 0), ``score`` (0 to 1), ``predicted`` (1 if the score is
    at least 0.5). A null or empty text has the score of no features; a null id
    is not held out. Repeated rows give repeated results; an empty table gives an
    empty one; without labels of both classes scores are near 0 or 1. Other
    columns are ignored, whatever their names.
    """
    model = train_toxicity(docs, labels, id_col=id_col, text_col=text_col)
    scored = score_toxicity(docs.select(id_col, text_col), model, text_col)
    held = F.coalesce(crc_mod(F.col(id_col), 5) == 0, F.lit(False)).alias("held_out")
    return scored.select(id_col, held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
