"""Importance resampling towards a target distribution of hashed word n-grams, with crc32 computed on whole matrices.

A text's bytes stay in one flat array. Words are runs of its letters and digits;
features are runs of words, joined by one space. Distinct features of equal length
form a two-dimensional array of bytes, whose rows' checksums advance together, one
column at a time; the buckets are then scattered back to where the features stand.

Two passes read the texts: one counts buckets over all documents and the target,
one weighs every document by the logarithm of the two frequencies' ratio. Random
noise of the Gumbel distribution makes the documents of the highest sums a draw
without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.operators.catalog import numbered

from .common import checkpointed, ragged, ship, sum_runs

#: Buckets of features, and words that a document must have to be drawn.
BUCKETS, LEAST_WORDS = 10_000, 20
#: Bytes of texts that are handled at once, about.
BLOCK_BYTES = 4 << 20
#: Features longer than this are few; each is handed to zlib, which takes it in one call.
MATRIX_BYTES = 64
GAIN_UNIT = 1000


def _crc_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, crc >> 1 ^ np.uint32(0xEDB88320), crc >> 1)  # the polynomial of zlib's crc32
    return crc


def _folded() -> np.ndarray:
    """By byte: words' bytes with A-Z in lower case, a space for all others."""
    table = np.full(256, 0x20, np.uint8)
    keep = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
    table[keep] = keep
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


CRC, FOLDED = _crc_table(), _folded()


def crc_rows(matrix: np.ndarray) -> np.ndarray:
    """The crc32 of every row of a matrix of bytes."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = CRC[(crc ^ column) & np.uint32(0xFF)] ^ crc >> np.uint32(8)
    return ~crc


def distinct_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows without repeats, and which of them each row is; short rows are compared as numbers."""
    n, width = matrix.shape
    if width <= 8:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = matrix
        rows = wide.view(np.uint64).ravel()
    else:
        rows = np.ascontiguousarray(matrix).view(f"V{width}").ravel()
    _, first, which = np.unique(rows, return_index=True, return_inverse=True)
    return matrix[first], which


def feature_crcs(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The crc32 of each feature ``flat[start : start + size]``, by matrices of equally long ones."""
    crcs = np.zeros(len(start), np.uint32)
    order = np.argsort(size, kind="stable")
    ends = np.flatnonzero(np.diff(size[order], append=-1)) + 1
    at = 0
    for end in ends.tolist():
        group, at = order[at:end], end
        width = int(size[group[0]])
        if width > MATRIX_BYTES:
            crcs[group] = [zlib.crc32(flat[a : a + width]) for a in start[group].tolist()]
            continue
        rows, which = distinct_rows(flat[start[group][:, None] + np.arange(width)])
        crcs[group] = crc_rows(rows)[which]
    return crcs


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each ends; nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    return flat, ends[1:] - ends[0]


def text_blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """Slices of consecutive texts with about ``size`` bytes."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at = 0
    while at < len(texts):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + size)))
        yield texts.slice(at, end - at)
        at = end


def word_features(texts: pa.Array, longest: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The crc32 of every run of 1 to ``longest`` words, which text it is in, and the number of words of each text.

    A-Z become a-z; words are runs of other characters than those of ASCII that are
    neither digits nor letters.
    """
    flat, ends = flat_bytes(texts)
    if not len(flat):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint32), none, np.zeros(len(texts), np.int64)
    flat = FOLDED[flat]
    inside = flat != 0x20
    # a word begins after another character or where a text begins
    begins, last = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = ends[(ends > 0) & (ends < len(flat))]
    begins[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(begins)
    size = np.flatnonzero(last) + 1 - start
    text = np.searchsorted(ends, start, side="right")
    words = np.bincount(text, minlength=len(texts))
    if longest > 1:
        # the words again, each with one space behind it
        flat = ragged(np.append(flat, np.uint8(0x20)), start, size + 1)
        stop = np.cumsum(size + 1) - 1
        flat[stop] = 0x20
        start = stop - size
    crcs, of = [feature_crcs(flat, start, size)], [text]
    for n in range(2, longest + 1):
        same = text[: 1 - n] == text[n - 1 :]
        first = start[: 1 - n][same]
        crcs.append(feature_crcs(flat, first, stop[n - 1 :][same] - first))
        of.append(text[: 1 - n][same])
    return np.concatenate(crcs), np.concatenate(of), words


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket's features stand in all texts: tasks count what they read, Spark adds; ``buckets`` numbers reach the driver."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                crcs, _, _ = word_features(block, longest)
                counts += np.bincount(crcs % buckets, minlength=buckets)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["bucket", "n"])

    found = docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for r in found.collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket, thousandths of the logarithm of the target's frequency over the source's, both smoothed by one a bucket; rounded down."""
    n, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    ratio = (target + 1.0) * (all_source + n) / ((source + 1.0) * (all_target + n))
    return np.array([math.floor(GAIN_UNIT * math.log(x)) for x in ratio.tolist()], np.int64)


def add_weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1) -> DataFrame:
    """The id column of ``docs`` with ``n_features``, ``n_words`` and ``weight``, the sum of the features' gains (a narrow map)."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in batches:
            out: list[np.ndarray] = [np.zeros((3, 0), np.int64)]
            for block in text_blocks(batch.column(1)):
                crcs, of, words = word_features(block, longest)
                order = np.argsort(of, kind="stable") if longest > 1 else slice(None)
                features = np.bincount(of, minlength=len(block))
                out.append(np.stack([features, words, sum_runs(gain[crcs % len(gain)][order], features)]))
            found = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found)], [id_col, "n_features", "n_words", "weight"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_features long, n_words long, weight long")


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    seed: int = 2024,
    longest: int = 1,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Draws ``percent`` in a hundred of the documents with ``least_words`` words, in favour of those like ``target``.

    Returns a row for each of ``docs``: the id column, ``n_features``, ``weight``,
    ``score`` (the weight with noise from the sha256 of ``seed:id``), and ``rank`` (1, 2,
    3 from the highest score, ties to the smaller id; null, if not drawn).

    A null or empty text has no features, so its weight is zero and it isn't drawn if
    a word is asked for. A null id is hashed as nothing and comes after other ids in
    ties. Repeated rows have the same score and follow one another, and as many of them
    are drawn as there is room for. Without documents the result is empty; an empty
    target still gives frequencies, all alike. Other columns of either table are
    ignored, whatever their names. ``target`` has its texts in the same column.

    Counts and weights are narrow maps. Only ids and numbers are written and sorted:
    the rank is a place in a sort over the cluster, so no task holds all documents.
    """
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, text_col, longest, buckets))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    score = F.col("weight") + F.floor(-GAIN_UNIT * F.log(-F.log((noise + 0.5) / F.lit(4294967296.0))))
    rows = add_weights(docs, gain, id_col, text_col, longest).select(F.col(id_col).alias("id"), "n_features", "weight", score.alias("score"), (F.col("n_words") >= least_words).alias("fit"))
    placed = numbered(checkpointed(rows), F.desc("fit"), F.desc("score"), F.asc_nulls_last("id"))
    drawn = placed.agg((F.floor(F.count_if("fit") * percent / 100))).scalar()
    rank = F.when(F.col("fit") & (F.col("place") <= drawn), F.col("place").cast("long"))
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))
