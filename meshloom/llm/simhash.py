"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments. If two fingerprints differ in at
most two bits, at least one segment is the same in both, and in the next segment
they differ in at most two bits, so there the two share one of the few codeword
indices that lie near each. A key is an equal segment with such an index of the
next one. Different fingerprints that share a key are joined and verified.

Keys that more than ``BUCKET`` fingerprints share are not joined. Each of their
fingerprints goes instead, with its 64 one-bit neighbours, to a group for every
such word: fingerprints two bits apart meet at the word between them, and all
that meet at a word are at most two bits apart, so linking each to the group's
smallest is exact and linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import blocks, checkpointed, kept_rows, row_of, ship, small, with_text_hashes
from .components import connected_components
from .golay import keys as golay_keys

#: Bits that may differ between linked fingerprints; the keys are made for this number.
RADIUS = 2
SEED = 42
#: First bit and width of each segment.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Fingerprints of a key that are joined; larger groups take the linear way.
BUCKET = 64
BLOCK_CHARS = 2 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: str) -> list[bytes]:
    """Maximal runs of characters other than ``\\x20\\x09-\\x0D``, with A-Z lower-cased, in UTF-8."""
    return text.encode().translate(_LOWER).split()  # bytes.split() knows just these six


def fingerprints(texts: list[str | None], width: int = 3) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is set if it is in over half the shingles' hashes."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_digest
    for block in blocks(((i, t) for i, t in enumerate(texts) if t), BLOCK_CHARS):
        total = np.zeros((len(block), 64), np.int64)
        n = np.zeros(len(block), np.int64)
        for row, (_, text) in enumerate(block):
            words = words_of(text)
            if not words:
                continue
            if len(words) <= width:
                hashes = [digest(b" ".join(words), SEED)]
            else:
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.r_[0, ends[:-1] + 1]
                hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
            n[row] = len(hashes)
            raw = np.frombuffer(b"".join(hashes), ">u8")
            for at in range(0, len(raw), 1 << 16):
                bits = np.unpackbits(raw[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1)
                total[row] += bits.sum(0, dtype=np.int64)
        bits = (2 * total > n[:, None]).astype(np.uint8)
        out[[i for i, _ in block]] = np.packbits(bits, axis=1).view(">u8").ravel()
    return out


def fingerprint_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every key of every fingerprint; two within RADIUS bits of each other share a key."""
    part = [(prints >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1) for at, width in SEGMENTS]
    rows, found = [], []
    for i in range(3):
        index = np.sort(golay_keys(part[(i + 1) % 3]), axis=1)
        fresh = np.ones(index.shape, bool)
        fresh[:, 1:] = index[:, 1:] != index[:, :-1]
        row, column = np.nonzero(fresh)
        rows.append(row)
        found.append((np.int64(i) << 35 | part[i][row] << 12) | index[row, column])
    return np.concatenate(rows), np.concatenate(found)


def add_fingerprints(docs: DataFrame, text_col: str = "text", width: int = 3, name: str = "fingerprint_bits") -> DataFrame:
    """``docs`` with a long column of the fingerprint's bits (a narrow map)."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            prints = fingerprints(batch.column(at).to_pylist(), width).view(np.int64)
            yield batch.append_column(name, pa.array(prints))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def print_links(prints: DataFrame, name: str = "fp") -> DataFrame:
    """Links (a, b) that connect all different fingerprints within RADIUS bits.

    ``prints`` has each fingerprint once. Within a light key every verified pair
    is a link; the fingerprints of heavy keys are linked in stars that connect
    the same ones.
    """

    ship(prints.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            column = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(column), 4096):
                own = column[at : at + 4096]
                row, key = fingerprint_keys(own.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[row])], ["key", "fp"])

    keyed = checkpointed(prints.select(F.col(name).alias("fp")).mapInArrow(run, "key long, fp long"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    light = keyed.join(sizes.where(F.col("n") <= BUCKET).select("key"), "key", "left_semi")
    a, b = light.select("key", F.col("fp").alias("a")), light.select("key", F.col("fp").alias("b"))
    near = a.join(b, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
    heavy = keyed.join(sizes.where(F.col("n") > BUCKET).select("key"), "key", "left_semi").select("fp").distinct()
    return near.select("a", "b").distinct().unionByName(midpoint_links(heavy))


def midpoint_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) of each fingerprint to the smallest one that meets it at a word one bit from both, or at itself."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    met = prints.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("word"))
    least = met.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("word", "a")
    return met.join(least, "word").where(F.col("a") != F.col("fp")).select("a", F.col("fp").alias("b")).distinct()


def print_components(prints: DataFrame) -> DataFrame:
    """``prints``, which has each fingerprint ``fp`` once, with ``component``: the smallest one that links reach, its own included."""
    groups = connected_components(print_links(prints), "a", "b")
    # fingerprints without links are components of their own
    return prints.join(groups, prints["fp"] == groups["node"], "left").select(*prints.columns, F.coalesce("component", "fp").alias("component"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """The near-duplicate group of every document.

    Texts have A-Z lower-cased; words lie between the characters
    ``\\x20\\x09-\\x0D``; shingles of ``width`` words, repeats included, are hashed
    with XXH64 (seed 42). Documents are linked if their fingerprints differ in at
    most two bits. Returns one row per input row: the id column, ``fingerprint``
    (16 hex digits), ``component_id`` (the smallest id that links reach, its own
    included).

    A text with fewer than ``width`` words is one shingle; a null text, or one
    without words, has fingerprint zero and is linked like any other. A null id
    gets the smallest id of its group, null if there is none. Repeated rows are
    documents of their own. An empty table gives an empty one. Other columns are
    ignored, whatever their names.

    Only fingerprints are shuffled, each once: copies meet in a partial
    aggregation, so a group of copies costs no more than one document.
    """
    found = checkpointed(add_fingerprints(docs.select(id_col, text_col), text_col, width, "fp").select(F.col(id_col).alias("id"), "fp"))
    of_print = print_components(found.groupBy("fp").agg(F.min("id").alias("least")))
    least = of_print.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = of_print.join(least, "component").select("fp", "component_id")
    return found.join(of_print, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with one document of each of ``near_groups``: that with the smallest id.

    Texts without words, null ones too, have fingerprint zero, so they are one group.
    Null ids come last; of rows that repeat an id and a text one stays. All columns stay.

    Each fingerprint's first row is found in a partial aggregation, and only those rows
    meet by group, so large groups of copies make no large task.
    """
    hashed, names = with_text_hashes(docs, text_col)
    marked = hashed.select(row_of(id_col), F.col(text_col).alias("text"), *(F.col(n).alias(a) for n, a in zip(names, ("hash", "check"), strict=True)))
    found = checkpointed(add_fingerprints(marked, "text", width, "fp").drop("text"))
    first = found.groupBy("fp").agg(F.min(F.struct("row", "hash", "check")).alias("first"))
    least = print_components(first).groupBy("component").agg(F.min("first").alias("x")).select("x.*")
    once = found.groupBy("hash", "check", "row").agg(F.count("*").alias("n"))
    return kept_rows(hashed, names, once, least, id_col).select(*docs.columns)
