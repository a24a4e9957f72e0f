"""Helpers that several operators of this folder share."""

from __future__ import annotations

import re
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest file that ``broadcast_file`` ships to executors.
MAX_BROADCAST_BYTES = 64 << 20

#: Rows of a table that ``joined_with`` sends to all executors; keys and hashes, some 20 MB at most.
MAX_BROADCAST_ROWS = 200_000

#: Rows that an operator handles at once.
BATCH_ROWS = 1000
#: Characters of a text that are made into words at once, about.
PIECE_CHARS = 1 << 20
_SPACE = re.compile(r"\s")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, which unpickle its functions by name; once an application.

    Texts may be long, so the session's tasks exchange at most BATCH_ROWS rows at once with Python from now on.
    """
    sc, rows = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        package = Path(__file__).parent.parent
        target = Path(tempfile.mkdtemp(), f"{package.name}.zip")
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(target))


_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine), a temporary
    folder is taken and set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-", dir="/tmp"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_file(spark: SparkSession, path: str) -> Broadcast:
    """The bytes of a local file of the driver, whose size is checked, for all executors."""
    with open(path, "rb") as f:
        data = f.read(MAX_BROADCAST_BYTES + 1)
    if len(data) > MAX_BROADCAST_BYTES:
        raise ValueError(f"{path} has more than {MAX_BROADCAST_BYTES} bytes; it is too large to broadcast")
    return spark.sparkContext.broadcast(data)


def joined_with(rows: DataFrame, keys: DataFrame, on: list[str] | list[Column], how: str) -> DataFrame:
    """``rows`` joined with a table of short keys, which is counted: few are sent to ``rows``, many are met in a shuffle."""
    few = keys.count() <= MAX_BROADCAST_ROWS
    return rows.join(F.broadcast(keys) if few else keys, on, how)


def with_text_hashes(docs: DataFrame, text_col: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with two hashes of their texts, 128 bits together, and the columns' names."""
    names = [free_name(docs, n) for n in ("text_hash", "text_check")]
    return docs.withColumns({names[0]: F.xxhash64(text_col), names[1]: F.xxhash64(F.lit("check"), text_col)}), names


def row_of(id_col: str) -> Column:
    """A struct that orders rows by their id, null ids last."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id")).alias("row")


def distinct_rows(hashed: DataFrame, names: list[str], id_col: str) -> DataFrame:
    """(hash, check, row, n): the different ids and texts of ``with_text_hashes``, and how often they occur."""
    rows = hashed.select(row_of(id_col), F.col(names[0]).alias("hash"), F.col(names[1]).alias("check"))
    return rows.groupBy("hash", "check", "row").agg(F.count("*").alias("n"))


def kept_rows(hashed: DataFrame, names: list[str], once: DataFrame, least: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``hashed`` that ``least`` (row, hash, check) names, one of each; ``once`` are its ``distinct_rows``.

    Texts aren't shuffled as long as the rows that go are few: they are found among hashes.
    """
    kept = once.join(least.withColumn("keep", F.lit(True)), ["hash", "check", "row"], "left")
    # rows that go, and those of which one of several stays
    odd = checkpointed(kept.where("keep is null or n > 1").select(F.col("row.id").alias("_id"), F.col("hash").alias("_hash"), F.col("check").alias("_check"), F.col("keep").isNotNull().alias("_keep")))
    same = [hashed[id_col].eqNullSafe(odd["_id"]), hashed[names[0]] == odd["_hash"], hashed[names[1]] == odd["_check"]]
    found = joined_with(hashed, odd, same, "left_anti")
    again = odd.where("_keep")
    if again.isEmpty():
        return found
    return found.unionByName(joined_with(hashed, again, same, "left_semi").dropDuplicates([id_col, *names]))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo ``n`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores behind it as long as ``df`` has a column of that name, in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs ``flat[start[i] : start[i] + size[i]]``, one after another."""
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    index = np.repeat(start - (ends - size), size)
    index += np.arange(ends[-1])
    return flat[index]


def sum_runs(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``; an empty run sums to zero."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.result_type(values, np.int64)), np.cumsum(values, axis=0)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def small(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that few texts at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut before white space."""
    at = 0
    while len(text) - at > size:
        cut = _SPACE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def blocks(items: Iterable[tuple], size: int) -> Iterator[list[tuple]]:
    """Groups consecutive items, whose last member is a text, into lists of about ``size`` characters."""
    block, chars = [], 0
    for item in items:
        block.append(item)
        chars += len(item[-1]) + 16
        if chars >= size:
            yield block
            block, chars = [], 0
    if block:
        yield block
