"""Uploads in chunks: their plan, their state and their assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

CHUNK_BYTES = 10 << 20


def chunk_plan(files: DataFrame, chunk: int = CHUNK_BYTES, key: str = "file_id", size: str = "size") -> DataFrame:
    """One row per chunk: its index, the number of chunks, and the bytes [start_byte, end_byte) it covers; none for an empty file."""
    total = F.ceil(F.col(size) / chunk)
    rows = files.where(F.col(size) > 0).select(key, F.col(size).alias("_size"), total.alias("total_chunks"), F.explode(F.sequence(F.lit(0).cast("long"), total - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * chunk
    return rows.select(key, "chunk_index", "total_chunks", start.alias("start_byte"), F.least(start + chunk, F.col("_size")).alias("end_byte"))


def chunk_status(chunks: DataFrame, key: str = "file_id") -> DataFrame:
    """Per file the uploaded and the missing indexes, and whether to resume (any is uploaded).

    Repeated chunks are one; indexes outside the file's range don't count. A
    file of no chunks has none, neither uploaded nor missing. A file's indexes are
    collected, not its bytes.
    """
    got = chunks.groupBy(key).agg(F.max("total_chunks").alias("total_chunks"), F.array_sort(F.collect_set("chunk_index")).alias("got"))
    every = F.when(F.col("total_chunks") > 0, F.sequence(F.lit(0), F.col("total_chunks") - 1)).otherwise(F.array().cast("array<int>"))
    uploaded = F.array_intersect(every, "got")
    return got.select(key, "total_chunks", uploaded.alias("uploaded"), F.array_except(every, "got").alias("missing"), (F.size(uploaded) > 0).alias("should_resume"))


def assemble_chunks(chunks: DataFrame, key: str = "file_id", data: str = "data") -> DataFrame:
    """Per file its chunks' data in order, and its size; or an error that names the first missing chunk.

    Chunks are texts, sized in characters, or bytes. A file of no chunks is empty.

    A file must fit into a row, as it does in the table it is written to; files
    that aren't complete are told apart before anything is collected.
    """
    state = chunk_status(chunks, key).select(key, "total_chunks", F.element_at(F.when(F.size("missing") > 0, F.col("missing")), 1).alias("first_missing"))
    whole = chunks.join(state.where("first_missing is null").select(key), key, "left_semi").where("chunk_index >= 0 and chunk_index < total_chunks")
    parts = whole.groupBy(key, "chunk_index").agg(F.max(data).alias("part")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "part"))).alias("parts"))
    binary = isinstance(chunks.schema[data].dataType, BinaryType)
    text = F.array_join(F.transform("parts", lambda p: F.hex(p["part"]) if binary else p["part"]), "")
    built = parts.select(key, (F.unhex(text) if binary else text).alias("content"))
    error = F.when(F.col("first_missing").isNotNull(), F.concat(F.lit("missing chunk "), F.col("first_missing").cast("string")))
    content = F.when(F.col("first_missing").isNull(), F.coalesce("content", F.lit(b"" if binary else ""))).alias("content")
    return state.join(built, key, "left").select(key, content, error.alias("error")).select(key, "content", F.length("content").cast("long").alias("size"), "error")


def cancel_upload(chunks: DataFrame, cancelled: DataFrame, key: str = "file_id") -> DataFrame:
    """The chunks of files that aren't cancelled."""
    return chunks.join(cancelled.select(key), key, "left_anti")
