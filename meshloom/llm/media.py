"""Media columns: payloads stored as images in archives, and a data source that reads them.

``write_media`` stores each text's bytes as an 8-bit greyscale PNG, a member of
a ZIP archive in a folder that all executors share. The ``media_archive`` data
source plans byte ranges over the archives of a folder; a task takes the members
that start in its range, as the archive's own directory lists them, and streams
them in Arrow batches. A member that can't be read is tried again by itself, at
its offset; the others are not read twice.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import nullcontext
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .common import shared_dir, ship

#: Bytes in a row of samples; payloads are padded with zeros to a positive multiple.
UNIT = 64
PNG_START = b"\x89PNG\r\n\x1a\n"
LENGTH_KEY = b"Length\0"
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (a plain path is local) and the path there."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# ---- the stored form


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(data: bytes) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of ``UNIT``."""
    return data + bytes(-len(data) % UNIT or (UNIT if not data else 0))


def encode_png(data: bytes) -> bytes:
    """A greyscale image whose samples are the padded bytes, ``UNIT`` in a row."""
    samples = np.frombuffer(padded(data), np.uint8).reshape(-1, UNIT)
    rows = np.zeros((len(samples), UNIT + 1), np.uint8)  # each row begins with filter type 0
    rows[:, 1:] = samples
    head = struct.pack(">IIBBBBB", UNIT, len(samples), 8, 0, 0, 0, 0)
    return PNG_START + _chunk(b"IHDR", head) + _chunk(b"tEXt", LENGTH_KEY + b"%d" % len(data)) + _chunk(b"IDAT", zlib.compress(rows, 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[np.ndarray, int]:
    """The samples (rows of ``UNIT``) of an image of ``encode_png`` and its length before padding."""
    if media[:8] != PNG_START:
        raise ValueError("not a PNG")
    at, body, length, size = 8, [], None, None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, part = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + part):
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"tEXt" and part.startswith(LENGTH_KEY):
            length = int(part[len(LENGTH_KEY) :])
        at += 12 + n
    if size is None or size[0] != UNIT or size[2:] != (8, 0, 0, 0, 0) or length is None:
        raise ValueError("not an image of this module")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], UNIT + 1)
    if rows[:, 0].any():
        raise ValueError("unknown PNG filter")
    return rows[:, 1:], length


def features(samples: np.ndarray) -> str:
    """Summary of the samples: height, mean, deviation, entropy and mean step between neighbours."""
    counts = np.bincount(samples.ravel(), minlength=256)
    n, values = samples.size, np.arange(256)
    mean = counts @ values / n
    deviation = np.sqrt(max(0.0, counts @ (values * values) / n - mean * mean))
    share = counts[counts > 0] / n
    step = np.abs(np.diff(samples.astype(np.int16), axis=1)).mean()
    return f"h={len(samples)};mean={mean:.4f};sd={deviation:.4f};entropy={-(share @ np.log2(share)):.4f};step={step:.4f}"


# ---- writing


def write_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Stores every text as an image in archives in ``folder``; one row per archive: name, members, bytes.

    Lazy: the archives are written when the result is computed. An archive's name
    comes from its partition and its place there, and it gets that name when it
    is whole, so a task that is run again leaves no second copy.
    """

    ship(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = file_system(folder)
        part, done = TaskContext.get().partitionId(), 0
        buffer, members = io.BytesIO(), 0
        archive = zipfile.ZipFile(buffer, "w")

        def close() -> pa.RecordBatch:
            nonlocal buffer, members, archive, done
            archive.close()
            name = f"part-{part:06d}-{done:04d}.zip"
            draft = f"{root}/.{name}.{uuid.uuid4().hex}"
            with where.open_output_stream(draft) as out:
                out.write(buffer.getbuffer())
            where.move(draft, f"{root}/{name}")
            row = pa.RecordBatch.from_pylist([{"archive": name, "members": members, "bytes": buffer.tell()}])
            buffer, members, done = io.BytesIO(), 0, done + 1
            archive = zipfile.ZipFile(buffer, "w")
            return row

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                label = "" if name is None else quote(str(name), safe="-")
                archive.writestr(zipfile.ZipInfo(f"{members}/{label}.png"), encode_png((text or "").encode()))
                members += 1
                if buffer.tell() >= archive_bytes:
                    yield close()
        if members:
            yield close()

    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)
    return docs.select(id_col, text_col).mapInArrow(run, "archive string, members long, bytes long")


# ---- reading


@dataclass
class ArchiveRange(InputPartition):
    """The members of an archive whose headers start in [low, high)."""

    path: str
    size: int
    low: int
    high: int


def read_member(
    held: pa.NativeFile, opened: Callable[[], pa.NativeFile], offset: int, size: int, crc: int, retries: int, wait: float = 0.2
) -> tuple[bytes | None, int, str | None]:
    """The stored bytes of the member at ``offset``, the attempts made, and the last error if all failed.

    The first attempt uses the file that is ``held`` open, each other one a fresh handle.
    """
    why = None
    for attempt in range(1, retries + 2):
        try:
            with nullcontext(held) if attempt == 1 else opened() as f:
                head = f.read_at(30, offset)
                if head[:4] != b"PK\x03\x04":
                    raise OSError("no member begins here")
                name, extra = struct.unpack_from("<HH", head, 26)
                data = f.read_at(size, offset + 30 + name + extra)
            if len(data) != size or zlib.crc32(data) != crc:
                raise OSError("the member is damaged")
            return data, attempt, None
        except (OSError, pa.ArrowException, struct.error) as e:
            why = f"{type(e).__name__}: {e}"
            if attempt <= retries:
                time.sleep(wait * attempt)
    return None, retries + 1, why


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.retries = int(options.get("retries", 3))
        self.fail = options.get("onerror", "fail") == "fail"

    def partitions(self) -> list[ArchiveRange]:
        where, root = file_system(self.path)
        found = [x for x in where.get_file_info(pafs.FileSelector(root)) if x.base_name.endswith(".zip") and not x.base_name.startswith(".")]
        return [ArchiveRange(x.path, x.size, at, min(x.size, at + self.range_bytes)) for x in sorted(found, key=lambda x: x.path) for at in range(0, x.size, self.range_bytes)]

    def read(self, partition: ArchiveRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None or not hasattr(partition, "path"):  # an empty folder
            return
        where, _ = file_system(self.path)
        opened = lambda: where.open_input_file(partition.path)
        with opened() as f, zipfile.ZipFile(f) as archive:
            members = [m for m in archive.infolist() if partition.low <= m.header_offset < partition.high]
            yield from self._stream(f, opened, members, partition.path)

    def _stream(self, f: pa.NativeFile, opened: Callable[[], pa.NativeFile], members: list[zipfile.ZipInfo], path: str) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for m in members:
            if m.compress_type != zipfile.ZIP_STORED:
                raise ValueError(f"{path}: {m.filename} is compressed")
            data, attempts, why = read_member(f, opened, m.header_offset, m.file_size, m.CRC, self.retries)
            if data is None and self.fail:
                raise OSError(f"{path} at {m.header_offset}: {why}")
            rows.append({"member": m.filename, "archive": path, "offset": m.header_offset, "media": data, "attempts": attempts, "error": why})
            held += m.file_size
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, READ_SCHEMA)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, READ_SCHEMA)


READ_SCHEMA = pa.schema([("member", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("attempts", pa.int32()), ("error", pa.string())])


class MediaArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``: one row per archive member.

    Options: ``rangeBytes`` (bytes planned for a task), ``retries`` (further
    attempts for a member) and ``onError``: ``fail``, or ``null`` for a row with
    a null payload and the error.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "member string, archive string, offset long, media binary, attempts int, error string"

    def reader(self, schema: StructType) -> MediaReader:
        return MediaReader({k.lower(): v for k, v in self.options.items()})


def read_media(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    ship(spark)
    spark.dataSource.register(MediaArchiveSource)
    return spark.read.format("media_archive").options(**options).load(folder)


def media_digests(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every whole text as an image, reads the images back and describes them.

    Returns one row per input row: the id column, ``n_bytes`` (UTF-8, unpadded),
    ``payload_bytes``, ``payload_sha256`` and ``tail_crc32`` of the bytes read
    back, ``media_bytes`` and ``media_sha256`` of the stored form, ``feature``.
    The archives stay in ``folder`` (by default a new one in the shared folder).

    A null text counts as empty: 64 bytes 0. Equal texts give equal values,
    repeated rows are members of their own, a null id stays null, an empty table
    gives an empty one. Other columns are ignored, whatever their names. A member
    that can't be read after its retries fails the job.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    written = write_media(docs, folder, id_col, text_col).agg(F.sum("members").alias("members")).first()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for member, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                label = unquote(member.rpartition("/")[2].removesuffix(".png"))
                samples, n = decode_png(media)
                payload = samples.tobytes()
                rows.append((label or None, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), DIGEST_TYPES, strict=True)] if rows else [pa.array([], t) for t in DIGEST_TYPES]
            yield pa.RecordBatch.from_arrays(columns, DIGEST_NAMES)

    if not written["members"]:
        return spark.createDataFrame([], f"`{id_col}` {kind}, " + ", ".join(f"{n} {t}" for n, t in zip(DIGEST_NAMES[1:], DIGEST_SQL[1:], strict=True)))
    found = read_media(spark, folder).select("member", "media").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(DIGEST_NAMES, DIGEST_SQL, strict=True)))
    return found.select(F.col("label").cast(kind).alias(id_col), *DIGEST_NAMES[1:])


DIGEST_NAMES = ["label", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
DIGEST_SQL = ["string", "long", "long", "string", "long", "long", "string", "string"]
DIGEST_TYPES = [{"string": pa.string(), "long": pa.int64()}[t] for t in DIGEST_SQL]
