"""Binary glTF containers read with byte expressions: a header, a JSON chunk, and the labels in it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.operators.labels import label_to_node

# Fixed values: "glTF", "JSON" and "BIN" as little-endian numbers, and the version that is read.
MAGIC, JSON_CHUNK, BINARY_CHUNK, VERSION = 0x46546C67, 0x4E4F534A, 0x004E4942, 2
HEADER, FIRST_CHUNK = 12, 20
DOCUMENT = "struct<nodes:array<struct<name:string,extras:struct<semanticLabel:string>>>,meshes:array<struct<name:string,extras:struct<semanticLabel:string>>>>"


def little_endian(content: Column, at: int) -> Column:
    """The unsigned 32-bit number at a byte, as a long."""
    byte = lambda i: F.conv(F.hex(F.substring(content, at + i + 1, 1)), 16, 10).cast("long")
    return byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216


def json_text(content: Column) -> Column:
    """The JSON chunk as far as the bytes hold it; a length that no file can have reads as no text."""
    length = F.coalesce(little_endian(content, HEADER).try_cast("int"), F.lit(0))
    return F.decode(F.substring(content, F.lit(FIRST_CHUNK + 1), length), "UTF-8")


def validate(content: Column) -> Column:
    """The first reason why the bytes are no container, or null."""
    size, chunk = F.length(content).cast("long"), little_endian(content, HEADER)
    return (
        F.when(content.isNull() | (size < HEADER), "too short")
        .when(little_endian(content, 0) != MAGIC, "bad magic")
        .when(little_endian(content, 4) != VERSION, "unsupported version")
        .when(little_endian(content, 8) != size, "length mismatch")
        .when(size < FIRST_CHUNK, "no chunk")
        .when(little_endian(content, 16) != JSON_CHUNK, "first chunk is not JSON")
        .when(chunk + FIRST_CHUNK > size, "chunk exceeds file")
        .when(F.try_parse_json(json_text(content)).isNull(), "broken JSON")
    )


def glb_validate(files: DataFrame) -> DataFrame:
    """``(file_id, valid, error)`` of ``(file_id, content)``."""
    return files.select("file_id", validate(F.col("content")).alias("error")).select("file_id", F.col("error").isNull().alias("valid"), "error")


def glb_labels(files: DataFrame) -> DataFrame:
    """(file_id, kind, position, name, label) of the labeled nodes and meshes of valid containers."""
    good = files.where(validate(F.col("content")).isNull()).select("file_id", F.from_json(json_text(F.col("content")), DOCUMENT).alias("d"))
    parts = [good.select("file_id", F.lit(k).alias("kind"), F.posexplode(f"d.{f}").alias("position", "p")) for k, f in (("node", "nodes"), ("mesh", "meshes"))]
    rows = parts[0].unionByName(parts[1]).select("file_id", "kind", "position", F.col("p.name").alias("name"), F.col("p.extras.semanticLabel").alias("label"))
    return rows.where("coalesce(label, '') <> ''")


def _named(files: DataFrame) -> DataFrame:
    """(file_id, kind, position, node_name) of the nodes and meshes of valid containers."""
    good = files.where(validate(F.col("content")).isNull()).select("file_id", F.from_json(json_text(F.col("content")), DOCUMENT).alias("d"))
    parts = [good.select("file_id", F.lit(k).alias("kind"), F.posexplode(f"d.{f}").alias("position", "p")) for k, f in (("node", "nodes"), ("mesh", "meshes"))]
    return parts[0].unionByName(parts[1]).select("file_id", "kind", "position", F.col("p.name").alias("node_name"))


def relabeled(content: bytes, labels: list[dict]) -> bytes:
    """The container with labels ``(kind, position, label)`` in the extras of its nodes and meshes; all else stays, in order.

    The JSON chunk is padded with blanks to a multiple of four bytes; its length and the
    file's are set anew, and the chunks behind it follow unchanged.
    """
    end = FIRST_CHUNK + int.from_bytes(content[HEADER : HEADER + 4], "little")
    document = json.loads(content[FIRST_CHUNK:end])
    for x in labels:
        part = document["nodes" if x["kind"] == "node" else "meshes"][x["position"]]
        extras = part.get("extras")
        part["extras"] = (extras if isinstance(extras, dict) else {}) | {"semanticLabel": x["label"]}
    body = json.dumps(document, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")
    body += b" " * (-len(body) % 4)
    number = lambda n: n.to_bytes(4, "little")
    return content[:8] + number(FIRST_CHUNK + len(body) + len(content) - end) + number(len(body)) + content[16:FIRST_CHUNK] + body + content[end:]


def glb_relabel(files: DataFrame, labels: DataFrame) -> DataFrame:
    """``(file_id, content)`` with the labels of ``label_to_node`` written into the containers.

    ``labels`` holds ``(model_id, label_key, label, label_order)``, where a model is a file.
    Names are matched by joins; a file's labels are as many as its nodes and meshes, and meet
    the file's bytes in a row. Containers that aren't valid, or have no match, stay as they are.
    """
    found = label_to_node(_named(files).withColumnRenamed("file_id", "model_id"), labels).where("label is not null")
    each = found.groupBy(F.col("model_id").alias("_file")).agg(F.collect_list(F.struct("kind", "position", "label")).alias("_labels"))
    joined = files.select("file_id", "content").join(each, files["file_id"] == each["_file"], "left").drop("_file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time: they may be large
                row = batch.slice(i, 1)
                told, content = row.column(2)[0].as_py(), row.column(1)
                if told:
                    content = pa.array([relabeled(content[0].as_py(), told)], content.type)
                yield pa.RecordBatch.from_arrays([row.column(0), content], ["file_id", "content"])

    kind = files.schema["file_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"file_id {kind}, content binary")


def build_glb(json: Column, binary: Column | None = None) -> Column:
    """A container that holds a JSON text, padded with blanks to a multiple of four bytes, and a binary chunk, padded with zeros, if any."""
    body = _padded(F.encode(json, "UTF-8"), "20")
    size = F.length(body).cast("long")

    def number(value: Column) -> Column:
        digits = F.lpad(F.hex(value), 8, "0")
        return F.unhex(F.concat(*(F.substring(digits, i, 2) for i in (7, 5, 3, 1))))

    fixed = lambda n: number(F.lit(n).cast("long"))
    rest, more = [], F.lit(0).cast("long")
    if binary is not None:
        data = _padded(binary, "00")
        more = F.length(data).cast("long")
        rest, more = [number(more), fixed(BINARY_CHUNK), data], more + 8
    return F.concat(fixed(MAGIC), fixed(VERSION), number(size + FIRST_CHUNK + more), number(size), fixed(JSON_CHUNK), body, *rest)


def _padded(data: Column, with_byte: str) -> Column:
    return F.concat(data, F.unhex(F.repeat(F.lit(with_byte), F.pmod(-F.length(data), F.lit(4)))))
