"""Harmonic packing of documents into fixed-length training sequences.

Documents are classed by their length: class ``k`` holds those of which ``k`` fit
into a sequence but not ``k + 1``, and each of its bins takes exactly ``k`` of them
whole. What a full bin leaves free is filled by the next document, which is cut
there; what is left of it is classed by its own length. So a bin has at most one
piece that is cut at its end, and no padding. Documents longer than a sequence
are cut into whole sequences first. Every worker fills its own bins, so nothing is
shuffled. Bins still open at a worker's end are laid end to end and cut at the
capacity and then at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import text_blocks, tokenizer
from .common import broadcast_file, ship, small

#: The last class; shorter documents belong to it, too.
LAST_CLASS = 64
#: Sequence ids of a worker follow its partition's number shifted by so many bits.
WORKER_SHIFT = 32


def class_of(length: int, capacity: int) -> int:
    """How many documents of this length (1 to capacity) a bin takes."""
    return min(capacity // length, LAST_CLASS)


class Bins:
    """The bins of one worker: takes documents and places their pieces."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        #: by class, the documents of the bin that is being filled
        self.open: dict[int, list[tuple[tuple, int, np.ndarray]]] = {}
        #: a bin with all its documents that isn't full, and the tokens in it
        self.gap: list[tuple[tuple, int, np.ndarray]] = []
        self.used = 0
        #: placed pieces: document, start, ids, sequence, offset
        self.placed: list[tuple[tuple, int, np.ndarray, int, int]] = []

    def _place(self, pieces: list[tuple[tuple, int, np.ndarray]]) -> None:
        offset = 0
        for doc, start, ids in pieces:
            self.placed.append((doc, start, ids, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc: tuple, start: int, ids: np.ndarray) -> None:
        """Takes ``ids``, which stand at ``start`` of the document."""
        while len(ids):
            room = self.capacity - self.used if self.gap else self.capacity
            if len(ids) >= room or self.gap:
                piece, ids = ids[:room], ids[room:]
                self.gap.append((doc, start, piece.copy()))
                self.used += len(piece)
                start += len(piece)
                if self.used == self.capacity:
                    self._place(self.gap)
                    self.gap, self.used = [], 0
                continue
            k = class_of(len(ids), self.capacity)
            held = self.open.setdefault(k, [])
            held.append((doc, start, ids.copy()))
            if len(held) == k:
                # with no gap open, this bin's is the one to be filled
                self.gap, self.used = self.open.pop(k), sum(len(p) for *_, p in held)
                if self.used == self.capacity:
                    self._place(self.gap)
                    self.gap, self.used = [], 0
            return

    def close(self) -> None:
        """Places what lies in open bins, end to end, in full sequences and then in powers of two."""
        rest = [*self.gap, *(x for _, held in sorted(self.open.items()) for x in held)]
        total = sum(len(p) for *_, p in rest)
        sizes = [self.capacity] * (total // self.capacity) + [1 << b for b in range(total.bit_length(), -1, -1) if (total % self.capacity) >> b & 1]
        sequence = room = size = 0
        for doc, start, ids in rest:
            while len(ids):
                if not room:
                    sequence, room = self.next_id, sizes.pop(0)
                    self.next_id += 1
                    size = room
                piece, ids = ids[:room], ids[room:]
                self.placed.append((doc, start, piece, sequence, size - room))
                start, room = start + len(piece), room - len(piece)
        self.open.clear()
        self.gap, self.used = [], 0


def pack_documents(
    docs: DataFrame,
    vocab_path: str,
    capacity: int = 4096,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_tokens: bool = False,
) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens.

    A document is its text's ids (without special tokens) and then ``end_id``.
    Returns one row per piece: the id column, ``start`` (ids of the document
    before the piece), ``length``, ``ids_crc32`` (of the little-endian unsigned
    32-bit ids), ``doc_tokens``, ``sequence_id`` and ``offset`` (place in the
    sequence, gapless from 0); with ``with_tokens`` also ``ids``. Each id lies in
    exactly one piece. A sequence holds ``capacity`` tokens, or a power of two of
    them, without padding.

    A narrow map: each partition fills its own bins, its open ones bounded by one
    bin a class and one with a gap. ``capacity`` must be a power of two. A null or empty text is
    packed as its end id alone. Repeated rows are packed each for itself, with
    the same id; a null id stays null; an empty table gives an empty one. Other
    columns are ignored, whatever their names.
    """
    if capacity & (capacity - 1) or capacity < LAST_CLASS:
        raise ValueError(f"capacity must be a power of two of at least {LAST_CLASS}")
    ship(docs.sparkSession)
    held = broadcast_file(docs.sparkSession, vocab_path)
    kind = docs.schema[id_col].dataType
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_tokens]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(held.value)
        bins = Bins(capacity, TaskContext.get().partitionId() << WORKER_SHIFT)
        end = np.array([end_id], "<u4")

        def placed() -> pa.RecordBatch:
            rows, bins.placed = bins.placed, []
            columns = [
                pa.array([r[0][0] for r in rows], id_type[0]),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([len(r[2]) for r in rows], pa.int64()),
                pa.array([zlib.crc32(r[2]) for r in rows], pa.int64()),
                pa.array([r[0][1] for r in rows], pa.int64()),
                pa.array([r[3] for r in rows], pa.int64()),
                pa.array([r[4] for r in rows], pa.int64()),
            ]
            if with_tokens:
                columns.append(pa.array([r[2].astype(np.int64) for r in rows], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(columns, names)

        id_type = [pa.int64()]
        for batch in small(batches):
            id_type[0] = batch.schema.field(0).type
            doc_ids = batch.column(0).to_pylist()
            parts: list[np.ndarray] = []
            for block in text_blocks(tok, batch.column(1).to_pylist()):
                ids, per = tok.ids_of([t for *_, t in block])
                ids, at = ids.astype("<u4"), 0
                for (i, last, _), n in zip(block, per.tolist(), strict=True):
                    parts.append(ids[at : at + n])
                    at += n
                    if last:
                        own = np.concatenate([*parts, end])
                        bins.add((doc_ids[i], len(own)), 0, own)
                        parts = []
                yield placed()
        tok.forget()
        bins.close()
        yield placed()

    schema = f"`{id_col}` {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_tokens
    return docs.select(id_col, text_col).mapInArrow(run, schema)
