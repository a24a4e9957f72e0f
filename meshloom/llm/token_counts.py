"""Token counts with a whole-token shortcut.

Before any text is read, every vocabulary string is encoded alone; those that
come out as one token are proven. A pre-token that is a proven string counts one
without any merging, and only the rest is merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Tokenizer, text_blocks
from .common import broadcast_file, ship, small


class ShortcutTokenizer(Tokenizer):
    """A tokenizer that knows which strings are one token."""

    def __init__(self, data: bytes):
        super().__init__(data)
        self.proven = self._prove()

    def _prove(self) -> dict[str, int]:
        """Each vocabulary string that, standing alone as a pre-token, encodes as just its own id."""
        suffix, words = self.merges.suffix, {}
        for i, raw in enumerate(self.token_bytes):
            if suffix and raw[-1:] == b" " and raw[:-1]:
                raw = raw[:-1]  # the mark of a word's end
            elif suffix:
                continue
            try:
                words[raw.decode()] = i
            except UnicodeDecodeError:
                continue
        words.pop("", None)
        ids, size = self.merges.encode([w.encode() for w in words])
        start = np.cumsum(size) - size
        return {w: i for (w, i), k, s in zip(words.items(), size.tolist(), start.tolist(), strict=True) if k == 1 and ids[s] == i}

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = np.fromiter((self.proven.get(w, -1) for w in words), np.int32, len(words))
        if (found >= 0).all():
            return found, np.ones(len(words), np.int64)
        rest = np.flatnonzero(found < 0)
        ids, size = self.merges.encode([words[i].encode() for i in rest.tolist()])
        per = np.ones(len(words), np.int64)
        per[rest] = size
        out = np.repeat(found, per)
        out[out < 0] = ids
        return out, per


@lru_cache(maxsize=2)
def shortcut_tokenizer(data: bytes) -> ShortcutTokenizer:
    return ShortcutTokenizer(data)


def token_counts(docs: DataFrame, vocab_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts the tokens of every whole text.

    Returns one row per input row: the id column, ``n_bytes`` (UTF-8),
    ``n_tokens`` (as the tokenizer file gives them, without added special
    tokens; special strings inside a text are one token) and ``over_limit``
    (``n_tokens > limit``). A narrow map without a shuffle.

    A null text counts as empty: 0 bytes, 0 tokens, not over the limit. Repeated
    rows give repeated results, a null id stays null, an empty table gives an
    empty one. Other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    held = broadcast_file(docs.sparkSession, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = shortcut_tokenizer(held.value)
        for batch in small(batches):
            texts = batch.column(1).to_pylist()
            n = np.zeros(len(texts), np.int64)
            for block in text_blocks(tok, texts):
                np.add.at(n, [i for i, *_ in block], tok.counts_of([t for *_, t in block]))
            size = [0 if t is None else len(t) if t.isascii() else len(t.encode()) for t in texts]
            columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_bytes", "n_tokens", "over_limit"])
        tok.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
