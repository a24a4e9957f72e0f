"""Byte-pair encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. Pairs of neighbours are looked
up by binary search among the sorted pair keys of the merge list; each round
replaces, in every word at once, all places of the word's lowest-ranked pair.
Only pairs beside a replaced one are looked up again.

Texts are cut at spaces into chunks that the tokenizer's own pattern never
crosses; Arrow numbers the distinct chunks of a block. A chunk's ids are kept
per worker, so only chunks that are new there are merged.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import blocks, broadcast_file, ragged, ship, small

#: Unicode's White_Space, as a class of characters.
WS = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACES = frozenset(["", *re.findall(f"[{WS}]", "".join(map(chr, range(0x3001))))])
#: Marks that no token shares with a letter before them.
MARKS = frozenset(".,;:!?")
NO_MERGE = np.int32(2**31 - 1)
#: Characters that are handled at once; bounds the size of the flat arrays.
BLOCK_CHARS = 4 << 20
#: Chunks that a worker keeps.
CACHE_CHUNKS = 250_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable in Latin-1, else the next free one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Merges:
    """A merge list as sorted pair keys, and the rounds that apply it."""

    def __init__(self, model: dict):
        vocab: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.suffix, self.width = suffix, 1 + max(vocab.values())
        self.first = np.array([vocab.get(c, -1) for c in letters], np.int32)
        self.last = np.array([vocab.get(c + suffix, -1) for c in letters], np.int32)
        if min(self.first.min(), self.last.min()) < 0:
            raise ValueError("the vocabulary lacks single bytes; it isn't byte-level BPE")
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)

        byte = np.arange(256)
        #: ranks of two bytes side by side: inside a word, and at its end
        self.inner = self._rank(self.first[byte[:, None]], self.first[byte[None, :]])
        self.final = self._rank(self.first[byte[:, None]], self.last[byte[None, :]])

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_MERGE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all (non-empty) words in one array, and the number of ids of each word."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        if not n:
            return np.zeros(0, np.int32), size
        raw = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum(size) - 1
        sym, word = self.first[raw], np.repeat(np.arange(n, dtype=np.int32), size)
        sym[end] = self.last[raw[end]]
        rank = np.empty(len(sym), np.int32)
        rank[:-1] = self.inner[raw[:-1], raw[1:]]
        rank[end] = NO_MERGE
        more = end[size > 1]
        rank[more - 1] = self.final[raw[more - 1], raw[more]]
        start = end - size + 1
        out_sym, out_word = [], []
        while len(sym):
            best = np.minimum.reduceat(rank, start)
            lowest = np.repeat(best, np.diff(start, append=len(sym)))
            at = np.flatnonzero((rank == lowest) & (rank != NO_MERGE))
            if len(at):
                # a symbol belongs to one pair: of overlapping places, take every other from the left
                close = np.flatnonzero(np.diff(at) == 1)
                if len(close):
                    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
                    at = at[(np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))) % 2 == 0]
                sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            to = at - np.arange(len(at))  # each earlier place has lost one symbol
            sym, word, rank = sym[keep], word[keep], rank[keep]
            stale = np.concatenate([to, to[to > 0] - 1])
            rank[stale] = NO_MERGE
            stale = stale[stale + 1 < len(sym)]
            stale = stale[word[stale] == word[stale + 1]]
            rank[stale] = self._rank(sym[stale], sym[stale + 1])
            start = np.flatnonzero(np.diff(word, prepend=-1))
            ended = np.minimum.reduceat(rank, start) == NO_MERGE
            if 4 * np.count_nonzero(ended) > len(ended) or not len(at):  # else finished words wait for others
                done = np.repeat(ended, np.diff(start, append=len(sym)))
                out_sym.append(sym[done])
                out_word.append(word[done])
                sym, word, rank = sym[~done], word[~done], rank[~done]
                start = np.flatnonzero(np.diff(word, prepend=-1))
        sym, word = np.concatenate(out_sym), np.concatenate(out_word)
        return sym[np.argsort(word, kind="stable")].astype(np.int32), np.bincount(word, minlength=n)


class Tokenizer:
    """A tokenizer file of byte-level BPE: with spaces kept, or lower-cased with word ends.

    ``ids_of`` gives the ids of blocks of texts, ``counts_of`` only their numbers.
    """

    def __init__(self, data: bytes):
        spec = json.loads(data)
        self.merges = Merges(spec["model"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        pre = spec["pre_tokenizer"]
        self.words = pre["type"] == "Sequence"
        if self.words:
            # white space is dropped, so a chunk is what stands between white space
            self._pretokens = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"])
            self._find = re.compile(f"[^{WS}]+").findall
        else:
            # the pattern that byte-level pre-tokenizers have built in
            self._pretokens = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
            self._find = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+").findall
        self._cut = re.compile(f"(?<=[^{WS}])(?= [^{WS}])")
        vocab = spec["model"]["vocab"]
        by_letter = {c: b for b, c in enumerate(byte_letters())}
        texts = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in vocab.items():
            body = t.removesuffix(self.merges.suffix) if self.merges.suffix else t
            texts[i] = bytes(map(by_letter.__getitem__, body)) + b" " * (self.merges.suffix != "" and body != t)
        for t, i in self.special.items():
            texts[i] = t.encode()
        self.token_bytes = texts
        self.text_flat, self.text_start, self.text_size = _ragged_of(texts)
        self.dec_flat, self.dec_start, self.dec_size = _ragged_of([b"%d," % i for i in range(len(texts))])
        self.forget()

    def forget(self) -> None:
        """Drops the chunks that are kept; a task does so at its end, as its worker goes on to other work."""
        self._slot: dict[str, int] = {}
        self._ids, self._start, self._size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def normal(self, chunk: str) -> str:
        """A chunk as the file's normalizer leaves it."""
        if not self.words:
            return chunk
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")  # letter by letter: no final sigma
        return chunk.lower()

    def _split(self, chunks: list[str]) -> tuple[list[str], list[int]]:
        """The pre-tokens of all chunks in one list, and their number in each chunk."""
        flat, per, skip = [], [], not self.words
        for c in chunks:
            if c in self.special:
                flat.append(c)
                per.append(1)
                continue
            c = self.normal(c)
            body = c[1:] if skip and c[:1] == " " else c
            if body.isalpha():  # most chunks are a word, or one with a mark at its end
                flat.append(c)
                per.append(1)
            elif body[-1:] in MARKS and body[:-1].isalpha():
                flat += (c[:-1], c[-1])
                per.append(2)
            else:
                found = self._pretokens.findall(c)
                flat += found
                per.append(len(found))
        return flat, per

    def segments(self, text: str) -> Iterator[str]:
        """The text in parts of about BLOCK_CHARS that are encoded independently."""
        at = 0
        while len(text) - at > BLOCK_CHARS:
            m = self._cut.search(text, at + BLOCK_CHARS)
            if m is None:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def chunks(self, text: str) -> list[str]:
        """Chunks of a text; special strings are chunks of their own."""
        out, at = [], 0
        for m in self._special.finditer(text):
            out += self._find(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._find(text[at:])

    def _slots(self, chunks: list[str]) -> np.ndarray:
        """The place of each chunk among those kept; new ones are encoded first."""
        if len(self._slot) > CACHE_CHUNKS:
            self.forget()
        slots = list(map(self._slot.get, chunks))
        if None in slots:
            new = list(dict.fromkeys(c for c, k in zip(chunks, slots, strict=True) if k is None))
            flat, per = self._split(new)
            place = {p: i for i, p in enumerate(dict.fromkeys(flat))}
            words = [p for p in place if p not in self.special]
            ids, size = self.encode_words(words)
            if len(words) < len(place):
                ids, size = self._with_special(list(place), ids, size)
            start = np.cumsum(size) - size
            at = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
            of_chunk = _sum_per(size[at], np.array(per, np.int64))
            ids = ragged(ids, start[at], size[at])
            begin = len(self._ids) + np.cumsum(of_chunk) - of_chunk
            self._slot.update(zip(new, range(len(self._size), len(self._size) + len(new)), strict=True))
            self._ids = np.concatenate([self._ids, ids])
            self._start, self._size = np.concatenate([self._start, begin]), np.concatenate([self._size, of_chunk])
            slots = map(self._slot.__getitem__, chunks)
        return np.fromiter(slots, np.int64, len(chunks))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.merges.encode([w.encode() for w in words])

    def _with_special(self, tokens: list[str], ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts, start, k = [], np.cumsum(size) - size, 0
        for t in tokens:
            if t in self.special:
                parts.append(np.array([self.special[t]], np.int32))
            else:
                parts.append(ids[start[k] : start[k] + size[k]])
                k += 1
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def _per_text(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The slots of all chunks of all texts, and the number of chunks of each text."""
        column = pa.array(texts, pa.large_string())
        if self.words:
            column = pc.replace_substring(column, "\n", " ")
        split = pc.split_pattern(column, " ")
        per = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        code, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        odd = {i: self.chunks(t) for i, t in enumerate(texts) if "<" in t and self._special.search(t)}
        pieces, opening, first = distinct, [], None
        if not self.words:
            odd |= {i: self.chunks(texts[i]) for i in self._uncut(code, distinct, per) if i not in odd}
            # every piece but a text's first has a space before it
            first = (np.cumsum(per) - per)[per > 0]
            pieces, opening = [" " + c for c in distinct], [distinct[k] for k in code[first].tolist()]
        rest = [c for i in sorted(odd) for c in odd[i]]
        found = self._slots([*pieces, *opening, *rest])
        slot = found[code]
        if first is not None:
            slot[first] = found[len(pieces) : len(pieces) + len(first)]
        if odd:
            parts, at, k = [], 0, len(found) - len(rest)
            for i, n in enumerate(per.tolist()):
                if i in odd:
                    per[i] = len(odd[i])
                    parts.append(found[k : k + per[i]])
                    k += per[i]
                else:
                    parts.append(slot[at : at + n])
                at += n
            slot = np.concatenate(parts)
        return slot, per

    def _uncut(self, code: np.ndarray, distinct: list[str], per: np.ndarray) -> list[int]:
        """The texts with a space that white space (or the text's end) surrounds: they may not be cut at every space."""
        opens = np.fromiter((c[:1] in SPACES for c in distinct), bool, len(distinct))[code]  # an empty piece too
        ends = np.fromiter((c[-1:] in SPACES for c in distinct), bool, len(distinct))[code]
        bad = np.zeros(len(code), bool)
        bad[:-1] = ends[:-1] & opens[1:]
        bad[np.cumsum(per)[per > 0] - 1] = False  # no space follows a text's last piece
        return np.flatnonzero(_sum_per(bad, per)).tolist()

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number of ids of each text."""
        slot, per = self._per_text(texts)
        size = self._size[slot]
        return ragged(self._ids, self._start[slot], size), _sum_per(size, per)

    def counts_of(self, texts: list[str]) -> np.ndarray:
        slot, per = self._per_text(texts)
        return _sum_per(self._size[slot], per)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special ones included; broken UTF-8 becomes U+FFFD."""
        ids = np.asarray(ids, np.int64)
        return ragged(self.text_flat, self.text_start[ids], self.text_size[ids]).tobytes().decode("utf-8", "replace")


def _sum_per(values: np.ndarray, per: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values)]
    end = np.cumsum(per)
    return total[end] - total[end - per]


def _ragged_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size


@lru_cache(maxsize=2)
def tokenizer(data: bytes) -> Tokenizer:
    """One tokenizer per worker process and file."""
    return Tokenizer(data)


def text_blocks(tok: Tokenizer, texts: Iterable[str | None], size: int = BLOCK_CHARS) -> Iterator[list[tuple[int, bool, str]]]:
    """Blocks of (index of the text, is it the text's last part, part)."""

    def parts():
        for i, t in enumerate(texts):
            held = None
            for s in tok.segments(t or ""):
                if held is not None:
                    yield i, False, held
                held = s
            yield i, True, held

    return blocks(parts(), size)


def bpe_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns one row per input row: the id column, ``n_tokens``, ``ids_sha256``
    (lowercase hex of the decimal ids joined by commas), ``decoded_sha256`` (of
    the decoded text in UTF-8), and with ``keep_ids`` the ids and the decoded
    text themselves. A narrow map: no shuffle, and memory is bounded by
    BLOCK_CHARS (with ``keep_ids``, by the rows of an Arrow batch).

    A null text counts as empty: 0 tokens and the digests of nothing. Repeated
    rows give repeated results; a null id stays null; an empty table gives an
    empty one. Other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    held = broadcast_file(docs.sparkSession, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(held.value)
        for batch in small(batches):
            n, ids_hex, text_hex, all_ids, all_texts = [], [], [], [], []
            count, of_ids, of_text, first = 0, hashlib.sha256(), hashlib.sha256(), True
            kept: list[np.ndarray] = []
            for block in text_blocks(tok, batch.column(1).to_pylist()):
                ids, per = tok.ids_of([t for *_, t in block])
                dec_size, text_size = tok.dec_size[ids], tok.text_size[ids]
                dec = ragged(tok.dec_flat, tok.dec_start[ids], dec_size).tobytes()
                text = ragged(tok.text_flat, tok.text_start[ids], text_size).tobytes()
                dec_end, text_end = np.cumsum(_sum_per(dec_size, per)).tolist(), np.cumsum(_sum_per(text_size, per)).tolist()
                a = b = at = 0
                for (_, last, _), c, d, e in zip(block, per.tolist(), dec_end, text_end, strict=True):
                    if d > a:
                        of_ids.update((b"" if first else b",") + dec[a : d - 1])
                        first = False
                    raw = text[b:e]
                    # parts end before a space, never inside a character
                    of_text.update(raw.decode("utf-8", "replace").encode())
                    if keep_ids:
                        kept.append(ids[at : at + c])
                    count, a, b, at = count + c, d, e, at + c
                    if last:
                        n.append(count)
                        ids_hex.append(of_ids.hexdigest())
                        text_hex.append(of_text.hexdigest())
                        if keep_ids:
                            own = np.concatenate(kept)
                            all_ids.append(own)
                            all_texts.append(tok.decode(own))
                            kept = []
                        count, of_ids, of_text, first = 0, hashlib.sha256(), hashlib.sha256(), True
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)
        tok.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)
