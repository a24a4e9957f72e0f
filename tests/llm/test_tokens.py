"""Operators 1, 3 and 8 against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import ODD, odd_documents
from tokenizers import Tokenizer as Library

from meshloom.llm import bpe, packing, queries
from meshloom.llm.bpe import Tokenizer, bpe_digests
from meshloom.llm.packing import class_of, pack_documents
from meshloom.llm.token_counts import ShortcutTokenizer, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LETTERS = [*"abzéÀñΣσİ 'sßſK\n\t\r\x1c\x1f\x85\xa0 　.,!12٣ⅷ%<>|日本語😀̱́H", "<|endoftext|>", "<|startoftext|>", " the", "'re", "  ", "\n\n", "'LL"]


@pytest.fixture(scope="module")
def libraries():
    return {p: Library.from_file(p) for p in (BYTE, WORD)}


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_random_texts_encode_as_the_library_does(libraries, path):
    rng = random.Random(3)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 50))) for _ in range(3000)] + [t or "" for _, t in ODD]
    for kind in (Tokenizer, ShortcutTokenizer):
        tok = kind(open(path, "rb").read())
        flat, per = tok.ids_of(texts)
        ends = np.cumsum(per)
        for text, a, b in zip(texts, ends - per, ends, strict=True):
            assert flat[a:b].tolist() == ids(libraries[path], text), text
            if path == BYTE:
                assert tok.decode(flat[a:b]) == libraries[path].decode(flat[a:b].tolist(), skip_special_tokens=False)
        assert tok.counts_of(texts).tolist() == per.tolist()


def test_merges_of_repeated_letters(libraries):
    tok = Tokenizer(open(BYTE, "rb").read())
    words = [c * n for c in "a=- " for n in range(1, 70)]
    flat, size = tok.merges.encode([w.encode().replace(b" ", "Ġ".encode()) for w in words if w[0] != " "])
    assert size.sum() == len(flat)
    for w in words:
        assert tok.ids_of([w])[0].tolist() == ids(libraries[BYTE], w)


def test_proven_strings_are_one_token(libraries):
    tok = ShortcutTokenizer(open(WORD, "rb").read())
    assert len(tok.proven) > 30_000
    for w in random.Random(1).sample(sorted(tok.proven), 500):
        if w.isalpha() and w.islower() and w.isascii():  # else the text isn't one pre-token
            assert ids(libraries[WORD], w) == [tok.proven[w]]


def test_long_texts_are_cut_between_words(monkeypatch, libraries):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    tok = Tokenizer(open(BYTE, "rb").read())
    text = "one two  three\n\n four <|endoftext|> five " * 20
    parts = list(tok.segments(text))
    assert len(parts) > 5 and "".join(parts) == text
    flat, per = tok.ids_of(parts)
    assert flat.tolist() == ids(libraries[BYTE], text)


def test_op1(spark, small, libraries):
    texts = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op1_bpe(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = ids(libraries[BYTE], texts[r["doc_id"]])
        text = libraries[BYTE].decode(own, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op1_odd(spark, libraries, monkeypatch):
    rows = bpe_digests(odd_documents(spark), BYTE, keep_ids=True).collect()
    assert sorted(map(repr, (r["doc_id"] for r in rows))) == sorted(map(repr, (i for i, _ in ODD)))
    by = {r["doc_id"]: r for r in rows}
    for i, t in ODD:
        assert by[i]["ids"] == ids(libraries[BYTE], t)
        assert by[i]["decoded"] == (t or "")
    assert by[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe_digests(odd_documents(spark, []), BYTE).count() == 0


def test_op8(spark, small, libraries):
    texts = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    for r in queries.op8_token_counts(spark, small).collect():
        n = len(ids(libraries[WORD], texts[r["doc_id"]]))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 2048)
    by = {r["doc_id"]: r for r in token_counts(odd_documents(spark), WORD).collect()}
    for i, t in ODD:
        assert (by[i]["n_tokens"], by[i]["n_bytes"]) == (len(ids(libraries[WORD], t)), len((t or "").encode()))
    assert token_counts(odd_documents(spark, []), WORD).count() == 0


def check_packing(rows, texts, library, capacity):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, text in texts.items():
        own, at = np.array([*ids(library, text), 2], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(own), zlib.crc32(own[at : at + r["length"]]))
            at += r["length"]
        assert at == len(own)
    padding = total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / total


def test_op3(spark, small, libraries):
    texts = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    assert check_packing(queries.op3_packing(spark, small).collect(), texts, libraries[WORD], 4096) < 0.01


def test_op3_odd(spark, libraries):
    table = odd_documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"]).repartition(3)
    rows = pack_documents(table, WORD, with_tokens=True).collect()
    check_packing(rows, {i: t for i, t in ODD if i is not None}, libraries[WORD], 4096)
    assert all(len(r["ids"]) == r["length"] for r in rows)
    twice = pack_documents(odd_documents(spark).where("doc_id = 5 or doc_id is null"), WORD).collect()
    assert sum(r["start"] == 0 for r in twice if r["doc_id"] == 5) == 2
    assert sum(r["doc_id"] is None for r in twice) >= 1
    assert pack_documents(odd_documents(spark, []), WORD).count() == 0


def test_harmonic_classes():
    assert [class_of(n, 4096) for n in (4096, 2049, 2048, 1366, 1365, 64, 63, 1)] == [1, 1, 2, 2, 3, 64, 64, 64]
    rng = np.random.default_rng(4)
    bins, sizes = packing.Bins(4096, 0), [*np.exp(rng.normal(6, 1.3, 3000)).astype(int) + 1, 1, 4096, 8192, 20_000]
    for i, n in enumerate(sizes):
        bins.add((i, n), 0, np.arange(n))
        assert len(bins.open) <= packing.LAST_CLASS and all(len(held) < k for k, held in bins.open.items())
    bins.close()
    # few documents are cut: no more cuts than there are sequences and longer documents ask for
    assert len(bins.placed) <= len(sizes) + bins.next_id + packing.LAST_CLASS
    filled = np.zeros(bins.next_id, int)
    for _, _, ids, sequence, _ in bins.placed:
        filled[sequence] += len(ids)
    assert filled.sum() == sum(sizes) and all(n == 4096 or n & (n - 1) == 0 for n in filled.tolist())
    with pytest.raises(ValueError):
        pack_documents(None, WORD, capacity=1000)
