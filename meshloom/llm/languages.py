"""Language identification by multilingual mixture inference.

Each language has a distribution over hashed character trigrams, so every word
has a likelihood in every language. A document is a mixture of languages: its
proportions are estimated by expectation-maximisation over its words, and the set
of languages is the one whose likelihood, less a penalty for each language, is
greatest. Sets grow by the language of the next greatest proportion for as long as
that gains.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import blocks, crc_mod, pieces, ragged, ship, small

UNKNOWN = "und"
#: Ids' hashes that decide which documents are learnt from.
HASHES = 1 << 62
#: Hash buckets of trigrams.
BITS = 14
#: Labelled documents that a language is learnt from: about so many at most.
SAMPLE = 3000
#: Languages that sets of every document are tried with, and rounds of estimation.
TRIED, ROUNDS = 3, 8
#: Penalty for each language beyond the first, in units of the logarithm of the number of words.
PENALTY = 2.0
#: Nats a word's likelihood may differ by between languages: one odd word can't decide alone.
CLIP = 12.0
CACHE_WORDS = 200_000
#: Numbers that a worker keeps of words seen before, and handles at once, about.
CACHE_NUMBERS, BLOCK_NUMBERS = 1 << 22, 1 << 21
BLOCK_CHARS = 1 << 19
_WORD = re.compile(r"[^\W\d_]+").findall


def trigram_buckets(word: str) -> list[int]:
    padded = f"\x02{word}\x03"
    return [xxhash.xxh32_intdigest(padded[i : i + 3]) >> (32 - BITS) for i in range(len(padded) - 2)]


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; runs of mere number signs such as ``²`` are none."""
    return [w for w in _WORD(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


@dataclass
class LanguageModel:
    languages: list[str]
    #: log-probability of each trigram bucket (rows) in each language (columns)
    log_p: np.ndarray


class Identifier:
    """Applies a model to blocks of texts; words seen before are looked up."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.languages)), np.float32)

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of every word in every language, less that of its best one."""
        if len(self.place) > min(CACHE_WORDS, CACHE_NUMBERS // len(self.model.languages)):
            self._forget()
        new = list(set(words).difference(self.place))
        if new:
            grams = [trigram_buckets(w) for w in new]
            size = np.fromiter(map(len, grams), np.int64, len(grams))
            flat = np.fromiter((g for gs in grams for g in gs), np.int64, int(size.sum()))
            rows = np.add.reduceat(self.model.log_p[flat], np.cumsum(size) - size, axis=0)
            rows = np.maximum(rows - rows.max(1, keepdims=True), -CLIP).astype(np.float32)
            self.place.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, rows])
        return self.rows[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]

    def mixtures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of the languages in each text (zero outside the chosen set), and its number of words."""
        counts: list[Counter[str]] = []
        for t in texts:
            counts.append(Counter())
            for piece in pieces(t):
                counts[-1].update(words_of(piece))
        n = np.fromiter((c.total() for c in counts), np.int64, len(counts))
        different = np.fromiter(map(len, counts), np.int64, len(counts))
        out = np.zeros((len(texts), len(self.model.languages)))
        full = np.flatnonzero(n)
        # so many texts at once that their words' numbers take bounded room, but for a single text
        upto = np.cumsum(different[full]) * len(self.model.languages) // BLOCK_NUMBERS
        for part in np.split(full, np.flatnonzero(np.diff(upto)) + 1):
            if len(part):
                rows = self.word_rows([w for i in part.tolist() for w in counts[i]])
                times = np.fromiter((k for i in part.tolist() for k in counts[i].values()), np.float32, len(rows))
                out[part] = choose_sets(rows, different[part], times)
        return out, n


def estimate(likelihood: np.ndarray, size: np.ndarray, share: np.ndarray, times: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text after ``rounds`` rounds from ``share``, and its log-likelihood with them; a word counts so many ``times``."""
    start, doc = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    n = np.add.reduceat(times, start, dtype=np.float64)[:, None]
    for _ in range(rounds):
        part = likelihood * share[doc]
        part *= (times / np.maximum(part.sum(1), 1e-30))[:, None]
        share = (np.add.reduceat(part, start, axis=0) / n).astype(np.float32)
    total = times * np.log(np.maximum((likelihood * share[doc]).sum(1), 1e-30))
    return share, np.add.reduceat(total, start)


def choose_sets(rows: np.ndarray, size: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Proportions within the best set of languages for each text of ``size`` different words.

    Candidate sets are the k languages with the greatest proportions: for k up to
    TRIED, and on as long as one more language gains. Ties go to the language that
    comes first.
    """
    n_docs, n_lang = len(size), rows.shape[1]
    likelihood, start = np.exp(rows), np.cumsum(size) - size
    n = np.add.reduceat(times, start, dtype=np.float64)
    share, _ = estimate(likelihood, size, np.full((n_docs, n_lang), 1 / n_lang, np.float32), times)
    order = np.argsort(-share, axis=1, kind="stable")
    single = np.add.reduceat(rows * times[:, None], start, axis=0, dtype=np.float64)
    top = single.argmax(1)
    best = np.zeros((n_docs, n_lang))
    best[np.arange(n_docs), top] = 1
    best_value = single[np.arange(n_docs), top]
    left = np.arange(n_docs)
    for k in range(2, n_lang + 1):
        word = ragged(np.arange(len(rows)), start[left], size[left])
        chosen = np.zeros((len(left), n_lang), np.float32)
        np.put_along_axis(chosen, order[left, :k], 1, axis=1)
        within, value = estimate(likelihood[word], size[left], share[left] * chosen + chosen * np.float32(1e-3), times[word], ROUNDS // 2)
        value = value - PENALTY * (k - 1) * np.log(n[left] + 1.0)
        better = value > best_value[left]
        best[left[better]], best_value[left[better]] = within[better], value[better]
        if k >= TRIED:
            left = left[better]
        if not len(left):
            break
    return best


def hash_limit(n: int, sample: int) -> int:
    """The hashes below which about ``sample`` of ``n`` ids lie; for few ids all do."""
    return min(HASHES, HASHES * sample // max(n, 1))


def train_languages(docs: DataFrame, held_out: int | None = 2, folds: int = 4, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Counts trigrams of the labelled documents outside fold ``held_out`` (None: of all).

    Of a language with more than ``sample`` documents, those are taken whose
    hashed id is below ``sample`` / their number: about ``sample``. Counts are summed
    by Spark; the driver gets one number for each language and bucket, and the
    model holds 64 KB for each language.
    """
    ship(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    if held_out is not None:
        rows = rows.where(crc_mod(F.col(id_col), folds) != held_out)
    counts = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy("lang").collect()
    languages = [r["lang"] for r in counts]
    if not languages:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32))
    number = {lang: i for i, lang in enumerate(languages)}
    below = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], hash_limit(r["n"], sample))))
    taken = rows.where(F.xxhash64(id_col).bitwiseAND(HASHES - 1) < below[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), 1 << BITS), np.int64)
        known: dict[str, list[int]] = {}
        for batch in small(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece in pieces(text):
                    flat: list[int] = []
                    for w in words_of(piece):
                        if w not in known:
                            if len(known) > CACHE_WORDS:
                                known.clear()
                            known[w] = trigram_buckets(w)
                        flat += known[w]
                    if flat:
                        total[number[lang]] += np.bincount(flat, minlength=1 << BITS)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket), pa.array(total[lang, bucket])], ["lang", "bucket", "n"])

    found = taken.mapInArrow(run, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.full((1 << BITS, len(languages)), 0.5)
    total[found["bucket"].to_numpy(), found["lang"].to_numpy()] += found["n"].to_numpy()
    return LanguageModel(languages, np.log(total / total.sum(0)).astype(np.float32))


def add_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language of the greatest proportion in each whole text, and that proportion (a narrow map)."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS numbers for each language
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(held.value)
        for batch in small(batches):
            lang, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if held.value.languages:
                for block in blocks(((i, t or "") for i, t in enumerate(batch.column(at).to_pylist())), BLOCK_CHARS):
                    share, n = identifier.mixtures([t for _, t in block])
                    for (i, _), best, of, words in zip(block, share.argmax(1).tolist(), share.max(1).tolist(), n.tolist(), strict=True):
                        if words:
                            lang[i], score[i] = held.value.languages[best], min(1.0, of)
            yield batch.append_column(names[0], pa.array(lang, pa.string())).append_column(names[1], pa.array(score))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the languages outside fold 2 of 4 and identifies every document's.

    Returns one row per input row: the id column, ``held_out`` (crc32 of the id
    as text, modulo 4, is 2), ``lang_pred`` (a learnt language, ``und`` for a null
    text, one without letters, or where nothing was learnt) and ``score`` (the
    language's share of the text, 0 for ``und``). A null id is not held out.
    Repeated rows give repeated results, an empty table gives an empty one. Other
    columns are ignored, whatever their names.
    """
    model = train_languages(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    found = add_languages(docs.select(id_col, text_col), model, text_col)
    held = F.coalesce(crc_mod(F.col(id_col), 4) == 2, F.lit(False)).alias("held_out")
    return found.select(id_col, held, "lang_pred", "score")
