"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every token is predicted from the ``WINDOW`` tokens on both sides of it, as if it
were masked: their embeddings, weighted by place, are summed to a hidden vector,
which predicts the token's class and then the token within its class. A word
outside the vocabulary is predicted as one of a few kinds of rare words, and its
probability is that of the kind times the word's share in it. The sum of the
log-probabilities of all tokens is the document's score.

Texts are read once: stretches between white space are numbered within blocks of
texts, and their tokens are counted over the whole corpus. With the vocabulary, a
block's stretches are cut and encoded once each, and its texts follow. The network is trained on every token: documents are dealt by hash to shards of
about ``SHARD_TOKENS`` and to ``ROUNDS`` rounds. In each round every shard goes
on from the mean of the last one, and Spark sums the shards' numbers, weighted by
their tokens, in the order of the shards. So the result doesn't depend on how the
table is split.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, pieces, ragged, shared_dir, ship, small, sum_runs

#: Classes, and tokens in a class. Token 0 stands outside a text, tokens below RARE for kinds of words outside the vocabulary.
CLASSES = 64
SIZE = CLASSES * CLASSES
RARE = 256
#: Cells that the words of a rare kind are counted in, by hash: words that share a cell share its probability.
CELLS = 1 << 14
WIDTH, WINDOW = 24, 3
BATCH, RATE, SEED = 8192, 0.25, 11
#: Tokens beside each other that are trained on in one step: their neighbours are looked up once.
RUN = 16
#: Tokens that one network is trained on, about, and the rounds of averaging that they are dealt to.
SHARD_TOKENS, ROUNDS = 2 << 20, 3
#: Parts that a network's numbers are summed in, and networks that are summed at once.
SLICES, FAN = 16, 64
#: Words whose numbers a worker keeps.
CACHE_WORDS = 200_000
#: Words that a counting task holds before it hands them on.
COUNT_WORDS = 400_000
#: Different stretches of a block of texts; the text that exceeds them is its last.
BLOCK_WORDS = 60_000
#: Counts in a row, and the bytes of a block table's row groups, which are read at once.
COUNT_ROW, GROUP_BYTES = 10_000, 16 << 20
#: Tokens that are scored at once.
SCORED = 1 << 13
#: Rows whose logits are worked on while they are in the processor's cache.
NEAR_ROWS = 2048
_TOKEN = re.compile(r"\w+|[^\w\s]+").findall
STEPS = np.array([*range(-WINDOW, 0), *range(1, WINDOW + 1)])


def tokens_of(text: str) -> list[str]:
    return _TOKEN(text.lower())


def tokens_in(stretch: str) -> list[str]:
    """The tokens of a lower-case stretch between white space; no token of a text crosses one."""
    return [stretch] if stretch.isalnum() else _TOKEN(stretch)


def rare_id(token: str) -> int:
    """One of the numbers 1 to RARE - 1 for a word outside the vocabulary."""
    return 1 + zlib.crc32(token[-3:].encode()) % (RARE - 1)


class _Codes(dict):
    """Codes of words; those of rare words are found when they are asked for, and some are kept."""

    def __missing__(self, token: str) -> int:
        found = zlib.crc32(token.encode()) % CELLS * SIZE + rare_id(token)
        if len(self) < CACHE_WORDS:
            self[token] = found
        return found


class Vocabulary:
    """Numbers of tokens: the commonest words in order, the rest by a hash of their last letters.

    A code is a token's number and, above that, the cell of a rare word.
    ``shares`` are the logarithms of the cells' shares in their kinds.
    """

    def __init__(self, words: list[str], shares: np.ndarray | None = None):
        self.words = words[: SIZE - RARE]
        self.shares = np.full(RARE * CELLS, -np.log(CELLS), np.float32) if shares is None else shares
        self._codes = None

    def __getstate__(self) -> dict:
        return {"words": self.words, "shares": self.shares, "_codes": None}

    def codes(self, tokens: list[str]) -> np.ndarray:
        if self._codes is None:
            self._codes = _Codes((w, RARE + i) for i, w in enumerate(self.words))
        return np.fromiter(map(self._codes.__getitem__, tokens), np.int64, len(tokens))

    def encoded(self, text: str | None) -> tuple[np.ndarray, float]:
        """The numbers of a text's tokens, and the sum of its rare words' shares; long texts are handled in pieces."""
        code = np.concatenate([np.zeros(0, np.int64), *(self.codes(tokens_of(p)) for p in pieces(text or ""))])
        ids, cell = code % SIZE, code // SIZE
        rare = ids < RARE
        return ids.astype(np.uint16), float(self.shares[ids[rare] * CELLS + cell[rare]].sum(dtype=np.float64))

    def encoded_block(self, words: list[str], numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``encoded`` for texts of ``sizes`` stretches each, given by their numbers in ``words``: all ids, how many a text has, and the sums."""
        cut = [tokens_in(w) for w in words]
        size = np.fromiter(map(len, cut), np.int64, len(cut))
        code = self.codes(list(chain.from_iterable(cut)))
        ids, cell = code % SIZE, code // SIZE
        share = np.where(ids < RARE, self.shares[np.where(ids < RARE, ids * CELLS + cell, 0)], 0).astype(np.float64)
        share, start = sum_runs(share, size), np.cumsum(size) - size
        sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=share[numbers], minlength=len(sizes))
        return ragged(ids.astype(np.uint16), start[numbers], size[numbers]), sum_runs(size[numbers], sizes), sums


@dataclass
class WindowNetwork:
    """The numbers of the network, in this order in ``flat``."""

    embed: np.ndarray  # SIZE x WIDTH
    place: np.ndarray  # 2 WINDOW x WIDTH
    bias: np.ndarray  # WIDTH
    classes: np.ndarray  # WIDTH x CLASSES
    class_bias: np.ndarray  # CLASSES
    words: np.ndarray  # CLASSES x WIDTH x CLASSES
    word_bias: np.ndarray  # CLASSES x CLASSES

    SHAPES = ((SIZE, WIDTH), (2 * WINDOW, WIDTH), (WIDTH,), (WIDTH, CLASSES), (CLASSES,), (CLASSES, WIDTH, CLASSES), (CLASSES, CLASSES))

    @classmethod
    def fresh(cls) -> WindowNetwork:
        rng = np.random.default_rng(SEED)
        arrays = [(rng.standard_normal(s) * 0.1).astype(np.float32) for s in cls.SHAPES]
        arrays[1] += 1 / (2 * WINDOW)
        return cls(*arrays)

    @classmethod
    def of(cls, flat: np.ndarray) -> WindowNetwork:
        sizes = [int(np.prod(s)) for s in cls.SHAPES]
        return cls(*(p.reshape(s).astype(np.float32) for p, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), cls.SHAPES, strict=True)))

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.place, self.bias, self.classes, self.class_bias, self.words, self.word_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def stacked(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights with their biases as a last row: WIDTH + 1 x CLASSES, and as much for each class."""
        return np.concatenate([self.classes, self.class_bias[None]]), np.concatenate([self.words, self.word_bias[:, None]], axis=1)


def bound_of(weights: np.ndarray) -> float:
    """The largest logit that stacked weights and a hidden vector, whose numbers lie between -1 and 1, can lead to."""
    return float(np.abs(weights).sum(-2).max())


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another with WINDOW zeros around each, and the places of their tokens."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.arange(size.sum()) + WINDOW * (1 + np.repeat(np.arange(len(texts)), size))
    flat = np.zeros(size.sum() + WINDOW * (1 + len(texts)), np.int32)
    if len(at):
        flat[at] = np.concatenate(texts)
    return flat, at


def by_class(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of the places ``at`` by the class of their token, and the classes and words in it, and where each class begins."""
    kind = (flat[at] // CLASSES).astype(np.uint8)
    order = np.argsort(kind, kind="stable")
    return order, kind[order].astype(np.int64), flat[at][order] % CLASSES, np.r_[0, np.cumsum(np.bincount(kind, minlength=CLASSES))]


class Room:
    """Large arrays that are made once, by name; a shape is a part of what is there."""

    def __init__(self) -> None:
        self._space: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self._space or len(self._space[name]) < size:
            self._space[name] = np.empty(size, np.float32)
        return self._space[name][:size].reshape(shape)


def stretches_around(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places within WINDOW of some different places, as stretches one after another, and where each of ``at`` lies in them."""
    order = np.argsort(at)
    own = at[order]
    first = np.flatnonzero(np.diff(own, prepend=own[0] - 3 * WINDOW) > 2 * WINDOW)
    start, end = own[first] - WINDOW, own[np.r_[first[1:], len(own)] - 1] + WINDOW + 1
    before = np.cumsum(end - start) - (end - start)  # what lies in front of each stretch
    around = np.arange((end - start).sum()) + np.repeat(start - before, end - start)
    inside = np.empty(len(at), np.int64)
    inside[order] = own + np.repeat(before - start, np.diff(np.r_[first, len(own)]))
    return around, inside


def hidden_vectors(net: WindowNetwork, tokens: np.ndarray, inside: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray]:
    """Hidden vectors, with a one behind each, at places of a row of tokens; and all tokens' embeddings, one number after another.

    What neighbours add is summed along the whole row, so a token is looked up once for all places near it.
    """
    m, n = len(tokens), len(inside)
    near = room("near", WIDTH, m)
    near[:] = np.take(net.embed, tokens, axis=0, out=room("rows", m, WIDTH), mode="clip").T
    total, part = room("total", WIDTH, m), room("part", WIDTH, m - 2 * WINDOW)
    mid = total[:, WINDOW : m - WINDOW]
    mid[:] = net.bias[:, None]
    for step, place in zip(STEPS.tolist(), net.place, strict=True):
        mid += np.multiply(near[:, WINDOW + step : m - WINDOW + step], place[:, None], out=part)
    rows = room("rows", m, WIDTH)
    rows[:] = total.T
    hidden = room("hidden", n, WIDTH + 1)
    hidden[:, WIDTH] = 1
    found = np.take(rows, inside, axis=0, out=room("found", n, WIDTH), mode="clip")
    np.tanh(found, out=hidden[:, :WIDTH])
    return hidden, near


def class_logits(words: np.ndarray, hidden: np.ndarray, edges: list[int], low: np.ndarray) -> np.ndarray:
    """Each row's logits of the words of its class, written to ``low``; rows are sorted by class."""
    for c, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if a < b:
            np.matmul(hidden[a:b], words[c], out=low[a:b])
    return low


def parts_of(n: int) -> list[slice]:
    """Runs of NEAR_ROWS rows."""
    return [slice(a, min(n, a + NEAR_ROWS)) for a in range(0, n, NEAR_ROWS)]


def to_shares(logits: np.ndarray, bound: float, n: int) -> None:
    """Turns each row of logits into probabilities, divided by ``n``."""
    if bound >= 80:  # only then may an exponential be infinite
        logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits *= (1 / (n * (logits @ np.ones(logits.shape[1], np.float32))))[:, None]


def log_share(logits: np.ndarray, bound: float, pick: np.ndarray) -> np.ndarray:
    """The logarithm of the probability of one cell in each row of logits, which are overwritten."""
    if bound >= 80:
        logits -= logits.max(1, keepdims=True)
    found = logits[np.arange(len(logits)), pick]
    return found - np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], np.float32))


def log_likelihoods(net: WindowNetwork, flat: np.ndarray, at: np.ndarray, room: Room | None = None) -> np.ndarray:
    """The log-probability of the tokens at some different places from the tokens around them."""
    room, out, (classes, words) = room or Room(), np.empty(len(at)), net.stacked()
    bounds = bound_of(classes), bound_of(words)
    for a in range(0, len(at), SCORED):
        own = at[a : a + SCORED]
        order, kind, word, edges = by_class(flat, own)
        around, inside = stretches_around(own)
        hidden, _ = hidden_vectors(net, flat[around], inside[order], room)
        found = np.empty(len(own), np.float64)
        top, low = room("top", min(NEAR_ROWS, len(own)), CLASSES), class_logits(words, hidden, edges.tolist(), room("low", len(own), CLASSES))
        for p in parts_of(len(own)):
            logits = np.matmul(hidden[p], classes, out=top[: p.stop - p.start])
            found[p] = log_share(logits, bounds[0], kind[p])
            found[p] += log_share(low[p], bounds[1], word[p])
        out[a + order] = found
    return out


class Trainer:
    """Adagrad on batches of targets; ``seen`` are the sums of squared gradients. Large arrays are made once."""

    def __init__(self, net: WindowNetwork, seen: list[np.ndarray] | None = None):
        self.net, self.seen = net, seen or [np.full(a.shape, 1e-3, np.float32) for a in net.arrays()]
        self._room = Room()

    def step(self, flat: np.ndarray, at: np.ndarray) -> None:
        """One step on the tokens at some different places; those that lie beside each other share their neighbours."""
        net, room, n, one = self.net, self._room, len(at), np.float32(1 / len(at))
        order, kind, word, edges = by_class(flat, at)
        edges = edges.tolist()
        around, inside = stretches_around(at)
        used, inside, m = flat[around], inside[order], len(around)
        hidden, near = hidden_vectors(net, used, inside, room)
        classes, words = net.stacked()
        # gradients of the mean loss by the logits: what is predicted, less what is there
        bound, top, back = bound_of(classes), room("top", n, CLASSES), room("back", n, WIDTH)
        up, of_top = classes[:WIDTH].T, np.zeros_like(classes)
        for p in parts_of(n):
            logits = np.matmul(hidden[p], classes, out=top[p])
            to_shares(logits, bound, n)
            logits[np.arange(len(logits)), kind[p]] -= one
            np.matmul(logits, up, out=back[p])
            of_top += hidden[p].T @ logits
        bound, low = bound_of(words), class_logits(words, hidden, edges, room("low", n, CLASSES))
        for p in parts_of(n):
            to_shares(low[p], bound, n)
        low[np.arange(n), word] -= one
        kinds = np.flatnonzero(np.diff(edges))
        of_words = room("of_words", len(kinds), WIDTH + 1, CLASSES)
        for i, c in enumerate(kinds.tolist()):
            own = slice(edges[c], edges[c + 1])
            np.matmul(hidden[own].T, low[own], out=of_words[i])
            back[own] += low[own] @ net.words[c].T
        slope = hidden[:, :WIDTH]
        back *= np.subtract(1, np.multiply(slope, slope, out=slope), out=slope)
        # what places along the row get from the targets near them, and then what each token gets from all its places
        rows, sides, total, part = room("rows", m, WIDTH), room("sides", WIDTH, m), room("total", WIDTH, m), room("part", WIDTH, m - 2 * WINDOW)
        rows[:] = 0
        rows[inside] = back
        sides[:] = rows.T
        total[:] = 0
        mid, of_place = sides[:, WINDOW : m - WINDOW], np.empty_like(net.place)
        for k, step in enumerate(STEPS.tolist()):
            beside = slice(WINDOW + step, m - WINDOW + step)
            of_place[k] = np.einsum("wm,wm->w", near[:, beside], mid)
            total[:, beside] += np.multiply(mid, net.place[k][:, None], out=part)
        met = np.flatnonzero(np.bincount(used, minlength=SIZE))
        of_embed = np.stack([np.bincount(used, weights=t, minlength=SIZE)[met] for t in total], axis=1).astype(np.float32)
        every = slice(None)
        touched = every if len(kinds) == CLASSES else kinds
        grads = [
            (met, of_embed),
            (every, of_place),
            (every, np.ones(n, np.float32) @ back),
            (every, of_top[:WIDTH]),
            (every, of_top[WIDTH]),
            (touched, of_words[:, :WIDTH]),
            (touched, of_words[:, WIDTH]),
        ]
        # only what the batch touches has a gradient
        for k, (a, s, (rows, g)) in enumerate(zip(net.arrays(), self.seen, grads, strict=True)):
            g *= np.float32(np.sqrt(n))
            total = np.multiply(g, g, out=room(f"total{k}", *g.shape))
            total += s[rows]
            s[rows] = total
            np.sqrt(total, out=total)
            g /= total
            g *= np.float32(RATE)
            a[rows] -= g


def train_on(texts: list[np.ndarray], trainer: Trainer, seed: int) -> int:
    """Trains once on every token of the texts, in runs of RUN whose order is by ``seed``; the number of tokens."""
    flat, at = laid_out(texts)
    runs = np.random.default_rng((SEED, seed)).permutation(-(-len(at) // RUN))
    own = (runs[:, None] * RUN + np.arange(RUN)).ravel()
    at = at[own[own < len(at)]]
    batch = min(BATCH, max(512, len(at) // 64))  # a small corpus is seen in small steps
    for a in range(0, len(at), batch):
        trainer.step(flat, at[a : a + batch])
    return len(at)


def counted(stretches: Counter[str]) -> pa.RecordBatch:
    """(token, n) of lower-case stretches between white space; each is cut into tokens once."""
    counts: dict[str, int] = {}
    for stretch, n in stretches.items():
        for token in tokens_in(stretch):
            counts[token] = counts.get(token, 0) + n
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of texts (id, mix, size, at, words), and rows of (token, n) between them, the counts of a task's tokens.

    ``words`` are the block's different stretches with blanks between them, ``at`` the numbers of all
    texts' stretches in it (of 16 bits, or of 32 if there are so many), ``size`` how many each text has.
    Tasks hand on what they have counted whenever it is much.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = f"id array<{kind.simpleString()}>, mix array<long>, size array<int>, at binary, words string, token array<string>, n array<long>"
    names = ["id", "mix", "size", "at", "words", "token", "n"]

    def one(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()  # most stretches come again
        kinds: list[pa.DataType] = []

        def counts() -> Iterator[pa.RecordBatch]:
            found = counted(total)
            for at in range(0, found.num_rows, COUNT_ROW):
                part = found.slice(at, COUNT_ROW)
                none = [pa.nulls(1, pa.list_(t)) for t in (*kinds, pa.int32())]
                yield pa.RecordBatch.from_arrays([*none, pa.nulls(1, pa.binary()), pa.nulls(1, pa.string()), one(part.column(0)), one(part.column(1))], names)
            total.clear()

        for batch in small(batches):
            kinds[:] = [batch.schema.types[0], batch.schema.types[2]]
            texts, a = batch.column(1).to_pylist(), 0
            while a < len(texts):
                number, found, sizes = defaultdict(count().__next__), [], []
                while a + len(sizes) < len(texts) and len(number) < BLOCK_WORDS:
                    sizes.append(0)
                    for piece in pieces(texts[a + len(sizes) - 1] or ""):
                        stretches = piece.lower().split()
                        found.append(np.fromiter(map(number.__getitem__, stretches), np.uint32, len(stretches)))
                        sizes[-1] += len(stretches)
                at = np.concatenate([np.zeros(0, np.uint32), *found])
                for word, n in zip(number, np.bincount(at, minlength=len(number)).tolist(), strict=True):
                    total[word] += n
                k, width = len(sizes), "<u2" if len(number) <= 1 << 16 else "<u4"
                rows = [one(batch.column(0).slice(a, k)), one(batch.column(2).slice(a, k)), one(pa.array(sizes, pa.int32()))]
                rows += [pa.array([at.astype(width).tobytes()], pa.binary()), pa.array([" ".join(number)])]
                yield pa.RecordBatch.from_arrays([*rows, pa.nulls(1, pa.list_(pa.string())), pa.nulls(1, pa.list_(pa.int64()))], names)
                a += k
                if len(total) > COUNT_WORDS:
                    yield from counts()
        if total:
            yield from counts()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("mix"))
    return rows.mapInArrow(run, schema)


def written(df: DataFrame, **options: int) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    folder = f"{shared_dir(df.sparkSession)}/lm-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def token_sums(blocks: DataFrame) -> DataFrame:
    """(token, n) over all texts of ``numbered``."""
    counts = blocks.where("n is not null").select(F.explode(F.arrays_zip("token", "n")).alias("c"))
    return counts.groupBy("c.token").agg(F.sum("c.n").alias("n"))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, n) over all texts."""
    return token_sums(numbered(docs.select(F.lit(None).cast("int").alias("none"), text_col), "none", text_col))


def learn_vocabulary(docs: DataFrame, text_col: str = "text") -> tuple[Vocabulary, int]:
    """The vocabulary of all texts and the number of tokens."""
    return vocabulary_of(word_counts(docs, text_col))


def vocabulary_of(sums: DataFrame) -> tuple[Vocabulary, int]:
    """The vocabulary and the number of tokens by their counts; the driver gets SIZE words and at most RARE x CELLS counts."""
    counts = checkpointed(sums)
    words = [r["token"] for r in counts.orderBy(F.desc("n"), "token").limit(SIZE - RARE).collect()]
    held = sums.sparkSession.sparkContext.broadcast(Vocabulary(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, n = held.value.codes(batch.column(0).to_pylist()), batch.column(1).to_numpy()
            ids = code % SIZE
            cell = np.where(ids < RARE, ids * CELLS + code // SIZE, -1)  # -1: words of the vocabulary
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    found = counts.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = found.column("cell").to_numpy(), found.column("n").to_numpy()
    of_cell = np.zeros(RARE * CELLS)
    of_cell[cell[cell >= 0]] = n[cell >= 0]
    of_kind = of_cell.reshape(RARE, CELLS).sum(1, keepdims=True)
    shares = np.log((of_cell.reshape(RARE, CELLS) + 1 / CELLS) / (of_kind + 1)).ravel().astype(np.float32)
    return Vocabulary(words, shares), int(n.sum())


def encode(blocks: DataFrame, vocabulary: Vocabulary, tokens: int) -> DataFrame:
    """(id, ids, rare, mix, round, shard) of every text of ``numbered``, written to the shared folder: 16 bits a token."""
    held = blocks.sparkSession.sparkContext.broadcast(vocabulary)  # of fixed size
    kind = blocks.schema["id"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = [column[i] for column in batch.columns]
                words, sizes = block[4].as_py().split(), block[2].values.to_numpy()
                numbers = np.frombuffer(block[3].as_buffer(), "<u2" if len(words) <= 1 << 16 else "<u4")
                ids, n, rare = held.value.encoded_block(words, numbers, sizes)
                data, ends = ids.astype("<u2").tobytes(), np.r_[0, np.cumsum(2 * n)].tolist()
                cut = pa.array([data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([block[0].values, cut, pa.array(rare, pa.float64()), block[1].values], ["id", "ids", "rare", "mix"])

    rows = blocks.where("n is null").select("id", "mix", "size", "at", "words").mapInArrow(run, f"id {kind}, ids binary, rare double, mix long")
    shards = max(1, -(-tokens // SHARD_TOKENS))
    return written(rows.withColumn("round", F.pmod("mix", F.lit(ROUNDS)).cast("int")).withColumn("shard", F.pmod(F.shiftright("mix", 8), F.lit(shards))))


def averaged(parts: DataFrame, shards: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The means of (slice, shard, weight, net, seen) over all shards by weight: FAN at a time, in the order of the shards. None without any.

    Numbers are moved in single precision, as they are trained, and added in double.
    """

    def add(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["shard"])
        weight = sum(r["weight"] for r in rows)
        mean = {c: (sum(r["weight"] * np.frombuffer(r[c], "<f4").astype(np.float64) for r in rows) / weight).astype("<f4").tobytes() for c in ("net", "seen")}
        return pa.Table.from_pylist([{"slice": rows[0]["slice"], "shard": rows[0]["shard"] // FAN, "weight": weight, **mean}], group.schema)

    while True:
        parts = parts.groupBy("slice", F.floor(F.col("shard") / FAN).alias("of")).applyInArrow(add, parts.schema)
        shards = -(-shards // FAN)
        if shards == 1:
            break
    rows = sorted(parts.collect(), key=lambda r: r["slice"])
    if not rows:
        return None
    net, seen = (np.concatenate([np.frombuffer(r[c], "<f4") for r in rows]) for c in ("net", "seen"))
    return net, seen


def train_rounds(encoded: DataFrame, tokens: int) -> WindowNetwork:
    """The network after ROUNDS rounds over the shards; the driver gets one network's numbers a round."""
    spark, shards = encoded.sparkSession, max(1, -(-tokens // SHARD_TOKENS))
    net, seen = WindowNetwork.fresh(), None
    kind = "slice int, shard long, weight double, net binary, seen binary"
    schema = pa.schema([("slice", pa.int32()), ("shard", pa.int64()), ("weight", pa.float64()), ("net", pa.binary()), ("seen", pa.binary())])

    def training(held: Broadcast, turn: int) -> Callable[[pa.Table], pa.Table]:
        def run(shard: pa.Table) -> pa.Table:
            net, seen = held.value
            trainer = Trainer(WindowNetwork.of(net.flat()), seen and [s.copy() for s in seen])
            rows = sorted(zip(shard.column("mix").to_pylist(), shard.column("ids").to_pylist(), strict=True))
            number = shard.column("shard")[0].as_py()
            weight = train_on([np.frombuffer(ids, "<u2") for _, ids in rows], trainer, ROUNDS * number + turn)
            cut = lambda arrays: np.array_split(np.concatenate([a.ravel() for a in arrays]).astype("<f4"), SLICES)
            both = zip(cut(trainer.net.arrays()), cut(trainer.seen), strict=True)
            return pa.Table.from_pylist([{"slice": i, "shard": number, "weight": float(weight), "net": a.tobytes(), "seen": b.tobytes()} for i, (a, b) in enumerate(both)], schema)

        return run

    for turn in range(ROUNDS if tokens else 0):
        held = spark.sparkContext.broadcast((net, seen))  # of fixed size
        mine = encoded.where((F.col("round") == turn) & (F.length("ids") > 0)).select("shard", "mix", "ids").repartition(shards, "shard")
        parts = mine.groupBy("shard").applyInArrow(training(held, turn), kind)
        if found := averaged(parts, shards):
            net, seen = WindowNetwork.of(found[0]), WindowNetwork.of(found[1]).arrays()
    return net


def vocabulary_and_texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[Vocabulary, DataFrame, int]:
    """The vocabulary of the whole corpus, its encoded texts and the number of their tokens."""
    blocks = written(numbered(docs, id_col, text_col), **{"parquet.block.size": GROUP_BYTES})
    vocabulary, tokens = vocabulary_of(token_sums(blocks))
    return vocabulary, encode(blocks, vocabulary, tokens), tokens


def train_network(docs: DataFrame, text_col: str = "text") -> tuple[Vocabulary, WindowNetwork]:
    """The vocabulary of the whole corpus and the network trained on all its tokens."""
    vocabulary, encoded, tokens = vocabulary_and_texts(docs.select(F.lit(None).cast("int").alias("none"), text_col), "none", text_col)
    return vocabulary, train_rounds(encoded, tokens)


def lm_scores(docs: DataFrame, model: tuple[Vocabulary, WindowNetwork] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pseudo-log-likelihood of every whole text.

    Returns one row per input row: the id column, ``n_tokens``,
    ``log_likelihood`` (the sum over all tokens) and ``score`` (its mean, null for
    a text without tokens). Without a model one is trained on ``docs`` first; the
    encoded texts then stay in the shared folder, where the result reads them.

    A null text counts as empty: 0 tokens, likelihood 0. Repeated rows give
    repeated results, up to the rounding of single precision; a null id stays null, an empty table gives an empty one.
    Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    if model is None:
        _, encoded, tokens = vocabulary_and_texts(docs, id_col, text_col)
        net = train_rounds(encoded, tokens)
    else:
        vocabulary, net = model
        encoded = encode(numbered(docs, id_col, text_col), vocabulary, 0)
    held = spark.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = Room()
        for batch in small(batches):
            texts = [np.frombuffer(i, "<u2") for i in batch.column(1).to_pylist()]
            flat, at = laid_out(texts)
            n = np.fromiter(map(len, texts), np.int64, len(texts))
            value = log_likelihoods(held.value, flat, at, room)
            total = np.bincount(np.repeat(np.arange(len(n)), n), weights=value, minlength=len(n)) + batch.column(2).to_numpy()
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total), mean], ["id", "n_tokens", "log_likelihood", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = encoded.select("id", "ids", "rare").mapInArrow(run, f"id {kind}, n_tokens long, log_likelihood double, score double")
    return found.withColumnRenamed("id", id_col)
