"""Secret scans: fixed patterns, and formats learnt from the credentials that the patterns label.

First the whole corpus is scanned with the patterns. Of each kind's distinct
values, and of all other tokens, those with the smallest hashes are kept (a
bottom-k sketch, merged across tasks). From each kind's values a probabilistic
automaton is inferred. Then every token of the corpus that is no shorter than the
shortest such value, and every part between marks in it, is scored by its
likelihood under the automata against that under the model of other tokens; those
that score like a kind's own values become spans besides the patterns' own.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, ship, small
from .grammar import Automaton, Background

# The patterns of the three kinds, and the order of kinds.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_VALUE = 6
#: Access keys, hex strings and candidates lie in runs of these characters; parts of a run lie between marks.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
LONG = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
PART = re.compile(r"[A-Za-z0-9]{6,}")
MARKS = "+/_.=-"
#: Distinct values of each kind that the automata are learnt from, those of at most so many characters, and other tokens.
SAMPLE, LEARNT_CHARS, OTHERS = 500, 1024, 2000
#: Runs that a worker remembers as holding nothing.
CACHE_RUNS = 300_000
#: Share of a kind's own values that may score below its threshold, and nats a character that a token must score at least.
MISSED_SHARE = 0.1
MARGIN = 0.25
#: Nats a character by which other tokens may prefer their own model and still pass for a format's, and times that these are told apart.
DOUBT, DOUBT_ROUNDS = 0.05, 10
#: Values of a kind below which its format isn't learnt.
MIN_VALUES = 20


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the patterns' matches, by start and kind.

    A match of ACCESS or HEX is always the rest of a longest run of its letters,
    so its least length may stand in the pattern; not so with ASSIGN, where a
    match that is too short still uses up its text.
    """
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    for run in LONG.finditer(text):
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text, *run.span())]
        found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text, *run.span())]
    return sorted(found)


def outside(text: str, base: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int]]:
    """Runs, and what the patterns' matches leave of them."""
    for run in RUN.finditer(text):
        at, end = run.span()
        for a, _, b, _ in base:
            if a < end and b > at:
                if a > at:
                    yield at, a
                at = max(at, b)
        if at < end:
            yield at, end


def forms(run: str) -> list[tuple[int, int]]:
    """The run, and it without its outermost equal marks or all marks at its start, its end, or both.

    A credential may end in marks, or stand beside some, as in ``(...==.)``.
    """
    if run.isalnum():
        return [(0, len(run))]
    n = len(run)
    starts = [0, n - len(run.lstrip(MARKS))]
    ends = [n, len(run.rstrip(MARKS))]
    if starts[1]:
        starts.append(n - len(run.lstrip(run[0])))
    if ends[1] < n:
        ends.append(len(run.rstrip(run[-1])))
    return [(a, b) for a in dict.fromkeys(starts) for b in dict.fromkeys(ends) if a < b]


@dataclass
class FormatModel:
    """The automata by kind with their thresholds, and the model of other tokens."""

    automata: dict[str, Automaton] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)
    other: Background | None = None
    #: characters of the shortest value that was learnt from
    least: int = MIN_VALUE

    def score(self, token: str, kind: str) -> float:
        """Nats a character by which the kind's automaton prefers the token to others."""
        return (self.automata[kind].log_likelihood(token) - self.other.log_likelihood(token)) / (len(token) + 1)

    def gain(self, token: str) -> float:
        """Nats by which a kind prefers the token to others, if it is as likely in that format as the kind's own values are; else 0."""
        return max((s * (len(token) + 1) for k, t in self.thresholds.items() if (s := self.score(token, k)) >= t), default=0.0)

    def accepts(self, token: str) -> bool:
        return self.gain(token) > 0

    def found_in(self, run: str) -> list[tuple[int, int]]:
        """The run as it stands or without marks at either end, or those of its parts that are accepted, whichever gains most."""
        whole = max(((self.gain(run[a:b]), a - b, a, b) for a, b in forms(run) if b - a >= self.least), default=(0.0,))
        parts = [] if run.isalnum() else [(m, g) for m in PART.finditer(run) if len(m[0]) >= self.least and (g := self.gain(m[0]))]
        if whole[0] and whole[0] >= sum(g for _, g in parts):
            return [whole[2:]]
        return [m.span() for m, _ in parts]


def without(token: str, doubtful: set[str]) -> Iterator[str]:
    """What is left of a token without doubtful parts between marks; nothing, if all of it but marks at its ends is doubtful."""
    if any(token[a:b] in doubtful for a, b in forms(token)):
        return
    at = 0
    for m in PART.finditer(token):
        if m[0] in doubtful:
            if at < m.start():
                yield token[at : m.start()]
            at = m.end()
    if at < len(token):
        yield token[at:]


def other_tokens(model: FormatModel, others: list[str], once: set[str]) -> list[str]:
    """Sets the model of other tokens, which may hold credentials without a label; returns what it is learnt from.

    Words recur in a corpus, credentials hardly do. So tokens and parts between
    marks that are in one text only aren't learnt from if a format explains them
    about as well as the model of all tokens, or as that of those left.
    """
    model.other, doubtful, left = Background(others), set(), others
    parts = {p for t in once for p in (*(t[a:b] for a, b in forms(t)), *PART.findall(t)) if len(p) >= model.least}
    for _ in range(DOUBT_ROUNDS):
        more = {p for p in parts - doubtful if any(model.score(p, k) >= -DOUBT for k in model.automata)}
        if not more:
            break
        doubtful |= more
        left = [x for t in others for x in (without(t, doubtful) if t in once else (t,))]
        model.other = Background(left)
    return left


def learn_formats(values: dict[str, list[str]], others: list[str], once: set[str] = frozenset()) -> FormatModel:
    """A model of the kinds that have enough values; without any, one that adds no spans.

    ``once`` are those of the other tokens that only one text has.
    A threshold lies between the other tokens' scores and those of the kind's own
    values; where they overlap, above all others, but those that score like nine
    tenths of the values: these are taken for credentials without a label.
    """
    kinds = {k: v for k, v in sorted(values.items()) if len(v) >= MIN_VALUES}
    if not kinds or not others:
        return FormatModel()
    model = FormatModel({k: Automaton(v) for k, v in kinds.items()}, least=min(len(x) for v in kinds.values() for x in v))
    left = other_tokens(model, others, once)
    for k, v in kinds.items():
        own = np.array([model.score(t, k) for t in v])
        high = float(np.quantile(own, MISSED_SHARE))
        below = [x for t in left for a, b in forms(t) if (x := model.score(t[a:b], k)) < high]
        top = max(below, default=high)
        model.thresholds[k] = max(MARGIN, (top + own.min()) / 2 if top < own.min() else top + 1e-9)
    return model


def sample_tokens(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, others: int = OTHERS) -> DataFrame:
    """(kind, hash, value, n): of each kind's distinct values in all texts, those with the smallest hashes; of other tokens, too.

    ``n`` is 1 for other tokens that only one text has, and more for those of several.

    Each task keeps so many of a kind, so at most as many short rows as tasks times
    that are shuffled; the smallest of them are found by partial sorts. Values of
    more than LEARNT_CHARS characters teach nothing.
    """
    ship(docs.sparkSession)
    keep = {k: others if k == "format" else sample for k in KINDS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[int, str]] = {k: {} for k in KINDS}
        highest = dict.fromkeys(KINDS, 1 << 63)
        seen: set[str] = set()
        held: set[str] = set()  # runs that were among the smallest when they were found
        again: set[str] = set()

        def shrink(kind: str) -> None:
            of = kept[kind]
            if len(of) > keep[kind]:
                for h in heapq.nlargest(len(of) - keep[kind], of):
                    del of[h]
                highest[kind] = max(of)

        def put(kind: str, value: str) -> bool:
            h = xxhash.xxh64_intdigest(value) >> 1
            if found := h < highest[kind] and MIN_VALUE <= len(value) <= LEARNT_CHARS:
                if kind == "format" and h in kept[kind]:
                    again.add(value)
                kept[kind][h] = value
                if len(kept[kind]) > 4 * keep[kind]:
                    shrink(kind)
            return found

        for batch in small(batches):
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                base = base_spans(text)
                for _, k, _, v in base:
                    put(KINDS[k], v)
                runs = {text[a:b] for a, b in outside(text, base)} if base else set(RUN.findall(text))
                again |= runs & held
                for r in runs - seen:
                    if put("format", r):
                        held.add(r)
                if len(seen) < CACHE_RUNS:
                    seen |= runs
        rows = []
        for kind, of in kept.items():
            shrink(kind)
            rows += [{"kind": kind, "hash": h, "value": v, "n": 1 + (v in again)} for h, v in of.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("kind", pa.string()), ("hash", pa.int64()), ("value", pa.string()), ("n", pa.int64())]))

    rows = docs.select(text_col).mapInArrow(run, "kind string, hash long, value string, n long")
    found = checkpointed(rows.groupBy("kind", "hash", "value").agg(F.sum("n").alias("n")))
    first = [found.where(F.col("kind") == k).orderBy("hash", "value").limit(n) for k, n in keep.items()]
    return reduce(DataFrame.unionByName, first)


def secret_model(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> FormatModel:
    """Learns the formats from the sampled values of the whole corpus: at most 3 x ``sample`` + OTHERS values reach the driver."""
    values: dict[str, list[str]] = {k: [] for k in KINDS}
    once: set[str] = set()
    for r in sample_tokens(docs, text_col, sample).collect():
        values[r["kind"]].append(r["value"])
        if r["kind"] == "format" and r["n"] == 1:
            once.add(r["value"])
    others = values.pop("format")
    return learn_formats(values, others, once)


class Scanner:
    """Finds spans in texts; remembers runs in which the model finds nothing."""

    def __init__(self, model: FormatModel):
        self.model, self.clean = model, set()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the patterns' matches and of the tokens that the model adds."""
        base = base_spans(text)
        found = [(a, k, b) for a, k, b, _ in base]
        if not self.model.thresholds:
            return found
        fresh = set(RUN.findall(text)) - self.clean
        empty = {r for r in fresh if not self.model.found_in(r)}
        if base or len(empty) < len(fresh):
            for at, end in outside(text, base):
                run = text[at:end]
                if run not in self.clean and run not in empty:
                    found += [(at + a, 3, at + b) for a, b in self.model.found_in(run)]
        if len(self.clean) < CACHE_RUNS:
            self.clean |= empty
        return sorted(found)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, or spans that overlap, replaced by ``[kind]`` of the first."""
    out, at, open_to = [], 0, -1
    for a, k, b in spans:
        if a < open_to:
            open_to = at = max(open_to, b)
            continue
        out += [text[at:a], f"[{KINDS[k]}]"]
        at = open_to = b
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, model: FormatModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The secrets of every whole text.

    Returns one row per input row: the id column, ``n_assign``, ``n_access``,
    ``n_hex`` (matches of the patterns), ``base_sha256`` (of ``kind:start:end``
    of these, by start and then kind, joined by commas; code points, end
    exclusive), ``spans`` (the same text with the spans that the learnt formats
    add, kind ``format``). Without a model one is learnt from ``docs`` first.

    A null or empty text has no spans. Repeated rows give repeated results, a
    null id stays null, an empty table gives an empty one. Other columns are
    ignored, whatever their names.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model or secret_model(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(held.value)
        for batch in small(batches):
            counts, digests, texts = [[], [], []], [], []
            for text in batch.column(1).to_pylist():
                spans = scanner.spans(text) if text else []
                named = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
                for k in range(3):
                    counts[k].append(sum(kind == k for _, kind, _ in spans))
                digests.append(hashlib.sha256(",".join(s for s in named if not s.startswith("format")).encode()).hexdigest())
                texts.append(",".join(named))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, model: FormatModel | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in the text replaced by ``[kind]``; all other columns stay, a null text too."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model or secret_model(docs, text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(held.value)
        for batch in small(batches):
            texts = [t and redacted(t, scanner.spans(t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
