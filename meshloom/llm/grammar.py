"""Probabilistic automata inferred from example strings by merging compatible states of a prefix tree."""

from __future__ import annotations

import math

import numpy as np

#: Symbols of credentials: classes of letters and digits, and the marks themselves.
CLASSES = {**dict.fromkeys("0123456789", 0), **dict.fromkeys("abcdef", 1), **dict.fromkeys("ghijklmnopqrstuvwxyz", 2), **dict.fromkeys("ABCDEF", 3), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", 4)} | {c: 5 + i for i, c in enumerate("+/_.=-")}
OTHER = 11
N_SYMBOLS = 12
#: Characters in each class, so that likelihoods are of characters, not of classes.
CLASS_SIZE = np.array([10, 6, 20, 6, 20, 1, 1, 1, 1, 1, 1, 1000])
#: Share of a state's probability that is spread over all symbols, for those not seen there.
SMOOTHING = 0.01


def symbols(text: str) -> list[int]:
    return [CLASSES.get(c, OTHER) for c in text]


class _State:
    __slots__ = ("count", "ends", "next")

    def __init__(self):
        self.count, self.ends, self.next = 0, 0, {}


def prefix_tree(strings: list[list[int]]) -> _State:
    root = _State()
    for s in strings:
        node = root
        node.count += 1
        for c in s:
            node = node.next.setdefault(c, _State())
            node.count += 1
        node.ends += 1
    return root


def _passes(state: _State, c: int) -> int:
    return state.ends if c < 0 else state.next[c].count if c in state.next else 0


def compatible(a: _State, b: _State, bound: float, passed: dict) -> bool:
    """Do both states, and what follows them, end and go on alike, by Hoeffding's bound?"""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        limit = bound * (1 / math.sqrt(x.count) + 1 / math.sqrt(y.count))
        if limit >= 1:
            continue  # too few strings to tell anything apart here or below
        for c in (-1, *x.next.keys(), *(y.next.keys() - x.next.keys())):
            p = passed.get((id(x), c), 0) if c >= 0 else x.ends
            if abs(p / x.count - _passes(y, c) / y.count) > limit:
                return False
        stack += [(x.next[c], y.next[c]) for c in x.next.keys() & y.next.keys()]
    return True


class Automaton:
    """A deterministic automaton with a probability for each symbol and for the end in each state."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        coded = [symbols(s) for s in sorted(strings)]
        root, bound = prefix_tree(coded), math.sqrt(0.5 * math.log(2 / alpha))
        #: how many strings took each transition; a merged state's count is no longer its parent's alone
        passed: dict[tuple[int, int], int] = {}
        todo = [root]
        while todo:
            x = todo.pop()
            for c, y in x.next.items():
                passed[id(x), c] = y.count
                todo.append(y)
        red, known = [root], {id(root)}
        while blue := next(((r, c) for r in red for c in sorted(r.next) if id(r.next[c]) not in known), None):
            parent, c = blue
            state = parent.next[c]
            for r in red:
                if compatible(r, state, bound, passed):
                    parent.next[c] = r
                    self._fold(r, state, passed)
                    break
            else:
                red.append(state)
                known.add(id(state))
        self._tables(red, passed)

    @staticmethod
    def _fold(into: _State, tree: _State, passed: dict) -> None:
        """Adds a tree's counts to a state and those after it; what the state lacks is hung below it."""
        stack = [(into, tree)]
        while stack:
            x, y = stack.pop()
            x.count += y.count
            x.ends += y.ends
            for c, child in y.next.items():
                n = passed[id(y), c]
                passed[id(x), c] = passed.get((id(x), c), 0) + n
                if c in x.next:
                    stack.append((x.next[c], child))
                else:
                    x.next[c] = child

    def _tables(self, red: list[_State], passed: dict) -> None:
        number = {id(s): i for i, s in enumerate(red)}
        seen = np.zeros((len(red), N_SYMBOLS + 1))
        self.next = np.zeros((len(red), N_SYMBOLS), np.int64)  # an unseen symbol leads to the start
        for i, s in enumerate(red):
            seen[i, N_SYMBOLS] = s.ends
            for c, t in s.next.items():
                seen[i, c] = passed[id(s), c]
                self.next[i, c] = number[id(t)]
        seen /= np.maximum(seen.sum(1, keepdims=True), 1)
        p = (1 - SMOOTHING) * seen + SMOOTHING / (N_SYMBOLS + 1)
        self.log_p = np.log(p[:, :N_SYMBOLS] / CLASS_SIZE).tolist()
        self.log_end = np.log(p[:, N_SYMBOLS]).tolist()
        self.next = self.next.tolist()

    @property
    def n_states(self) -> int:
        return len(self.log_end)

    def log_likelihood(self, text: str) -> float:
        state, total = 0, 0.0
        for c in symbols(text):
            total += self.log_p[state][c]
            state = self.next[state][c]
        return total + self.log_end[state]


class Background:
    """First-order model of the symbols of tokens that are no credentials."""

    def __init__(self, strings: list[str]):
        counts = np.full((N_SYMBOLS + 1, N_SYMBOLS + 1), 0.5)
        for s in strings:
            before = N_SYMBOLS
            for c in [*symbols(s), N_SYMBOLS]:
                counts[before, c] += 1
                before = c
        p = counts / counts.sum(1, keepdims=True)
        p[:, :N_SYMBOLS] /= CLASS_SIZE
        self.log_p = np.log(p).tolist()

    def log_likelihood(self, text: str) -> float:
        before, total = N_SYMBOLS, 0.0
        for c in [*symbols(text), N_SYMBOLS]:
            total += self.log_p[before][c]
            before = c
        return total
