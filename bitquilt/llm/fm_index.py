"""A bidirectional FM-index over a delimited vocabulary, searched by numpy for many patterns at once."""

from __future__ import annotations

import numpy as np

from .double_array import _ranges

#: Symbols between two stored counts.
STEP = 32


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the cyclic shifts of a text in sorted order, by prefix doubling; shifts must differ."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, width = np.argsort(rank, kind="stable"), 1
    while True:
        key = rank * n + np.roll(rank, -width)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        rank, width = fresh, width * 2
        if rank[order[-1]] == n - 1 or width >= 2 * n:
            return order


class Ranks:
    """Counts of the symbols below, and equal to, a symbol in any prefix of a Burrows-Wheeler transform."""

    def __init__(self, bwt: np.ndarray, symbols: int) -> None:
        self.bwt = bwt
        n = len(bwt)
        blocks = -(-n // STEP) + 1
        self.rows = np.full(blocks * STEP, symbols, bwt.dtype)
        self.rows[:n] = bwt
        self.rows = self.rows.reshape(blocks, STEP)
        seen = np.zeros((blocks + 1, symbols + 1), np.int32)
        np.add.at(seen, (np.arange(n) // STEP + 1, bwt.astype(np.int64) + 1), 1)
        # seen[b, c]: symbols below c in the first b blocks
        self.seen = seen.cumsum(axis=0, dtype=np.int32).cumsum(axis=1, dtype=np.int32)

    def before(self, symbol: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols below `symbol`, and equal ones, among the first `at`."""
        block = at // STEP
        inside = np.arange(STEP) < (at % STEP)[:, None]
        rows = self.rows[block]
        c = symbol[:, None].astype(rows.dtype)
        below = self.seen[block, symbol]
        equal = self.seen[block, symbol + 1] - below
        return below + ((rows < c) & inside).sum(axis=1), equal + ((rows == c) & inside).sum(axis=1)


class BiIndex:
    """Words between delimiters, indexed in both directions.

    An interval (low, reverse low, size) names the suffixes that start with a pattern in the order of the text, and those of the
    reversed text that start with the reversed pattern; a symbol can be put at either end of the pattern.
    """

    def __init__(self, words: list[str]) -> None:
        points = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        self.alphabet, text = np.unique(points, return_inverse=True)
        self.symbols, self.n = len(self.alphabet), len(text)
        small = np.uint8 if self.symbols < 255 else np.uint16 if self.symbols < 65535 else np.uint32
        order, reverse = suffix_order(text), suffix_order(text[::-1])
        self.left = Ranks(text[order - 1].astype(small), self.symbols)
        self.right = Ranks(text[::-1][reverse - 1].astype(small), self.symbols)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        delimiters = np.flatnonzero(text == 0)
        self.word_at = np.searchsorted(delimiters, order)

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; -1 for those that no word has."""
        at = np.minimum(np.searchsorted(self.alphabet, points), self.symbols - 1)
        return np.where(self.alphabet[at] == points, at, -1).astype(np.int64)

    def everything(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The empty pattern, n times."""
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, self.n, np.int64)

    def extend(self, state: tuple, symbol: np.ndarray, to_left: bool) -> tuple[np.ndarray, tuple]:
        """The states that are not empty with one more symbol at one end: their numbers among those given, and themselves."""
        near, far, size = state if to_left else (state[1], state[0], state[2])
        use = np.flatnonzero(symbol >= 0)
        near, far, size, symbol = near[use], far[use], size[use], symbol[use]
        ranks = self.left if to_left else self.right
        below, equal = ranks.before(symbol, near)
        below_end, equal_end = ranks.before(symbol, near + size)
        found = equal_end - equal
        alive = found > 0
        near, far = (self.smaller[symbol] + equal)[alive], (far + below_end - below)[alive]
        return use[alive], (near, far, found[alive]) if to_left else (far, near, found[alive])

    def choices(self, state: tuple, to_left: bool) -> tuple[np.ndarray, np.ndarray]:
        """(number of the state, symbol) for the letters that may stand next to each pattern."""
        near, size = state[0 if to_left else 1], state[2]
        bwt = (self.left if to_left else self.right).bwt
        few = np.flatnonzero(size <= self.symbols)
        many = np.flatnonzero(size > self.symbols)
        seen = np.unique(np.repeat(few, size[few]) * self.symbols + bwt[_ranges(near[few], size[few])])
        number = np.concatenate([seen // self.symbols, np.repeat(many, self.symbols - 1)])
        symbol = np.concatenate([seen % self.symbols, np.tile(np.arange(1, self.symbols), len(many))])
        letter = symbol > 0
        return number[letter], symbol[letter]


def take(state: tuple, at: np.ndarray) -> tuple:
    return tuple(x[at] for x in state)


def joined(*parts: tuple[np.ndarray, tuple]) -> tuple[np.ndarray, tuple]:
    return np.concatenate([p[0] for p in parts]), tuple(np.concatenate(x) for x in zip(*[p[1] for p in parts], strict=True))


def one_error(index: BiIndex, patterns: np.ndarray, half: int, left_exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (pattern, word of the index) such that the word is the pattern with one code point inserted, deleted or replaced in one half.

    `patterns`: symbols of patterns of one length, a row each. The other half, the first `half` symbols if `left_exact`, is matched
    outwards from the middle to its delimiter; then the index is extended the other way over the half with the error.
    """
    n, length = patterns.shape
    exact, erring = (patterns[:, :half][:, ::-1], patterns[:, half:]) if left_exact else (patterns[:, half:], patterns[:, :half][:, ::-1])
    inwards, outwards = left_exact, not left_exact
    who, state = np.arange(n), index.everything(n)
    for i in range(exact.shape[1] + 1):
        symbol = exact[who, i] if i < exact.shape[1] else np.zeros(len(who), np.int64)
        alive, state = index.extend(state, symbol, inwards)
        who = who[alive]
    wrong, wrong_state = np.empty(0, np.int64), tuple(np.empty(0, np.int64) for _ in range(3))
    for i in range(erring.shape[1] + 1):
        last = i == erring.shape[1]
        number, symbol = index.choices(state, outwards)
        due = np.full(len(who), -1) if last else erring[who, i]
        # an inserted letter equal to the next one is the same word as one inserted behind it
        other = symbol != due[number]
        number, symbol = number[other], symbol[other]
        alive, changed = index.extend(take(state, number), symbol, outwards)
        inserted = (who[number[alive]], changed)
        wrong, wrong_state = joined((wrong, wrong_state), inserted)
        if last:
            break
        alive, wrong_state = index.extend(wrong_state, erring[wrong, i], outwards)
        wrong = wrong[alive]
        # replaced: the changed letter stands for the due one; deleted: the word lacks it
        wrong, wrong_state = joined((wrong, wrong_state), inserted, (who, state))
        alive, state = index.extend(state, due, outwards)
        who = who[alive]
    alive, final = index.extend(wrong_state, np.zeros(len(wrong), np.int64), outwards)
    pairs = np.unique(wrong[alive] * index.n + index.word_at[final[0]])
    return pairs // index.n, pairs % index.n
