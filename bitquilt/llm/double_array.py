"""A double-array trie over phrases of word ids, walked by numpy from all text positions at once."""

from __future__ import annotations

import numpy as np

#: A node with more children gets a window of its own; others go where their children's places are free.
WIDE = 32
#: Places per child of the other nodes, and rounds of searching before a node gets a window too.
ROOM = 4
ROUNDS = 200


class DoubleArray:
    """Phrases of k word ids below `size`; an id is one or more digits of 8 bits, each a step in the trie.

    Step c from place s leads to base[s] + c, if check[base[s] + c] is s. An accepting place has its phrase's number as base.
    The arrays have at most 256 places per wide node (over 32 children) and about 4 per other edge, so they are bounded by the phrases.
    """

    def __init__(self, phrases: np.ndarray, size: int) -> None:
        phrases = np.asarray(phrases, np.int64).reshape(len(phrases), -1)
        self.length = phrases.shape[1]
        self.phrases = phrases[np.lexsort(phrases.T[::-1])]
        self.digits = max(1, (max(size - 1, 1).bit_length() + 7) // 8)
        shifts = 8 * np.arange(self.digits - 1, -1, -1)
        symbols = (self.phrases[:, :, None] >> shifts & 255).reshape(len(phrases), -1)
        parents, steps, children, offset = [], [], [], 0
        node = np.zeros(len(phrases), np.int64)
        for symbol in symbols.T:
            key = node << 8 | symbol
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[:len(phrases)]
            nodes = int(node[-1]) + 1 if len(node) else 1
            parents.append(offset + node[first])
            steps.append(symbol[first])
            node = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))[:len(phrases)]
            children.append(offset + nodes + node[first])
            offset += nodes
        parent, step, child = (np.concatenate(x) if len(phrases) else np.empty(0, np.int64) for x in (parents, steps, children))
        bases = self._place(parent, step, offset)
        places = np.zeros(offset + len(phrases), np.int64)
        places[child] = bases[parent] + step
        self.base = np.zeros(self.size, np.int32)
        self.check = np.full(self.size, -1, np.int32)
        self.check[places[child]] = places[parent]
        self.base[places[:offset]] = bases
        self.base[places[offset:]] = np.arange(len(phrases))

    def _place(self, parent: np.ndarray, step: np.ndarray, nodes: int) -> np.ndarray:
        """Bases such that no two edges share a place; place 0 is the root's."""
        degree = np.bincount(parent, minlength=nodes)
        first = np.cumsum(degree) - degree
        bases = np.zeros(nodes, np.int64)
        wide = np.flatnonzero(degree > WIDE)
        bases[wide] = 1 + 256 * np.arange(len(wide))
        low = 1 + 256 * len(wide)
        room = ROOM * int(degree[degree <= WIDE].sum()) + 256
        taken = np.zeros(low + room + 256, bool)
        taken[0] = True
        taken[bases[wide].repeat(degree[wide]) + step[_ranges(first[wide], degree[wide])]] = True
        draw = np.random.default_rng(len(parent))
        for most in (WIDE, 8, 2):  # the widest first, while there is most room
            waiting = np.flatnonzero((degree > 0) & (degree <= most) & (degree > {WIDE: 8, 8: 2, 2: 0}[most]))
            for _ in range(ROUNDS):
                if not len(waiting):
                    break
                tried = draw.integers(1, low + room, len(waiting))
                edges = _ranges(first[waiting], degree[waiting])
                owner = np.repeat(np.arange(len(waiting)), degree[waiting])
                at = tried[owner] + step[edges]
                claim = np.full(len(taken), -1, np.int64)
                claim[at] = owner
                bad = np.bincount(owner, taken[at] | (claim[at] != owner), len(waiting)) > 0
                taken[at[~bad[owner]]] = True
                bases[waiting[~bad]] = tried[~bad]
                waiting = waiting[bad]
            bases[waiting] = len(taken) + 256 * np.arange(len(waiting))
            taken = np.concatenate([taken, np.ones(256 * len(waiting), bool)])
        self.size = len(taken) + 256
        return bases

    def walk(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a phrase starts, and its number. A negative id is in no phrase."""
        at = np.arange(max(len(ids) - self.length + 1, 0))
        state = np.zeros(len(at), np.int64)
        for j in range(self.length):
            word = ids[at + j]
            alive = word >= 0
            at, state, word = at[alive], state[alive], word[alive]
            for shift in range(8 * (self.digits - 1), -1, -8):
                to = self.base[state] + (word >> shift & 255)
                alive = self.check[to] == state
                at, state, word = at[alive], to[alive], word[alive]
        return at, self.base[state].astype(np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start .. start + size - 1 of each pair, one after the other."""
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - sizes), sizes)
