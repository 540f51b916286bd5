"""A tree as balanced parentheses: an open one where a node begins in preorder, a close one where it ends."""

from __future__ import annotations

import numpy as np

BLOCK = 64
QUERIES_AT_ONCE = 1 << 14


class Parens:
    """`bits` is true for an open parenthesis. The excess at a place is how many are open after it.

    Over blocks of excess stands a tree of their least and greatest values, by which a search for the next place
    of a given excess skips whole blocks.
    """

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.opens = np.flatnonzero(bits)
        excess = np.cumsum(np.where(bits, 1, -1))
        blocks = 1 << max(0, (-(-len(bits) // BLOCK) - 1)).bit_length()
        # What is added at the end is never searched for.
        padded = np.full(blocks * BLOCK, len(bits) + 1)
        padded[: len(bits)] = excess
        self.excess = padded.reshape(blocks, BLOCK)
        self.least, self.most = [self.excess.min(axis=1)], [self.excess.max(axis=1)]
        while len(self.least[-1]) > 1:
            self.least.append(self.least[-1].reshape(-1, 2).min(axis=1))
            self.most.append(self.most[-1].reshape(-1, 2).max(axis=1))
        pairs = bits.copy()
        pairs[:-1] &= ~bits[1:]
        self.leaves = pairs  # an open parenthesis closed at once

    def find_close(self) -> np.ndarray:
        """For every node in preorder, the place of its close parenthesis."""
        found = [self._next_below(self.opens[at : at + QUERIES_AT_ONCE]) for at in range(0, len(self.opens), QUERIES_AT_ONCE)]
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)

    def leaf_rank(self) -> np.ndarray:
        """How many leaves begin before each place."""
        return np.append(0, np.cumsum(self.leaves))

    def _holds(self, level: int, node: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        return (self.least[level][node] <= wanted) & (wanted <= self.most[level][node])

    def _next_below(self, places: np.ndarray) -> np.ndarray:
        """The first later place whose excess is one less than before the open parenthesis there."""
        block, at = np.divmod(places, BLOCK)
        wanted = self.excess[block, at] - 1
        near = (self.excess[block] == wanted[:, None]) & (np.arange(BLOCK) > at[:, None])
        inside = near.any(axis=1)
        found = block * BLOCK + near.argmax(axis=1)
        far = np.flatnonzero(~inside)
        if len(far):
            later = self._next_block(block[far], wanted[far])
            found[far] = later * BLOCK + (self.excess[later] == wanted[far, None]).argmax(axis=1)
        return found

    def _next_block(self, block: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The first later block that has the wanted excess: up the tree, and down again."""
        node, level = block.copy(), np.full(len(block), -1)
        climbing = np.ones(len(block), dtype=bool)
        for height in range(len(self.least) - 1):
            beside = np.minimum(node + 1, len(self.least[height]) - 1)
            right = climbing & (node % 2 == 0) & self._holds(height, beside, wanted)
            node[right] += 1
            level[right] = height
            climbing &= ~right
            node[climbing] >>= 1
        for height in range(len(self.least) - 1, 0, -1):
            own = np.flatnonzero(level == height)
            left = node[own] * 2
            node[own] = np.where(self._holds(height - 1, left, wanted[own]), left, left + 1)
            level[own] -= 1
        return node


def least_between(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The smallest value of each range, none of them empty, from minima over powers of two."""
    spans, table = ends - starts, values
    found = np.empty(len(starts), dtype=values.dtype)
    height = np.frexp(spans.astype(float))[1] - 1
    for level in range(int(height.max(initial=0)) + 1):
        own = np.flatnonzero(height == level)
        found[own] = np.minimum(table[starts[own]], table[ends[own] - (1 << level)])
        step = 1 << level
        table = np.minimum(table[:-step], table[step:]) if len(table) > step else table
    return found
