"""BK-trees over 64-bit fingerprints: many small trees at once, grown and searched level by level."""

from __future__ import annotations

import numpy as np


class Forest:
    """One BK-tree for each group of fingerprints.

    ``group`` is sorted; a group's first row is its root. A row that is not yet
    placed stands at a node; its distance to the node is the edge it follows,
    and the first row to follow an edge becomes the child there.
    """

    def __init__(self, prints: np.ndarray, group: np.ndarray):
        n = len(prints)
        self.prints = prints
        fresh = np.ones(n, bool)
        fresh[1:] = group[1:] != group[:-1]
        self.root = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        rows = np.flatnonzero(~fresh)
        at = self.root[rows]
        while len(rows):
            d = np.bitwise_count(prints[rows] ^ prints[at]).astype(np.int64)
            key = at * 65 + d
            order = np.argsort(key, kind="stable")
            rows, key = rows[order], key[order]
            head = np.ones(len(rows), bool)
            head[1:] = key[1:] != key[:-1]
            child = rows[head]
            parent[child], edge[child] = key[head] // 65, key[head] % 65
            at = child[np.cumsum(head) - 1][~head]
            rows = rows[~head]
        self.kids = np.argsort(parent, kind="stable")[np.count_nonzero(parent < 0) :]
        self.edge = edge
        self.first = np.searchsorted(parent[self.kids], np.arange(n + 1))

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int, block: int = 2048):
        """Yield (query index, tree row) pairs within ``radius``; only edges within the radius are followed."""
        for lo in range(0, len(queries), block):
            q, at = np.arange(lo, min(lo + block, len(queries))), roots[lo : lo + block]
            while len(q):
                d = np.bitwise_count(queries[q] ^ self.prints[at]).astype(np.int64)
                hit = d <= radius
                if hit.any():
                    yield q[hit], at[hit]
                n = self.first[at + 1] - self.first[at]
                which = np.repeat(np.arange(len(q)), n)
                begin = np.cumsum(n) - n
                kid = self.kids[self.first[at][which] + np.arange(len(which)) - begin[which]]
                go = np.abs(self.edge[kid] - d[which]) <= radius
                q, at = q[which[go]], kid[go]


def smallest_linked(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The smallest label that each of n rows reaches over the links a-b."""
    label = label.copy()
    while len(a):
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if (label == old).all():
            break
    return label
