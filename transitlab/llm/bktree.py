"""BK-trees over 64-bit fingerprints as flat numpy arrays, many trees at once.

Each shard has a tree of its own. A node's children are keyed by their integer
Hamming distance to it; a search follows only the edges whose key lies within the
radius of the distance from the query to the node.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... (count[i] of them), one run after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)


@dataclass
class Forest:
    """Trees over ``values``; node i holds value i; ``edge_key`` is 128 * parent + distance, ascending."""

    values: np.ndarray
    edge_key: np.ndarray
    edge_child: np.ndarray

    @classmethod
    def build(cls, values: np.ndarray, root: np.ndarray) -> "Forest":
        """``root[i]`` is the index of the root of i's tree. Equal values in a tree hang on an edge of distance 0."""
        at = np.flatnonzero(root != np.arange(len(values)))
        parent = root[at]
        keys, children = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(at):
            key = parent * 128 + np.bitwise_count(values[at] ^ values[parent]).astype(np.int64)
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            new = np.r_[True, key[1:] != key[:-1]]  # the first point on an edge becomes the child there
            keys.append(key[new])
            children.append(at[new])
            parent = at[new][np.cumsum(new) - 1][~new]
            at = at[~new]
        edge_key, edge_child = np.concatenate(keys), np.concatenate(children)
        order = np.argsort(edge_key, kind="stable")
        return cls(values, edge_key[order], edge_child[order])

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index of the query, node) at most ``radius`` bits apart; query i searches the tree at ``roots[i]``."""
        query, node = np.arange(len(queries)), roots
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query):
            distance = np.bitwise_count(queries[query] ^ self.values[node]).astype(np.int64)
            near = distance <= radius
            found.append((query[near], node[near]))
            low = np.searchsorted(self.edge_key, node * 128 + np.maximum(distance - radius, 0), "left")
            high = np.searchsorted(self.edge_key, node * 128 + distance + radius, "right")
            query = np.repeat(query, high - low)
            node = self.edge_child[runs(low, high - low)]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the components of a[i] and b[i]; a label is the least index in its component."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[label])
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new
