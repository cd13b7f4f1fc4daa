"""Binary codes of words by how often training text has them, and what is counted at the codes' nodes.

Words that make up at least one in HEAVY of all training tokens have a leaf of their own, so there are at most HEAVY
of them; all others share the leaves of BINS bins by hash. Leaves hang on one Huffman tree; its nodes have
counts by class and over all classes.
"""

from __future__ import annotations

import heapq

import numpy as np

HEAVY, BIN_BITS = 1 << 13, 12
BINS = 1 << BIN_BITS
#: Added to both counts of a node.
PRIOR = 0.1


def bin_of(hashes: np.ndarray) -> np.ndarray:
    """The first bits of the hash, so a shard has few bins."""
    return (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parent of each node and which of its children the node is; leaves first, the root last (its own parent)."""
    n = len(counts)
    heap = list(zip(counts.tolist(), range(n), strict=True))
    heapq.heapify(heap)
    parent, bit = np.arange(2 * n - 1), np.zeros(2 * n - 1, bool)
    for node in range(n, 2 * n - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x] = parent[y] = node
        bit[y] = True
        heapq.heappush(heap, (a + b, node))
    return parent, bit


class Codes:
    """heavy: sorted hashes of words with leaves of their own; counts: by class and leaf, bins after heavy words."""

    def __init__(self, heavy: np.ndarray, counts: np.ndarray):
        n = counts.shape[1]
        parent, bit = huffman(counts.sum(axis=0) + 1)
        leaves, nodes, bits, at = [], [], [], np.arange(n)
        own = np.arange(n)
        while len(own):
            up = parent[at]
            own, at, up = own[up != at], at[up != at], up[up != at]
            leaves.append(own)
            nodes.append(up - n)
            bits.append(bit[at])
            at = up
        leaves, nodes, bits = (np.concatenate(x[::-1]) for x in (leaves, nodes, bits))
        order = np.argsort(leaves, kind="stable")
        # each leaf's bits from the root, one leaf after another: place among the figures by node and bit, hash of the node
        nodes, bits = nodes[order].astype(np.intp), bits[order]
        self.places, self.bits, self.salts = 2 * nodes + bits, bits, nodes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        self.lens = np.bincount(leaves, minlength=n)
        self.starts = np.cumsum(self.lens) - self.lens
        self.heavy = heavy
        #: By class and leaf, and over all classes in the last row.
        self.leaf_counts = np.concatenate([counts, counts.sum(axis=0)[None]]).astype(np.int64)
        # what counts say of a bit by class, node and bit: as they are, and without an occurrence of the word
        counts = np.stack([np.bincount(self.places, np.repeat(row, self.lens), 2 * (n - 1)) for row in self.leaf_counts]).reshape(len(self.leaf_counts), n - 1, 2)
        other = counts[:, :, ::-1]
        sign = np.array([-1, 1])
        logit = lambda own: (sign * (np.log(own + PRIOR) - np.log(other + PRIOR))).astype(np.float32)
        self.logits = [logit(counts).reshape(len(counts), -1), logit(np.maximum(counts - 1, 0)).reshape(len(counts), -1)]

    def leaf_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.heavy):
            return bin_of(hashes)
        at = np.minimum(np.searchsorted(self.heavy, hashes), len(self.heavy) - 1)
        return np.where(self.heavy[at] == hashes, at, len(self.heavy) + bin_of(hashes))

    def expand(self, leaf: np.ndarray, classes: np.ndarray, left_out: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """For all bits of the codes of these leaves: which leaf's, the bit, a hash of its node, what counts in the class and over all say.

        With left_out an occurrence of the word itself is left out.
        """
        lens = self.lens[leaf]
        ends = np.cumsum(lens)
        index = np.arange(int(ends[-1])) + np.repeat(self.starts[leaf] - (ends - lens), lens)
        places, logits = self.places.take(index), self.logits[int(left_out)]
        in_class = logits.ravel().take(places + np.repeat(classes.astype(np.intp) * logits.shape[1], lens))
        return np.repeat(np.arange(len(leaf)), lens), self.bits.take(index), self.salts.take(index), [in_class, logits[-1].take(places)]

    def within(self, leaf: np.ndarray, classes: np.ndarray, in_class: np.ndarray, known: np.ndarray, left_out: np.ndarray) -> np.ndarray:
        """The log10 share of a word in its leaf by counts in the class, to which those over all classes add one."""
        of_class, of_all = self.leaf_counts[classes, leaf] - left_out, self.leaf_counts[-1, leaf] - left_out
        share = (np.maximum(in_class, 0) + known / np.maximum(of_all, 1)) / (np.maximum(of_class, 0) + 1)
        return np.where(leaf < len(self.heavy), 0, np.log10(np.maximum(share, 1e-300)))
