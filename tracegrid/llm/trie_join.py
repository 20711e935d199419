"""The prefix-tree join of sets inside one task.

Sets are lists of tokens in one global order, the most frequent first, and kept
in a trie whose chains are single nodes, so sets with a common beginning share
it. A set walks the trie counting its overlap with each path once for all sets
below. A subtree is left when the overlap so far and all that can still come
(the tokens left on either side) fall short of what its smallest set needs, or
when its sets are all connected to the walking set already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def needed(a: int, b: int, num: int, den: int) -> int:
    """The least overlap of sets of sizes a and b with overlap / union >= num / den."""
    return -(-num * (a + b) // (num + den))


class Trie:
    """Nodes in arrays; the sets below a node are a run of the sorted sets."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.asarray(sizes)[self.order]
        self.children: list[list[int]] = []
        self.segment: list[np.ndarray] = []
        self.run: list[tuple[int, int]] = []
        self.end: list[list[int]] = []  # sets that end at the node
        self.rest: list[int] = []  # most tokens below the node
        self.least: list[int] = []  # size of the smallest set below
        self.most: list[int] = []
        self._build()

    def _common(self, i: int) -> int:
        a, b = self.sets[i], self.sets[i + 1]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def _build(self) -> None:
        lengths = np.array([len(s) for s in self.sets], dtype=np.int64)
        shared = np.array([self._common(i) for i in range(len(self.sets) - 1)], dtype=np.int64)
        work = [(0, len(self.sets), 0, -1)]
        while work:
            lo, hi, depth, parent = work.pop()
            common = int(shared[lo : hi - 1].min()) if hi - lo > 1 else int(lengths[lo])
            node = len(self.segment)
            self.segment.append(self.sets[lo][depth:common])
            self.children.append([])
            self.run.append((lo, hi))
            self.rest.append(int(lengths[lo:hi].max()) - common)
            self.least.append(int(self.sizes[lo:hi].min()))
            self.most.append(int(self.sizes[lo:hi].max()))
            if parent >= 0:
                self.children[parent].append(node)
            first = lo
            while first < hi and lengths[first] == common:
                first += 1
            self.end.append(list(range(lo, first)))
            if first < hi:
                cuts = first + 1 + np.flatnonzero(shared[first : hi - 1] == common)
                bounds = [first, *cuts.tolist(), hi]
                # Pushed in reverse, so that nodes come out in the order of their runs.
                work += [(x, y, common, node) for x, y in reversed(list(zip(bounds[:-1], bounds[1:], strict=True)))]


def trie_links(
    sets: list[np.ndarray], sizes: np.ndarray, num: int, den: int, every: bool = False, joined: np.ndarray | None = None
) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of sets with overlap / union >= num / den.

    ``sizes`` are the whole sizes: a set may have tokens that no other set has,
    which its list leaves out. With ``every`` all such pairs; else as many as
    connect what is connected. ``joined`` may name components known before.
    """
    if len(sets) < 2:
        return
    trie = Trie(sets, sizes)
    component = np.arange(len(sets)) if joined is None else np.unique(joined[trie.order], return_inverse=True)[1]
    width = max((int(s[-1]) for s in sets if len(s)), default=0) + 1
    marked = np.zeros(width, dtype=bool)
    for i in range(len(sets) - 1):
        own, size = trie.sets[i], int(trie.sizes[i])
        marked[own] = True
        stack = [(0, 0)]
        while stack:
            node, overlap = stack.pop()
            lo, hi = trie.run[node]
            if hi <= i + 1 or trie.most[node] * den < size * num or trie.least[node] * num > size * den:
                continue
            if not every and (component[max(lo, i + 1) : hi] == component[i]).all():
                continue
            segment = trie.segment[node]
            if len(segment):
                overlap += int(np.count_nonzero(marked[segment]))
                left = len(own) - int(np.searchsorted(own, segment[-1], side="right"))
            else:
                left = len(own)
            if overlap + min(left, trie.rest[node]) < needed(size, trie.least[node], num, den):
                continue
            for j in trie.end[node]:
                if j > i and overlap >= needed(size, int(trie.sizes[j]), num, den):
                    if every:
                        yield trie.order[i], trie.order[j]
                    elif component[i] != component[j]:
                        component[component == component[j]] = component[i]
                        yield trie.order[i], trie.order[j]
            stack += [(child, overlap) for child in reversed(trie.children[node])]
        marked[own] = False
