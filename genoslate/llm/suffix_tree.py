"""Suffix order, common prefixes and suffix trees of one bounded group of sequences, in numpy.

Sequences are laid end to end as dense whole numbers. ``levels`` doubles prefixes: level k gives each position the rank of its first
2**k tokens in their order, so the last level is a suffix array cut at that depth. Common prefixes of neighbours in
suffix order are read off the levels, and the internal nodes of the suffix tree are the runs of neighbours whose common prefix doesn't
fall below the node's depth.
"""

from __future__ import annotations

import numpy as np


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs, in their order."""
    return np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)[1]


def levels(tokens: np.ndarray, depth: int, first: int = 1) -> list[np.ndarray]:
    """Ranks of the first ``first``, 2 * first, 4 * first, ... tokens of every suffix, up to ``depth``; ``tokens`` rank the first ones.

    What lies behind the end counts as smallest; callers leave out suffixes that run over the end of their sequence.
    """
    out = [np.unique(tokens, return_inverse=True)[1]]
    at = first
    while 2 * at <= depth:
        r = out[-1]
        out.append(paired(r, np.append(r[at:] + 1, np.zeros(min(at, len(r)), r.dtype))[: len(r)]))
        at *= 2
    return out


def cut_at(ranks: list[np.ndarray], depth: int, first: int = 1) -> np.ndarray:
    """Ranks of the first ``depth`` tokens of every suffix, from its levels."""
    r = ranks[-1]
    rest = depth - (first << (len(ranks) - 1))
    return r if rest <= 0 else paired(r, np.append(r[rest:] + 1, np.zeros(min(rest, len(r)), r.dtype))[: len(r)])


def common_prefix(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the different suffixes at ``a`` and ``b``; the last level is to reach half of the longest."""
    n = len(ranks[0])
    out = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + out, b + out
        inside = np.flatnonzero((x < n) & (y < n))
        out[inside] += (ranks[k][x[inside]] == ranks[k][y[inside]]).astype(np.int64) << k
    return out


def tree_nodes(lcp: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """Internal nodes of depth ``least`` or more as (depth, from, to, parent): leaves from..to-1 in suffix order.

    ``lcp[i]`` is the common prefix of leaves i and i + 1. ``parent`` is the number of the node above, -1 where that one is too shallow.
    Children come before their parents.
    """
    nodes: list[list[int]] = []
    stack: list[tuple[int, int, list[int]]] = []  # depth, first leaf, nodes right below
    for i, depth in enumerate([*lcp.tolist(), -1]):
        start, below = i, []
        while stack and stack[-1][0] > depth:
            deep, start, held = stack.pop()
            for c in held:
                nodes[c][3] = len(nodes)
            nodes.append([deep, start, i + 1, -1])
            below = [len(nodes) - 1]
            if stack and stack[-1][0] >= depth:
                stack[-1][2].extend(below)
                below = []
        if depth >= least and not (stack and stack[-1][0] == depth):
            stack.append((depth, start, below))
    return [tuple(n) for n in nodes]


def left_diverse(before: np.ndarray, start: int, stop: int) -> bool:
    """Whether the leaves start..stop-1 are preceded by different tokens, so that their node can't be extended to the left."""
    own = before[start:stop]
    return bool((own != own[0]).any() or own[0] < 0)
