"""A hierarchical Hamming index of fingerprints in Gray order.

Fingerprints of 128 bits are sorted by their rank in the Gray code within their group (a masked pattern that all of a
group's members share exactly). Fingerprints that share their first bits have neighbouring ranks, so every node of
the index is a run of the sorted order: its members share a longer mask than their parent's, and the pattern behind
the mask is kept once, however many members it has. Two nodes are compared by the bits that their masks add; the
differences are added to those of their parents, and a pair of nodes whose accumulated differences exceed what
similar fingerprints show behind a mask of that length is dropped with all that lies below it. Only pairs that pass
every upper node are compared as whole fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Bits behind the masks of the levels of nodes; the last level are whole fingerprints.
MASKS = (8, 16, 32, 64, 128)


def gray_rank(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of 128-bit Gray codes: every bit is the parity of the code's bits from the top down to it."""
    hi, lo = hi.copy(), lo.copy()
    for s in (1, 2, 4, 8, 16, 32):
        hi ^= hi >> np.uint64(s)
        lo ^= lo >> np.uint64(s)
    return hi, np.where(hi & np.uint64(1), ~lo, lo)


def difference_budgets(apart: float, upper: float = 0.02, whole: float = 1e-5) -> tuple[int, ...]:
    """How many differences a pair may have accumulated at each of MASKS if each bit differs with probability `apart`:
    more happen with a probability of at most `upper` (at most `whole` at the last level)."""
    out = []
    for bits in MASKS:
        loss, mass, k = whole if bits == MASKS[-1] else upper, 0.0, 0
        while True:
            mass += math.comb(bits, k) * apart**k * (1 - apart) ** (bits - k)
            if 1 - mass <= loss:
                break
            k += 1
        out.append(k)
    return tuple(out)


def _prefix(hi: np.ndarray, lo: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    if bits >= 128:
        return hi, lo
    if bits > 64:
        return hi, lo >> np.uint64(128 - bits)
    return hi >> np.uint64(64 - bits), np.zeros_like(lo)


class GrayIndex:
    """Many groups in one index: nodes are only compared within their group. `compared` counts the pairs of nodes
    compared at each level, the last entry the pairs of whole fingerprints."""

    def __init__(self, group: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> None:
        rh, rl = gray_rank(hi, lo)
        self.order = np.lexsort((rl, rh, group))
        group, hi, lo = group[self.order], hi[self.order], lo[self.order]
        n = len(group)
        new = np.ones(n, dtype=bool)
        new[1:] = group[1:] != group[:-1]
        starts, self.codes, done = [np.flatnonzero(new)], [], 0
        for bits in MASKS:
            a, b = _prefix(hi, lo, bits)
            new[1:] |= (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            at = np.flatnonzero(new)
            starts.append(at)
            # of each node only the bits that its mask adds to its parent's
            if done >= 64:
                own = lo[at] & np.uint64((1 << (128 - done)) - 1)
            else:
                own = a[at] & np.uint64((1 << (bits - done)) - 1)
            self.codes.append(own)
            done = bits
        starts.append(np.arange(n))
        # children of node k of a level: nodes first[k] to first[k + 1] of the next
        self.first = [np.concatenate([np.searchsorted(low, up), [len(low)]]) for up, low in zip(starts, starts[1:])]
        self.compared = np.zeros(len(MASKS), dtype=np.int64)

    def _products(self, level: int, x: np.ndarray, y: np.ndarray, acc: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(child of x, child of y, differences so far) of all pairs of children, in pieces of about `block`."""
        first = self.first[level]
        ax, ay, ny = first[x], first[y], first[y + 1] - first[y]
        nx = first[x + 1] - ax
        per = np.maximum(1, block // np.maximum(ny, 1))  # children of x that one piece takes
        cuts = -(-nx // per)
        k = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        src = np.repeat(np.arange(len(x)), cuts)
        low = ax[src] + k * per[src]
        size = np.minimum(per[src], ax[src] + nx[src] - low)
        total = size * ny[src]
        edge = np.concatenate([[0], np.cumsum(total)])
        at = 0
        while at < len(src):
            stop = max(at + 1, int(np.searchsorted(edge, edge[at] + block, side="right")) - 1)
            t = total[at:stop]
            s = src[at:stop]
            j = np.arange(t.sum()) - np.repeat(edge[at:stop] - edge[at], t)
            w = np.repeat(ny[s], t)
            cx, cy = np.repeat(low[at:stop], t) + j // w, np.repeat(ay[s], t) + j % w
            own = np.repeat(acc[s], t)
            same = np.repeat(x[s] == y[s], t)
            keep = ~same | (cx <= cy)
            yield cx[keep], cy[keep], own[keep]
            at = stop

    def self_join(self, budgets: tuple[int, ...], block: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (positions in the input) within the budgets at every level and within one group, each once."""
        roots = np.arange(len(self.first[0]) - 1)
        stack = [(0, roots, roots, np.zeros(len(roots), dtype=np.int64))]
        last = len(MASKS)
        while stack:
            level, x, y, acc = stack.pop()
            for cx, cy, a in self._products(level, x, y, acc, block):
                if level == last:  # members of fingerprints that passed
                    keep = cx < cy
                    if keep.any():
                        yield self.order[cx[keep]], self.order[cy[keep]]
                    continue
                self.compared[level] += int((cx != cy).sum())
                a = a + np.bitwise_count(self.codes[level][cx] ^ self.codes[level][cy])
                near = a <= budgets[level]
                if near.any():
                    stack.append((level + 1, cx[near], cy[near], a[near]))
