"""Burrows-Wheeler transforms of string collections, and their merge by interleave refinement.

Strings are cyclic, each closed by its own sentinel 0. A shard's transform lists, in sorted
order of its rotations, what precedes them. Shards are merged without sorting rotations again:
the interleave, a list of shard numbers, starts from the rotations' LEAD leading symbols and is
refined by stable counting sorts on the symbols that precede (Holt and McMillan, who take one
symbol a round). Blocks of rotations that agree so far are ranks of that many symbols: a round
refines by as many as an earlier one has ranked, and so depth doubles. Where neighbours part
bounds their common prefix: the blocks left at last are the repeated intervals.
"""

from __future__ import annotations

import numpy as np

#: Symbols by which the interleave starts: as many as a 64-bit number holds.
LEAD = 8


def by_rank(rank: np.ndarray) -> np.ndarray:
    """The stable order of small whole numbers: by counting, 16 bits at a time."""
    if rank.dtype == np.uint16:
        return np.argsort(rank, kind="stable")
    order = np.argsort(rank.astype(np.uint16), kind="stable")
    return order[np.argsort((rank >> 16).astype(np.uint16)[order], kind="stable")]


def narrow(rank: np.ndarray, below: int) -> np.ndarray:
    return rank.astype(np.uint16 if below <= 1 << 16 else np.int32)


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks 0, 1, ... of the keys; equal keys have one rank."""
    order = np.argsort(keys)
    k = keys[order]
    rank = np.empty(len(keys), np.int32)
    rank[order] = np.cumsum(np.r_[0, k[1:] != k[:-1]])
    return narrow(rank, len(keys))


class Transform:
    """One shard: its rotations in sorted order, their leading symbols, and which rotations start some symbols before."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray):
        lengths = np.diff(np.r_[starts, len(symbols)])
        self.start, self.length = np.repeat(starts, lengths).astype(np.int32), np.repeat(lengths, lengths).astype(np.int32)
        self.at = np.arange(len(symbols), dtype=np.int32) - self.start
        self.lead, at, then = np.zeros(len(symbols), np.uint64), np.arange(len(symbols), dtype=np.int32), self.after(1)
        for d in range(LEAD):
            self.lead = (self.lead << np.uint64(8)) | symbols[at]
            at = then[at] if d + 1 < LEAD else at

    def after(self, n: int) -> np.ndarray:
        """Positions n symbols on, around the end of the string."""
        return self.start + (self.at + n) % self.length

    def sort(self, rank: np.ndarray) -> None:
        """rank: of the leading symbols, at every position; doubled until whole rotations are in order."""
        done, longest, order, then = LEAD, int(self.length.max(initial=0)), by_rank(rank), self.after(LEAD)
        sorted_ = rank[order]
        parts = sorted_[1:] != sorted_[:-1]
        while done < longest and not parts.all():
            rank = np.empty(len(order), np.uint16 if len(order) <= 1 << 16 else np.int32)
            rank[order] = np.cumsum(np.r_[0, parts])
            second = rank[then]
            order = by_rank(second)
            order = order[by_rank(rank[order])]
            a, b = rank[order], second[order]
            parts, done, then = (a[1:] != a[:-1]) | (b[1:] != b[:-1]), 2 * done, then[then]
        self.order = order


def merge_shards(shards: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the transforms of shards (symbols below 256, string starts).

    Returns, in merged order of all rotations: the shard, the position in the shard, and the
    block, equal for neighbours whose first `depth` symbols agree. depth is at least LEAD; at
    most 255 shards.
    """
    parts = [Transform(*s) for s in shards]
    sizes = np.array([len(p.at) for p in parts])
    base = np.cumsum(np.r_[0, sizes])[:-1].astype(np.int32)
    leads = np.concatenate([p.lead for p in parts])
    rank = dense(leads)  # of the leading symbols, at the positions of all shards
    for p, b in zip(parts, base.tolist(), strict=True):
        p.sort(rank[b : b + len(p.at)])
    places = np.concatenate([p.order + b for p, b in zip(parts, base.tolist(), strict=True)]).astype(np.int32)
    interleave = np.repeat(np.arange(len(parts), dtype=np.uint8), sizes)
    lead = rank[places]
    at = by_rank(lead).astype(np.int32)  # merges lists that are in order; a shard's rotations keep theirs
    interleave, block, everywhere = interleave[at], lead[at], np.arange(len(at), dtype=np.int32)

    def refined(n: int, ranks: np.ndarray, at, interleave, block):
        """One round, by the n symbols that precede: ranks has those of n leading symbols at every position."""
        before = np.concatenate([b + p.after(-n) for p, b in zip(parts, base.tolist(), strict=True)])
        symbol = ranks[before[places[at]]]
        order = by_rank(symbol)
        symbol, block, interleave = symbol[order], block[order], interleave[order]
        fresh = np.zeros(len(order), np.int32)
        np.logical_or(symbol[1:] != symbol[:-1], block[1:] != block[:-1], out=fresh[1:], casting="unsafe")
        at = np.empty(len(order), np.int32)
        at[np.argsort(interleave, kind="stable")] = everywhere
        return at, interleave, narrow(np.cumsum(fresh, dtype=np.int32), len(order))

    known, done = {LEAD: rank}, LEAD
    while 2 * done <= depth:
        at, interleave, block = refined(done, known[done], at, interleave, block)
        done *= 2
        known[done] = np.empty_like(block)
        known[done][places[at]] = block
    for n in sorted(known, reverse=True):
        while done + n <= depth:
            at, interleave, block = refined(n, known[n], at, interleave, block)
            done += n
    if rest := depth - done:
        at, interleave, block = refined(rest, dense(leads >> np.uint64(8 * (LEAD - rest))), at, interleave, block)
    return interleave, places[at] - base[interleave], block
