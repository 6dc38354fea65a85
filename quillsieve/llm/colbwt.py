"""Burrows-Wheeler transform and common prefixes of a collection, built column by column.

Round r inserts the suffix of r symbols of every sequence that is long enough: its place follows from the
place of the suffix before it and the transform so far (rank of the inserted symbol), and its common prefix
with its neighbours from the smallest common prefix between equal symbols. No suffix is ever compared. A
round reads and writes the transform and the common prefixes once, front to back.

repeated() uses blocks of `block` bytes as symbols, and each string once for each phase, so that a window at
any byte is a run of whole symbols and the rounds are fewer by that factor.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MIX = 0x9E3779B97F4A7C15
BASE = 0x100000001B3


def window_hashes(data: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of all runs of `width` bytes, from hashes of runs of powers of two."""
    mask = (1 << 64) - 1
    power = data.astype(np.uint64) + np.uint64(1 + seed)
    power *= np.uint64(MIX)
    power ^= power >> np.uint64(29)
    n, done, out, size = len(data) - width + 1, 0, None, 1
    while True:
        if width & size:
            part = power[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(BASE + 2 * seed, size, 1 << 64)) + part
            done += size
        if 2 * size > width:
            break
        power = power[:-size] * np.uint64(pow(BASE + 2 * seed, size, 1 << 64)) + power[size:]
        size *= 2
    out *= np.uint64(MIX & mask)
    out ^= out >> np.uint64(32)
    return out


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low .. high - 1]) of each non-empty range; values has one entry more than any range reaches."""
    if not len(low):
        return np.zeros(0, values.dtype)
    pairs = np.empty(2 * len(low), np.int64)
    pairs[::2], pairs[1::2] = low, high
    return np.minimum.reduceat(values, pairs)[::2]


def build(flat: np.ndarray, sizes: np.ndarray, single: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bwt, lcp, rows) of the sequences laid end to end in flat, of symbols from 1 on: symbol before each
    sorted suffix, 0 where there is none; common prefix of each with the one before it; the row of each whole
    sequence. The first rows are the empty suffixes. The symbol `single` stands for ones that occur once: it
    never equals another."""
    m = len(sizes)
    last = np.cumsum(sizes) - 1
    bwt = np.zeros(m, flat.dtype)
    bwt[sizes > 0] = flat[last[sizes > 0]]
    lcp = np.zeros(m + 1, np.uint16)
    place, active = np.arange(m), np.flatnonzero(sizes > 0)
    rounds = 0
    while len(active):
        rounds += 1
        order = np.argsort(bwt, kind="stable")
        n, p = len(bwt), place[active]
        zeros = n - int(np.count_nonzero(bwt))
        at = np.empty(n, np.int32)
        at[order] = np.arange(n, dtype=np.int32)
        spot = at[p].astype(np.int64)
        sort = np.argsort(spot)
        spot, p, ids = spot[sort], p[sort], active[sort]
        symbol = bwt[p]
        new = spot - zeros + m
        before = order[spot - 1]
        has = (spot > 0) & (bwt[before] == symbol) & (symbol != single)
        up = np.zeros(len(p), np.uint16)
        up[has] = 1 + _range_min(lcp, before[has] + 1, p[has] + 1)
        after = order[np.minimum(spot + 1, n - 1)]
        has = (spot + 1 < n) & (bwt[after] == symbol) & (symbol != single)
        down = np.zeros(len(p), np.uint16)
        down[has] = 1 + _range_min(lcp, p[has] + 1, after[has] + 1)
        size = n + len(p)
        old = np.ones(size, bool)
        old[new] = False
        bwt_next, lcp_next = np.empty(size, bwt.dtype), np.zeros(size + 1, np.uint16)
        bwt_next[old], lcp_next[:size][old] = bwt, lcp[:n]
        following = np.zeros(len(ids), bwt.dtype)
        more = sizes[ids] > rounds
        following[more] = flat[last[ids[more]] - rounds]
        bwt_next[new] = following
        inside = new + 1 < size
        lcp_next[new[inside] + 1] = down[inside]
        lcp_next[new] = up
        bwt, lcp = bwt_next, lcp_next
        ended = sizes < rounds
        place[ended] += np.searchsorted(new - np.arange(len(new)), place[ended], side="right")
        place[ids] = new
        active = active[sizes[active] > rounds]
    return bwt, lcp, place


@lru_cache(maxsize=4096)
def _phases(n: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Places 0 .. n - 1 by phase then order; how many each phase has."""
    order = np.argsort(np.arange(n) % block, kind="stable")
    return order, np.bincount(np.arange(n) % block, minlength=block)


def repeated(strings: list[bytes], width: int, block: int = 20) -> list[np.ndarray]:
    """For each string, whether the `width` bytes from each place on also begin at another place of the
    collection. block divides width."""
    out = [np.zeros(max(len(s) - width + 1, 0), bool) for s in strings]
    long = [j for j, s in enumerate(strings) if len(s) >= width]
    if not long:
        return out
    need, counts = width // block, [len(strings[j]) - block + 1 for j in long]
    hashes = window_hashes(np.frombuffer(b"".join(strings[j] for j in long), np.uint8), block)
    starts = np.cumsum([0, *(len(strings[j]) for j in long)])[:-1]
    plans = [_phases(n, block) for n in counts]
    places = np.concatenate([s + order for s, (order, _) in zip(starts.tolist(), plans)])
    sizes = np.concatenate([c for _, c in plans]).astype(np.int64)
    _, symbol, times = np.unique(hashes[places], return_inverse=True, return_counts=True)
    names = np.zeros(len(times), np.int64)
    often = times > 1
    names[often] = np.arange(2, 2 + int(often.sum()))
    names[~often] = 1
    flat = names[symbol]
    flat = flat.astype(np.uint16 if len(flat) == 0 or flat.max() < 1 << 16 else np.int64)
    bwt, lcp, place = build(flat, sizes, single=1)
    m = len(sizes)
    order = np.argsort(bwt, kind="stable")
    zeros = len(bwt) - int(np.count_nonzero(bwt))
    near = np.maximum(lcp[:-1], lcp[1:]) >= need
    marks = np.zeros(len(flat), bool)
    begin = np.cumsum(sizes) - sizes
    ids = np.flatnonzero(sizes >= need)
    rows, k = place[ids], 0
    while len(ids):
        marks[begin[ids] + k] = near[rows]
        k += 1
        stay = sizes[ids] - k >= need
        ids, rows = ids[stay], rows[stay]
        rows = order[rows - m + zeros]
    done = np.zeros(len(hashes), bool)
    done[places] = marks
    for j, s in zip(long, starts.tolist()):
        out[j][:] = done[s : s + len(out[j])]
    return out
