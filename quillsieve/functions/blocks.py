"""Ratcliff-Obershelp similarity of two strings with linear searches: each longest common block is found by a suffix
automaton, and the count stops as soon as the wanted ratio is certain or out of reach."""

from __future__ import annotations


def longest_block(a: str, b: str) -> tuple[int, int, int]:
    """(begin in a, begin in b, length) of the longest common block; of several the first in a, and there the first in b."""
    moves: list[dict[str, int]] = [{}]
    link, length, ends, last = [-1], [0], [-1], 0
    for k, c in enumerate(b):
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        ends.append(k)  # where the state's strings end first in b
        at = last
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at >= 0:
            other = moves[at][c]
            if length[at] + 1 == length[other]:
                link[new] = other
            else:
                copy = len(moves)
                moves.append(dict(moves[other]))
                length.append(length[at] + 1)
                link.append(link[other])
                ends.append(ends[other])
                while at >= 0 and moves[at].get(c) == other:
                    moves[at][c] = copy
                    at = link[at]
                link[other] = link[new] = copy
        last = new
    state = n = 0
    best = (0, 0, 0)
    for k, c in enumerate(a):
        while state and c not in moves[state]:
            state = link[state]
            n = length[state]
        if c in moves[state]:
            state = moves[state][c]
            n += 1
        else:
            n = 0
        if n > best[2]:
            best = (k - n + 1, ends[state] - n + 1, n)
    return best


def matched(a: str, b: str, least: float | None = None) -> int:
    """Characters in matching blocks. least: stop once it is certain whether the ratio reaches it; the number then
    is only good for that comparison."""
    total, found, left = len(a) + len(b), 0, min(len(a), len(b))
    ranges = [(0, len(a), 0, len(b))]
    while ranges:
        if least is not None and (2.0 * found / total >= least or 2.0 * (found + left) / total < least):
            break
        a0, a1, b0, b1 = ranges.pop()
        left -= min(a1 - a0, b1 - b0)
        i, j, n = longest_block(a[a0:a1], b[b0:b1])
        if n:
            found += n
            for part in ((a0, a0 + i, b0, b0 + j), (a0 + i + n, a1, b0 + j + n, b1)):
                if part[0] < part[1] and part[2] < part[3]:
                    ranges.append(part)
                    left += min(part[1] - part[0], part[3] - part[2])
    return found


def ratio(a: str, b: str) -> float:
    """Twice the matched characters by all characters; 1 for two empty strings."""
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


def reaches(a: str, b: str, least: float) -> bool:
    """Whether the ratio is at least `least`."""
    return 2.0 * matched(a, b, least) / (len(a) + len(b)) >= least if a or b else least <= 1.0
