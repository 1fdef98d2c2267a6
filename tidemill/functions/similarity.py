"""Indel similarity of texts: 200 * LCS / (len a + len b), and its token forms. Bit-parallel, for use inside Arrow batches.

With ``least`` a value is exact where it reaches ``least``; else it is 0, mostly found without comparing whole texts.
"""

from __future__ import annotations

#: Characters after which a comparison looks whether it can still reach its least value.
LOOK = 64


def _common_prefix(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _lcs(a: str, b: str, least: int = 0) -> int:
    """Length of the longest common subsequence, many positions at a time in one big integer; -1 where it is under ``least``."""
    same = _common_prefix(a, b)
    a, b = a[same:], b[same:]
    back = _common_prefix(a[::-1], b[::-1])
    a, b, same = a[: len(a) - back], b[: len(b) - back], same + back
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return same if same >= least else -1
    # so many characters of each may be left out, which also is how far apart two common ones can stand
    needed = max(least - same, 0)
    ahead, behind = len(a) - needed, len(b) - needed
    if behind < 0:
        return -1
    places: dict[str, int] = {}
    lo = hi = open_ = found = 0
    for k in range(0, len(b), LOOK):
        end = min(k + LOOK, len(b))
        first, last = max(k - behind, 0), min(end + ahead, len(a))
        for i in range(hi, last):
            places[a[i]] = places.get(a[i], 0) | (1 << i)
        found += first - lo - (open_ & ((1 << (first - lo)) - 1)).bit_count()
        open_ = open_ >> (first - lo) | ((1 << (last - hi)) - 1) << (hi - first)
        lo, hi = first, last
        full, near = (1 << (hi - lo)) - 1, {}
        for c in b[k:end]:
            if c not in near:
                near[c] = places.get(c, 0) >> lo
            hit = open_ & near[c]
            if hit:
                open_ = ((open_ + hit) | (open_ - hit)) & full
        # beginnings of which as much is left can have no more in common than they have here and all that is left
        at = len(a) - len(b) + end - lo
        if same + found + at - (open_ & ((1 << at) - 1)).bit_count() + len(b) - end < least:
            return -1
    found += same + hi - lo - open_.bit_count()
    return found if found >= least else -1


def ratio_of(a: str | None, b: str | None, least: float = 0.0) -> float:
    a, b = a or "", b or ""
    n = len(a) + len(b)
    if not n:
        return 100.0
    needed = max(int(least * n / 200) - 1, 0)
    while 200.0 * needed / n < least:
        needed += 1
    if needed > min(len(a), len(b)):
        return 0.0
    found = _lcs(a, b, needed)
    return 200.0 * found / n if found >= 0 else 0.0


def token_sort_of(a: str | None, b: str | None, least: float = 0.0) -> float:
    return ratio_of(" ".join(sorted((a or "").split())), " ".join(sorted((b or "").split())), least)


def token_set_of(a: str | None, b: str | None, least: float = 0.0) -> float:
    """Common words against the words of each side; 100 where one side holds only common words."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    both, one, two = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not one or not two):
        return 100.0
    left, right = f"{both} {one}".strip(), f"{both} {two}".strip()
    best = ratio_of(left, right, least)
    return max(best, ratio_of(both, left, least), ratio_of(both, right, least)) if both else best
