"""Rank statistics of one series in O(n log n): Kendall's S by counting inversions, the median pairwise slope by selection."""

from __future__ import annotations

import numpy as np

#: Up to so many points all pairs are looked at, which is faster then.
FEW = 256
#: Pairs, for each point, among which the median slope is picked at last.
ENUMERATED = 8


def inversions(ranks: np.ndarray) -> int:
    """Pairs i < j with ranks[i] > ranks[j], for ranks from 0 on, by splitting stably on one bit after the other."""
    total, x = 0, np.asarray(ranks, np.int64)
    n = len(x)
    if n < 2:
        return 0
    for bit in reversed(range(int(x.max()).bit_length())):
        group, one = x >> bit + 1, (x >> bit) & 1
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(starts, n))
        first = np.repeat(starts, sizes)
        before = np.concatenate([[0], np.cumsum(one)])
        ones = before[:-1] - before[first]  # in the group, before the element
        total += int(ones[one == 0].sum())
        zeros = np.repeat(sizes - (before[starts + sizes] - before[starts]), sizes)  # in the whole group
        to = first + np.where(one == 1, zeros + ones, np.arange(n) - first - ones)
        moved = np.empty_like(x)
        moved[to] = x
        x = moved
    return total


def kendall(values: np.ndarray) -> int:
    """Pairs that rise less pairs that fall."""
    values = np.asarray(values)
    n = len(values)
    ranks, counts = np.unique(values, return_inverse=True, return_counts=True)[1:]
    ties = int((counts * (counts - 1) // 2).sum())
    return n * (n - 1) // 2 - ties - 2 * inversions(ranks)


def _order(x: np.ndarray) -> np.ndarray:
    """Rank of each point, earlier points first among equals."""
    out = np.empty(len(x), np.int64)
    out[np.argsort(x, kind="stable")] = np.arange(len(x))
    return out


def _swapped(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of points in another order by `after` than by `before`, by merging halves: O(n log n) and the pairs."""
    n = len(before)
    size = 1 << max(1, (n - 1).bit_length())
    points = np.argsort(before)
    x = np.concatenate([after[points], np.arange(n, size)])  # padding never swaps
    of = np.empty(size, np.int64)
    of[x[:n]] = points
    left, right, width = [], [], 1
    while width < size:
        halves = np.sort(x.reshape(-1, width), axis=1).reshape(-1, 2, width)
        block = np.arange(len(halves), dtype=np.int64)[:, None] * size
        low, high = (halves[:, 0] + block).ravel(), (halves[:, 1] + block).ravel()
        least = np.searchsorted(low, high, side="right")
        most = np.repeat((np.arange(len(halves)) + 1) * width, width)
        counts = most - least
        k = np.repeat(least - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum()))
        left.append(of[low[k] % size])
        right.append(of[np.repeat(high, counts) % size])
        x, width = halves.reshape(-1), 2 * width
    return np.concatenate(left), np.concatenate(right)


def median_slope(pos: np.ndarray, values: np.ndarray) -> float | None:
    """The median of (v_j - v_i) / (pos_j - pos_i) over all pairs i < j of rising positions; None without a pair."""
    pos, values = np.asarray(pos, float), np.asarray(values, float)
    n = len(pos)
    pairs = n * (n - 1) // 2
    if not pairs:
        return None
    if n <= FEW:
        i, j = np.triu_indices(n, 1)
        return float(np.median((values[j] - values[i]) / (pos[j] - pos[i])))
    found = Slopes(pos, values)
    low = found.pick((pairs - 1) // 2)
    return low if pairs % 2 else low + (found.pick(pairs // 2) - low) * 0.5


class Slopes:
    """Order statistics of a series' pairwise slopes.

    A slope is below t just if its points are in reverse order by v - t * pos, so that slopes below t are counted as
    inversions. Bisection narrows an interval about the wanted slope until few pairs have theirs in it; these are listed and
    the slope is picked among them. The interval's ends are moved out by more than rounding can do, so that no pair is
    miscounted. Where more pairs than that share one slope, the interval ends at the width of rounding.
    """

    def __init__(self, pos: np.ndarray, values: np.ndarray):
        self.pos, self.values, n = pos, values, len(pos)
        steps = np.diff(values) / np.diff(pos)
        self.low, self.high = float(steps.min()), float(steps.max())  # every slope is a mean of steps
        size = np.abs(values).max() + max(abs(self.low), abs(self.high)) * np.abs(pos).max()
        self.slack = 16 * np.finfo(float).eps * size / np.diff(pos).min() + np.finfo(float).tiny
        i, j = np.random.default_rng(0).integers(0, n, (2, 4 * n))
        i, j = i[i != j], j[i != j]
        self.some = np.sort((values[i] - values[j]) / (pos[i] - pos[j]))  # only to guess well
        self.seen: dict[float, tuple[int, np.ndarray]] = {}

    def below(self, t: float) -> tuple[int, np.ndarray]:
        """How many slopes are below t, and the points' order there."""
        if t not in self.seen:
            order = _order(self.values - t * self.pos)
            self.seen[t] = inversions(order), order
        return self.seen[t]

    def pick(self, rank: int) -> float:
        """The slope of that rank, from 0, among all pairs."""
        n, slack, low, high = len(self.pos), self.slack, self.low, self.high
        share, wide = 2 * rank / (n * (n - 1)), 3 / np.sqrt(len(self.some))
        guess = [float(self.some[int(np.clip(q, 0, 1) * (len(self.some) - 1))]) for q in (share - wide, share + wide)]
        while True:
            under, over = self.below(low - slack), self.below(high + slack)
            if over[0] - under[0] <= ENUMERATED * n:
                i, j = _swapped(under[1], over[1])
                slopes = (self.values[j] - self.values[i]) / (self.pos[j] - self.pos[i])
                return float(np.partition(slopes, rank - under[0])[rank - under[0]])
            if high - low <= 4 * slack:
                return self.shared((low + high) / 2, low - 2 * slack, high + 2 * slack)
            t = guess.pop() if guess else (low + high) / 2
            if not low < t < high:
                continue
            if self.below(t - slack)[0] > rank:
                high = t
            elif self.below(t + slack)[0] <= rank:
                low = t
            else:
                low = high = t

    def shared(self, t: float, low: float, high: float) -> float:
        """A slope that many pairs share: that of neighbours in the order by v - t * pos, which lie on a line of that slope."""
        order = np.lexsort((self.pos, self.values - t * self.pos))
        i, j = order[:-1], order[1:]
        ahead = self.pos[j] > self.pos[i]
        slopes = (self.values[j] - self.values[i])[ahead] / (self.pos[j] - self.pos[i])[ahead]
        near = float(slopes[np.argmin(np.abs(slopes - t))]) if len(slopes) else t
        return near if low <= near <= high else t
