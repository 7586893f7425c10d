"""What a run of settlement steps does to a rating, as a function that can be composed.

A clamped step leaves a rating alone on one side of a level and pulls it towards that level on the other:
better than expected it is max(b, a b + k), worse than expected min(b, a b + k), with a = 1 - gamma and k the result
term plus gamma times the target. Both rise with b, so a run of steps is a rising function of straight pieces. A block of
rows is summed up by that function, and functions of following blocks are chained without walking any row again.
"""

from __future__ import annotations

import numpy as np

from ratewright import config as c

#: Pieces over which the function rises by less than this count as level; later steps only shrink the difference.
FLAT = 1e-13
#: Ratings lie within this of zero.
FARTHEST = 1e6
ROOM = 64


class Clamped:
    """A rising function of straight pieces: slope and level of each, and the borders between them."""

    def __init__(self):
        self.borders, self.slope, self.level = np.empty(0), np.ones(1), np.zeros(1)

    @classmethod
    def of(cls, borders, slope, level) -> Clamped:
        f = cls()
        f.borders, f.slope, f.level = (np.asarray(v, dtype=np.float64) for v in (borders, slope, level))
        return f

    def __call__(self, b: float) -> float:
        i = int(np.searchsorted(self.borders, b))
        return float(self.slope[i] * b + self.level[i])

    def step(self, surprise: float, target: float, gamma: float) -> None:
        """Put one settlement step behind this function."""
        if abs(surprise) <= c.SURPRISE_EPS:
            return
        k = c.SETTLE_K * surprise + (gamma * target if gamma else 0.0)
        if gamma == 0.0:
            self.level = self.level + k
            return
        still = k / gamma
        cut = self._split(still)
        part = slice(None, cut) if surprise > 0 else slice(cut, None)
        self.slope[part] *= 1.0 - gamma
        self.level[part] = self.level[part] * (1.0 - gamma) + k
        if len(self.borders) > ROOM:
            self._thin()

    def _split(self, value: float) -> int:
        """Number of pieces below ``value``, after a border is put where the function takes it."""
        ends = self.slope[:-1] * self.borders + self.level[:-1]
        i = int(np.searchsorted(ends, value))
        if self.slope[i] <= 0.0:
            return i + 1 if self.level[i] < value else i
        at = (value - self.level[i]) / self.slope[i]
        if (i and at <= self.borders[i - 1]) or not np.isfinite(at):
            return i
        if i < len(self.borders) and at >= self.borders[i]:
            return i + 1
        self.borders = np.insert(self.borders, i, at)
        self.slope, self.level = (np.insert(v, i, v[i]) for v in (self.slope, self.level))
        return i + 1

    def _thin(self) -> None:
        """Runs of pieces that hardly rise become one level piece; pieces that no rating lies in go."""
        lo, hi = np.searchsorted(self.borders, (-FARTHEST, FARTHEST))
        self.borders, self.slope, self.level = self.borders[lo:hi], self.slope[lo : hi + 1], self.level[lo : hi + 1]
        ends = self.slope[:-1] * self.borders + self.level[:-1]
        flat = np.zeros(len(self.slope), dtype=bool)
        flat[1:-1] = np.diff(ends) <= FLAT
        again = flat & np.concatenate([[False], flat[:-1]])
        heads = np.flatnonzero(flat & ~again & np.concatenate([again[1:], [False]]))
        self.slope[heads], self.level[heads] = 0.0, ends[heads]
        self.slope, self.level, self.borders = self.slope[~again], self.level[~again], self.borders[~again[1:]]
