"""Model-guided search of parameters: a tree-structured Parzen estimator over a table of trials.

Finished trials are parted into good and bad ones by score. For each parameter both parts give a
density, a mixture of bells around their values and one wide bell over the whole range; of some draws
from the good density the one whose share of good to bad is greatest is tried next. Trials that still
run count as bad ones, so that a batch spreads out. A trial's draws follow from the seed, its number
and the trials before it.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Range:
    name: str
    low: float
    high: float
    whole: bool = False

    def value(self, x: float) -> float | int:
        return min(int(self.high), max(int(self.low), round(x))) if self.whole else min(self.high, max(self.low, x))


@dataclass(frozen=True)
class Sampler:
    ranges: tuple[Range, ...]
    seed: int = 5
    #: Trials that are drawn blindly before there is a model.
    blind: int = 10
    #: Draws of which the best is tried.
    draws: int = 24
    #: Share of trials that are good, and the most that are.
    good: float = 0.1
    most_good: int = 25

    def ask(self, number: int, done: Sequence[tuple[dict, float]], running: Sequence[dict] = ()) -> dict:
        """The parameters to try next: `done` are (parameters, score), the greater the better."""
        rng = random.Random(f"{self.seed}/{number}")
        if len(done) < self.blind:
            return {r.name: r.value(rng.uniform(r.low - 0.5 * r.whole, r.high + 0.5 * r.whole)) for r in self.ranges}
        order = sorted(range(len(done)), key=lambda k: (-done[k][1], k))
        n = min(math.ceil(self.good * len(done)), self.most_good)
        good, bad = ([done[k][0] for k in part] for part in (order[:n], order[n:]))
        out = {}
        for r in self.ranges:
            better, worse = (_Bells(r, [float(t[r.name]) for t in part]) for part in (good, [*bad, *running]))
            tried = [r.value(better.draw(rng)) for _ in range(self.draws)]
            out[r.name] = max(tried, key=lambda x: better.log(x) - worse.log(x))
        return out


class _Bells:
    """A mixture of normal densities, cut to a range."""

    def __init__(self, r: Range, values: Sequence[float]) -> None:
        edge = 0.5 if r.whole else 0.0
        self.low, self.high = r.low - edge, r.high + edge
        span = self.high - self.low or 1.0
        at = sorted([*values, (self.low + self.high) / 2])
        ends = [self.low, *at, self.high]
        # As wide as the greater gap beside it, not too narrow for how many there are.
        least = span / min(100.0, 1.0 + len(at))
        prior = at.index((self.low + self.high) / 2)
        self.bells = [(c, span if k == prior else min(span, max(least, c - ends[k], ends[k + 2] - c))) for k, c in enumerate(at)]

    def draw(self, rng: random.Random) -> float:
        c, s = rng.choice(self.bells)
        for _ in range(100):
            x = rng.gauss(c, s)
            if self.low <= x <= self.high:
                return x
        return rng.uniform(self.low, self.high)

    def log(self, x: float) -> float:
        below = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
        total = 0.0
        for c, s in self.bells:
            inside = below((self.high - c) / s) - below((self.low - c) / s)
            total += math.exp(-0.5 * ((x - c) / s) ** 2) / (s * math.sqrt(2 * math.pi) * max(inside, 1e-12))
        return math.log(max(total / len(self.bells), 1e-300))
