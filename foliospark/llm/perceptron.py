"""An averaged perceptron over named features."""

from __future__ import annotations

import random
from collections.abc import Iterable, Sequence
from typing import Any

Features = Sequence[tuple]


class Perceptron:
    """Weights of features; a decision is the choice whose features weigh most, the first of equals."""

    def __init__(self, weights: dict[tuple, float] | None = None):
        self.weights = {} if weights is None else weights

    def score(self, features: Iterable[tuple]) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in features])

    def choose(self, choices: Sequence[Features]) -> int:
        scores = [self.score(c) for c in choices]
        return scores.index(max(scores))

    def train(self, samples: list[tuple[Sequence[Features], int]], passes: int = 8, seed: int = 5) -> Perceptron:
        """Samples are choices and the number of the right one; weights are averaged over all steps."""
        order, total, seen = list(range(len(samples))), {}, 0
        shuffled: Any = random.Random(seed)
        for _ in range(passes):
            shuffled.shuffle(order)
            for n in order:
                choices, right = samples[n]
                seen += 1
                said = self.choose(choices)
                if said != right:
                    for sign, features in ((1.0, choices[right]), (-1.0, choices[said])):
                        for f in features:
                            self.weights[f] = self.weights.get(f, 0.0) + sign
                            total[f] = total.get(f, 0.0) + sign * seen
        for f, t in total.items():
            self.weights[f] -= t / max(seen, 1)
        return self
