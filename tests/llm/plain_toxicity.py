"""The toxicity models in one place, by plain loops over dictionaries: what the operator's tables are compared with."""

import math
from collections import Counter

import numpy as np

from formbook.llm.toxicity import DISCOUNT, LETTERS, ORDER, PRIOR, LetterModel, features_of, words_of


class SharedModel:
    """Interpolated Kneser-Ney over both classes: counts at the top, continuation counts below."""

    def __init__(self, counts: dict[str, int]):
        self.levels = [self._level(counts)]
        grams = set(counts)
        for _ in range(ORDER - 1):
            shorter = Counter(g[1:] for g in grams if len(g) > 1)
            if not shorter:
                break
            self.levels.append(self._level(shorter))
            grams = set(shorter)

    @staticmethod
    def _level(counts: dict[str, int]) -> tuple[dict, Counter, Counter]:
        total, types = Counter(), Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            types[g[:-1]] += 1
        return counts, total, types

    def probability(self, gram: str, level: int = 0) -> float:
        """Of the gram's last letter after the others."""
        if level == len(self.levels) or not gram:
            return 1.0 / LETTERS
        counts, total, types = self.levels[level]
        n = total.get(gram[:-1])
        lower = self.probability(gram[1:], level + 1)
        if not n:
            return lower
        return (max(counts.get(gram, 0) - DISCOUNT, 0.0) + DISCOUNT * types[gram[:-1]] * lower) / n


def letter_model(rows: list[tuple[str, int, int]]) -> LetterModel:
    """From (sequence, toxic count, ordinary count)."""
    counts = [{g: t for g, t, _ in rows if t}, {g: o for g, _, o in rows if o}]
    if not counts[0] or not counts[1]:
        return LetterModel({}, {})
    shared = SharedModel({g: t + o for g, t, o in rows})
    levels = [SharedModel._level(c) for c in counts]

    def mass(c: int, context: str) -> tuple[float, float]:
        """(what the class hands to the shared model, what it divides by)."""
        n = levels[c][1].get(context, 0)
        return DISCOUNT * levels[c][2].get(context, 0) + PRIOR, n + PRIOR

    grams, default = {}, {}
    for context in {g[:-1] for g, _, _ in rows}:
        (a, n), (b, m) = mass(0, context), mass(1, context)
        default[context] = math.log(a / n) - math.log(b / m)
    for g, toxic, ordinary in rows:
        p, (a, n), (b, m) = shared.probability(g), mass(0, g[:-1]), mass(1, g[:-1])
        grams[g] = math.log((max(toxic - DISCOUNT, 0.0) + a * p) / n) - math.log((max(ordinary - DISCOUNT, 0.0) + b * p) / m)
    return LetterModel(grams, default)


def features(model: LetterModel, text: str | None) -> np.ndarray:
    counts = Counter(words_of(text))
    row = features_of(np.array([model.word(w) for w in counts]), np.array(list(counts.values())), np.array([len(w) + 1 for w in counts]))
    return np.array([row])
