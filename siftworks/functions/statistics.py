"""Exact and closed-form statistics as scalars."""

from __future__ import annotations

import math
import random


def safe_rate(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def mcnemar_exact(b: int, c: int) -> float:
    """Two-sided exact p value of b against c discordant pairs; 1 without any."""
    n, k = b + c, min(b, c)
    return min(1.0, 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1))) if n else 1.0


def wilson_lower(ok: int, n: int, z: float = 1.645) -> float:
    """One-sided lower bound of a rate; 0 for none."""
    if not n or not ok:
        return 0.0
    p = ok / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def bootstrap_interval(a: list[int], b: list[int], draws: int = 10_000, seed: int = 42) -> tuple[float, float]:
    """95 % interval of the mean difference of paired outcomes by seeded resampling on one machine."""
    rng, n = random.Random(seed), len(a)
    if not n:
        return 0.0, 0.0
    means = sorted(sum(b[i] - a[i] for i in (rng.randrange(n) for _ in range(n))) / n for _ in range(draws))
    return means[int(0.025 * draws)], means[int(0.975 * draws)]
