"""Similarity scores of strings from 0 to 100, by their public definitions.

``ratio`` is twice the longest common subsequence over the summed lengths; the others reduce to it over
windows, sorted tokens or token sets. An empty side scores 0.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word of rows at a time."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for c in b:
        hit = open_ & where.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * _lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string against stretches of the longer that are no longer than it."""
    if not a or not b:
        return 0.0

    def one(short: str, long: str) -> float:
        n, best = len(short), 0.0
        letters = set(short)
        for i in range(1 - n, len(long)):
            part = long[max(0, i) : i + n]
            if part and part[-1] in letters or i + n > len(long):
                best = max(best, ratio(short, part))
                if best == 100.0:
                    break
        return best

    if len(a) == len(b):
        return max(one(a, b), one(b, a))
    return one(*sorted((a, b), key=len))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 100.0
    base = " ".join(both)
    left, right = " ".join([*both, *only_x]), " ".join([*both, *only_y])
    found = ratio(left, right)
    return max(found, ratio(base, left), ratio(base, right)) if both else found


def _partial_token(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(" ".join(sorted(x - y)), " ".join(sorted(y - x))))


def weighted_ratio(a: str, b: str) -> float:
    """The best of the scores, weighted by how much the lengths differ."""
    if not a or not b:
        return 0.0
    size = max(len(a), len(b)) / min(len(a), len(b))
    plain = ratio(a, b)
    if size < 1.5:
        return max(plain, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if size <= 8 else 0.6
    return max(plain, scale * partial_ratio(a, b), 0.95 * scale * _partial_token(a, b))


SCORERS: dict[str, Callable[[str, str], float]] = {
    "ratio": ratio, "partial_ratio": partial_ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio, "WRatio": weighted_ratio,
}


def scorer(name: str) -> Callable[[str, str], float]:
    """The scorer of that name; unknown names give the weighted ratio."""
    return SCORERS.get(name, weighted_ratio)


def _batched(score: Callable[[str, str], float]):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([score(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(run, "double")


def register(spark: SparkSession, prefix: str = "sim_") -> list[str]:
    """Makes every scorer callable from SQL (``sim_wratio(a, b)`` and so on), in Arrow batches; null where a side is null. Gives the names."""
    for name, score in SCORERS.items():
        spark.udf.register(prefix + name.lower(), _batched(score))
    return [prefix + name.lower() for name in SCORERS]
