"""Gaussian mixtures given as three arrays of equal length: moments, seeded draws, intervals, pinball loss."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def mean(weights: Column, means: Column) -> Column:
    return _sum(F.zip_with(weights, means, lambda w, m: w * m))


def variance(weights: Column, means: Column, deviations: Column) -> Column:
    square = _sum(F.zip_with(weights, F.zip_with(means, deviations, lambda m, s: m * m + s * s), lambda w, x: w * x))
    return square - F.pow(mean(weights, means), F.lit(2))


def mode(weights: Column, means: Column) -> Column:
    """The mean of the heaviest part, the first of equal ones."""
    return F.element_at(means, F.array_position(weights, F.array_max(weights)).cast("int"))


def uniform(key: Column, seed: int, k: Column) -> Column:
    """A number within (0, 1) that follows from a row's key, a seed and the draw's number, so it is the same in whatever partition the row is."""
    return (F.pmod(F.xxhash64(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), k.cast("string"))), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def draws(key: Column, weights: Column, means: Column, deviations: Column, n: int, seed: int = 42) -> Column:
    """``n`` values of the mixture in rising order: one number picks the part by the running weights, two make a normal deviate (Box and Muller)."""
    upto = F.transform(weights, lambda w, i: _sum(F.slice(weights, F.lit(1), i + 1)))

    def one(k: Column) -> Column:
        pick = uniform(key, seed, k * 3) * F.element_at(upto, -1)
        part = F.least(F.size(F.filter(upto, lambda u: u <= pick)), F.size(weights) - 1)
        normal = F.sqrt(-2 * F.log(uniform(key, seed, k * 3 + 1))) * F.cos(2 * math.pi * uniform(key, seed, k * 3 + 2))
        return F.get(means, part) + F.get(deviations, part) * normal

    return F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one))


def percentile(rising: Column, share: float) -> Column:
    """Of an array in rising order, linear between neighbours."""
    place = (F.size(rising) - 1) * F.lit(float(share))
    low = F.floor(place).cast("int")
    a, b = F.get(rising, low), F.get(rising, F.least(low + 1, F.size(rising) - 1))
    return a + (b - a) * (place - low)


def pinball(actual: Column, predicted: Column, share: float) -> Column:
    off = actual - predicted
    return F.greatest(off * share, off * (share - 1))
