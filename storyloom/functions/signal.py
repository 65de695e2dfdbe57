"""Samples in arrays: linear resampling at rational places, and a level meter that rises faster than it falls."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gain of the meter, and how far it goes towards a higher and a lower target at each step.
GAIN, RISE, FALL = 3.2, 0.45, 0.12


def resample(pcm: Column, source: int, target: int) -> Column:
    """Integer samples at another rate: sample k lies at k * source / target between two given ones, and is their mean by distance,
    rounded down. Whole numbers throughout, so no place drifts. The last one lies at or before the last given sample."""
    if source < 1 or target < 1:
        raise ValueError("rates must be positive")
    common = math.gcd(source, target)
    step, parts = source // common, target // common
    n = F.size(pcm)
    last = F.floor((n - 1).cast("long") * parts / F.lit(step)).cast("long")

    def at(k: Column) -> Column:
        place = k * step
        i, rest = F.floor(place / parts).cast("int"), place % parts
        one = F.get(pcm, i).cast("long")
        return F.when(rest == 0, one).otherwise(F.floor((one * (parts - rest) + F.get(pcm, i + 1).cast("long") * rest) / F.lit(parts)).cast("long"))

    none = F.array().cast("array<bigint>")
    return F.when(pcm.isNull(), None).when(n == 0, none).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), last), at))


def loudness(samples: Column) -> Column:
    """The root mean square of samples in -1 .. 1, by the gain, at most 1; 0 without samples."""
    squares = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.sqrt(squares / F.size(samples)) * GAIN))


def meter(targets: Column, start: float = 0.0) -> Column:
    """The level after each target: it goes a share of the way, a larger one upwards."""
    state = F.struct(F.lit(start).cast("double").alias("level"), F.array().cast("array<double>").alias("levels"))

    def step(seen: Column, target: Column) -> Column:
        level = seen["level"] + (target - seen["level"]) * F.when(target > seen["level"], RISE).otherwise(FALL)
        return F.struct(level.alias("level"), F.concat(seen["levels"], F.array(level)).alias("levels"))

    return F.aggregate(targets, state, step, lambda seen: seen["levels"])


def frames(samples: Column, size: int) -> Column:
    """Consecutive frames of so many samples; the last may be shorter."""
    starts = F.when(F.size(samples) > 0, F.sequence(F.lit(1), F.size(samples), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(samples, i, F.lit(size)))
