"""Small numeric rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from phasewise.constants import SPLIT_SEED, TIME_BIN_EDGES


def whole_days(mean_days: Column) -> Column:
    return F.floor(mean_days).cast("double")


def time_bin(days: Column, edges: tuple[float, float] = TIME_BIN_EDGES) -> Column:
    """0 below the first edge, 1 below the second, else 2; an unknown length is 2."""
    short, long = edges
    return F.when(days < short, 0).when(days < long, 1).otherwise(2)


def was_reached(trials_in_phase: Column, subject_mean: Column) -> Column:
    """A phase counts as reached unless it is absent or its subject mean is zero.

    A phase that has trials but no known subject number counts as reached.
    """
    present = F.coalesce(trials_in_phase, F.lit(0)) > 0
    return present & (subject_mean.isNull() | (subject_mean != 0))


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """1-based bin of equal width; the last bin is closed, a single value gets width 1."""
    spread = high > low
    start = F.when(spread, low).otherwise(low - 0.5)
    end = F.when(spread, high).otherwise(high + 0.5)
    position = F.floor((value - start) * F.lit(float(bins)) / (end - start)) + 1
    return F.least(position, F.lit(bins)).cast("bigint")


def seeded_hash(key: Column, seed: int = SPLIT_SEED) -> Column:
    """A shuffled order that does not depend on partitioning: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def hash_bucket(digest: Column, bits: int = 16) -> Column:
    """Leading bits of a hex digest as a number; equal-sized buckets in digest order."""
    return F.conv(F.substring(digest, 1, bits // 4), 16, 10).cast("bigint")
