"""Projections of the wide feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewise.constants import ORGANISATION_COUNT


def phase_table(features: DataFrame, phase: str) -> DataFrame:
    """The columns of one phase plus the organisation count, one row per drug.

    The blank after the phase keeps ``Phase I`` apart from ``Phase II`` and ``Phase I/II``.
    Drugs that never entered the phase stay in.
    """
    prefix = f"{phase} "
    names = [name for name in features.columns if name.startswith(prefix)]
    shared = [name for name in [ORGANISATION_COUNT] if name in features.columns]
    return features.select([F.col(f"`{name}`") for name in ["drug", *names, *shared]])


def fill_unknown(df: DataFrame, value: float = 0.0) -> DataFrame:
    return df.na.fill(value)


def without_phase(df: DataFrame, phase: str) -> DataFrame:
    """Drop everything that belongs to one phase."""
    return df.drop(*[c for c in df.columns if c == phase or c.startswith(f"{phase} ")])
