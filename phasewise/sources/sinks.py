"""Sinks for feature tables and model scores."""

from __future__ import annotations

import hashlib

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewise.constants import MODEL_PHASES
from phasewise.operators.features import quoted
from phasewise.operators.phase_tables import phase_table
from phasewise.sources.schemas import CSV_OPTIONS


def write_features(features: DataFrame, path: str) -> None:
    """The wide table as CSV with a header, drug first."""
    features.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def stack_phases(features: DataFrame, phases: list[str] = MODEL_PHASES) -> DataFrame:
    """One row per drug and phase, columns without the phase prefix.

    The phases are unpacked from an array of structs, so the wide table is read once. A
    feature that a phase lacks is null there.
    """
    tables = {phase: phase_table(features, phase).columns for phase in phases}
    shared = ["drug", "Number of Organizations"]
    suffixes: dict[str, None] = {}
    for phase, columns in tables.items():
        for name in columns:
            if name not in shared:
                suffixes[name.removeprefix(f"{phase} ")] = None
    types = dict(features.dtypes)

    def cell(phase: str, suffix: str):
        name = f"{phase} {suffix}"
        if name in types:
            return quoted(name).alias(suffix)
        known = next(t for t in (types.get(f"{p} {suffix}") for p in phases) if t)
        return F.lit(None).cast(known).alias(suffix)

    rows = [
        F.struct(F.lit(phase).alias("phase"), *[cell(phase, suffix) for suffix in suffixes])
        for phase in phases
    ]
    return features.select(
        "drug", "`Number of Organizations`", F.explode(F.array(*rows)).alias("row")
    ).select("drug", "`Number of Organizations`", "row.*")


def write_phase_tables(features: DataFrame, path: str,
                       phases: list[str] = MODEL_PHASES) -> None:
    """The phase tables as Parquet, one folder per phase."""
    stack_phases(features, phases).write.mode("overwrite").partitionBy("phase").parquet(path)


def append_scores(scores: DataFrame, path: str) -> None:
    """Add model scores to the score log."""
    scores.write.mode("append").parquet(path)


def unit_path(path: str, unit: str) -> str:
    """The folder of one unit of work in a log: ``unit=`` and a digest of its key."""
    return f"{path.rstrip('/')}/unit={hashlib.sha1(unit.encode()).hexdigest()}"


def write_unit(scores: DataFrame, path: str, unit: str) -> None:
    """Write a unit's rows as its own folder, replacing whatever a failed try left there.

    The folder counts as written once the job has committed it (its ``_SUCCESS`` marker), so
    a unit is in the log wholly or not at all, however often it was tried.
    """
    scores.withColumn("unit_key", F.lit(unit)).write.mode("overwrite").parquet(
        unit_path(path, unit))


def logged_unit(spark: SparkSession, path: str, unit: str) -> DataFrame | None:
    """A unit's rows if a committed folder holds them, else None."""
    folder = unit_path(path, unit)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    store = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(hadoop):
        return None
    return spark.read.parquet(folder).drop("unit_key")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
