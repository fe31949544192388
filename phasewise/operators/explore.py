"""Counts, distributions and rates behind the project's reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phasewise.constants import (
    DEVELOPMENT_COST_BILLIONS,
    LENGTH_BINS,
    MODEL_PHASES,
    ORGANISATION_BINS,
    ORGANISATION_COUNT,
    PASS,
    TRIAL_LENGTH,
)
from phasewise.functions.measures import equal_width_bin, time_bin
from phasewise.operators.features import quoted


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; nulls are not counted."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column)
    return counted.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def one_hot_phases(trials: DataFrame, phases: list[str]) -> DataFrame:
    """One 0/1 column per phase."""
    flags = {
        phase: F.coalesce(F.col("phase_of_trial") == phase, F.lit(False)).cast("int")
        for phase in phases
    }
    return trials.withColumns(flags)


def shortest_trials(trials: DataFrame, limit: int = 5) -> DataFrame:
    return trials.orderBy("time_diff", "trial_id").limit(limit)


def _per_phase(features: DataFrame, suffix: str, phases: list[str], alias: str) -> DataFrame:
    """One row per drug and phase from the wide columns ``"<phase> <suffix>"``."""
    cells = [
        F.struct(F.lit(phase).alias("phase"), quoted(f"{phase} {suffix}").alias(alias))
        for phase in phases
    ]
    return features.select("drug", F.inline(F.array(*cells)))


def pass_counts(features: DataFrame, phases: list[str] = MODEL_PHASES) -> DataFrame:
    """Drugs per phase that passed and did not pass."""
    rows = _per_phase(features, PASS, phases, "passed")
    return rows.groupBy("phase", "passed").agg(F.count(F.lit(1)).alias("drugs"))


def pass_rates(features: DataFrame, phases: list[str] = MODEL_PHASES) -> DataFrame:
    rows = _per_phase(features, PASS, phases, "passed")
    return rows.groupBy("phase").agg(
        F.count(F.lit(1)).alias("drugs"),
        F.count_if("passed").alias("passed"),
        (F.count_if("passed") / F.count(F.lit(1))).alias("rate"),
    )


def histogram(rows: DataFrame, value: str, bins: int, by: list[str]) -> DataFrame:
    """Rows per equal-width bin between the smallest and the largest value of each group.

    Rows are first counted per value. Values are whole days or organisations, so the
    windows for the bounds see a short list of different values, however many rows.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("n")
    )
    group = W.partitionBy(*by)
    bin_of = equal_width_bin(F.col(value), F.col("low"), F.col("high"), bins)
    return (
        counted.withColumns({"low": F.min(value).over(group), "high": F.max(value).over(group)})
        .withColumn("bin", bin_of)
        .groupBy(*by, "bin")
        .agg(F.sum("n").alias("n"))
    )


def length_histogram(features: DataFrame, bins: int = LENGTH_BINS,
                     phases: list[str] = MODEL_PHASES) -> DataFrame:
    """Distribution of trial lengths per phase; unknown lengths count as zero days."""
    rows = _per_phase(features, TRIAL_LENGTH, phases, "days").na.fill(0.0)
    return histogram(rows, "days", bins, ["phase"])


def organisation_histogram(features: DataFrame, bins: int = ORGANISATION_BINS) -> DataFrame:
    rows = features.select(quoted(ORGANISATION_COUNT).cast("double").alias("organisations"))
    return histogram(rows.na.fill(0.0), "organisations", bins, [])


def time_bins(features: DataFrame, phases: list[str] = MODEL_PHASES,
              only_entered: DataFrame | None = None) -> DataFrame:
    """The length class of every drug in every phase.

    Drugs that never entered a phase have length 0 there and fall into the first class.
    Given the (drug, phase) pairs that were entered, only those are classed.
    """
    rows = _per_phase(features, TRIAL_LENGTH, phases, "days")
    if only_entered is not None:
        rows = rows.join(only_entered.select("drug", "phase"), ["drug", "phase"], "left_semi")
    return rows.withColumn("time_bin", time_bin(F.col("days")))


def class_balance(binned: DataFrame) -> DataFrame:
    """Share of each length class within its phase."""
    counted = binned.groupBy("phase", "time_bin").agg(F.count(F.lit(1)).alias("n"))
    # Three rows per phase at most.
    share = F.col("n") / F.sum("n").over(W.partitionBy("phase"))
    return counted.withColumn("share", share)


def approval_product(scores: DataFrame, relative_to: str) -> DataFrame:
    """Scores of single phases to a score from Phase I to approval, and its lift.

    ``scores`` has task, phase, kind (``naive``, ``model`` or ``historical``) and score. The
    lift is the gain of the model over the naive score, relative to the score of the given
    kind. A kind without scores has a null product.
    """
    def product(kind: str) -> Column:
        return F.product(F.when(F.col("kind") == kind, F.col("score")))

    totals = scores.groupBy("task").agg(
        product("naive").alias("naive"), product("model").alias("model"),
        product("historical").alias("historical"),
    )
    lift = F.try_divide(F.col("model") - F.col("naive"), F.col(relative_to))
    return totals.withColumn("lift", lift).withColumn(
        "value_billions", F.lit(DEVELOPMENT_COST_BILLIONS) * F.col("lift")
    )


def table_profile(df: DataFrame) -> DataFrame:
    """Rows, columns and nulls per column, in one pass and one row."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        *[F.count_if(quoted(name).isNull()).alias(f"null_{name}") for name in df.columns],
    )
