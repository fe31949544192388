"""One row in, many rows out: list cells and table cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewise.constants import FUZZY_THRESHOLD
from phasewise.functions import fuzzy, text


def explode_drugs(trials: DataFrame) -> DataFrame:
    """One row per trial and drug; the other columns are copied."""
    return trials.withColumn("drug", F.explode(text.drug_tokens(F.col("primary_drugs"))))


def explode_designs(trials: DataFrame) -> DataFrame:
    """One row per trial row and design; rows without a design yield nothing."""
    return trials.withColumn("design", F.explode(text.design_tokens(F.col("trial_design"))))


def drug_token_counts(trials: DataFrame) -> DataFrame:
    """How often each drug is named, cells split on comma and blank only."""
    names = F.explode(F.split("primary_drugs", ", ")).alias("drug")
    return trials.select(names).groupBy("drug").agg(
        F.count(F.lit(1)).alias("num_of_trials")
    )


def with_organisations(trials: DataFrame, threshold: int = FUZZY_THRESHOLD) -> DataFrame:
    """Add the organisations without look-alikes, and their number."""
    kept = fuzzy.distinct_organisations(F.col("organisations"), threshold)
    return trials.withColumn("unique_organizations", kept).withColumn(
        "number_of_organizations", F.array_size("unique_organizations")
    )


def _history_fields(trials: DataFrame) -> DataFrame:
    return trials.select(
        "trial_id", F.explode(F.split("trial_history", ";")).alias("entry")
    ).withColumn("fields", F.split("entry", r"\|"))


def history_rows(trials: DataFrame) -> DataFrame:
    """History cells as rows of date, status and notes."""
    fields = _history_fields(trials).filter(F.array_size("fields") == 3)
    return fields.select(
        "trial_id",
        F.col("fields")[0].alias("date"),
        F.col("fields")[1].alias("status"),
        F.col("fields")[2].alias("notes"),
    )


def history_rejects(trials: DataFrame) -> DataFrame:
    """History entries that do not have exactly three fields."""
    return _history_fields(trials).filter(F.array_size("fields") != 3).select(
        "trial_id", "entry", F.array_size("fields").alias("field_count")
    )
