"""Filters that turn the raw trials into the trials worth analysing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasewise.constants import CUTOFF_DATE
from phasewise.functions import dates
from phasewise.functions.text import base_name
from phasewise.sources.schemas import TRIALS

START = "trial_initiation_date"
END = "trial_end_date"


def has_drugs(trials: DataFrame) -> DataFrame:
    return trials.filter(F.col("primary_drugs").isNotNull())


def not_planned(trials: DataFrame) -> DataFrame:
    """Trials of which neither start nor end is merely planned."""
    return trials.filter(~dates.is_planned(F.col(START)) & ~dates.is_planned(F.col(END)))


def with_dates(trials: DataFrame) -> DataFrame:
    """Add ``trial_start`` and ``trial_end``.

    Both come out of a generator, so that filters on them stay above it and read the dates
    instead of parsing the cells again.
    """
    settled = F.struct(
        dates.settled_date(F.col(START)).alias("trial_start"),
        dates.settled_date(F.col(END)).alias("trial_end"),
    )
    return trials.drop("trial_start", "trial_end").select("*", F.inline(F.array(settled)))


def before(trials: DataFrame, cutoff: str = CUTOFF_DATE) -> DataFrame:
    """Trials that started and ended before the cut-off; unknown dates fail the test."""
    limit = F.lit(cutoff).cast("date")
    return trials.filter((F.col("trial_start") < limit) & (F.col("trial_end") < limit))


def load_clean(trials: DataFrame, cutoff: str = CUTOFF_DATE) -> DataFrame:
    """Trials with drugs, settled dates and an end before the cut-off."""
    return before(with_dates(not_planned(has_drugs(trials))), cutoff)


def load_audit(trials: DataFrame, cutoff: str = CUTOFF_DATE) -> DataFrame:
    """How many trials ``load_clean`` keeps, and why it drops the others; one row."""
    limit = F.lit(cutoff).cast("date")
    start, end = F.col(START), F.col(END)
    planned = dates.is_planned(start) | dates.is_planned(end)
    blank = (
        start.isNull() | end.isNull()
        | (dates.date_text(start) == "") | (dates.date_text(end) == "")
    )
    known = F.col("trial_start").isNotNull() & F.col("trial_end").isNotNull()
    kept = (F.col("trial_start") < limit) & (F.col("trial_end") < limit)
    outcome: Column = (
        F.when(F.col("primary_drugs").isNull(), "no_drugs")
        .when(planned, "planned")
        .when(blank, "blank_date")
        .when(~known, "unreadable_date")
        .when(kept, "kept")
        .otherwise("after_cutoff")
    )
    names = ["no_drugs", "planned", "blank_date", "unreadable_date", "after_cutoff", "kept"]
    return with_dates(trials).select(outcome.alias("outcome")).agg(
        F.count(F.lit(1)).alias("trials"),
        *[F.count_if(F.col("outcome") == name).alias(name) for name in names],
    )


def with_duration(trials: DataFrame) -> DataFrame:
    return trials.withColumn(
        "time_diff", dates.days_between(F.col("trial_start"), F.col("trial_end"))
    )


def positive_length(trials: DataFrame) -> DataFrame:
    return trials.filter(F.col("time_diff") > 0)


def trial_columns(trials: DataFrame) -> DataFrame:
    """The 19 source columns of the trials table."""
    return trials.select(TRIALS.fieldNames())


def in_phases(trials: DataFrame, *phases: str) -> DataFrame:
    column = F.col("phase_of_trial")
    return trials.filter(column == phases[0] if len(phases) == 1 else column.isin(*phases))


def of_drug(trials: DataFrame, drug: str) -> DataFrame:
    """Trials whose drug cell is exactly this text."""
    return trials.filter(F.col("primary_drugs") == drug)


def with_base_name(drugs: DataFrame) -> DataFrame:
    return drugs.withColumn("drug", base_name(F.col("drug_name")))
