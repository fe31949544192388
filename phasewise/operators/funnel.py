"""Drug funnel: which drugs got from phase to phase, and when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasewise.functions.dates import date_text, parse_date
from phasewise.operators.expand import drug_token_counts
from phasewise.operators.match import invalid_names, match_drugs, tasks_for
from phasewise.session import materialise

# Flag -> the two phases a drug must both have trials in.
SUCCESS_PAIRS = {
    "phase_1_success": ("Phase I", "Phase II"),
    "phase_2_success": ("Phase II", "Phase III"),
    "phase_3_success": ("Phase III", "Phase IV"),
    "phase_1_2_success": ("Phase I/II", "Phase III"),
    "phase_2_3_success": ("Phase II/III", "Phase IV"),
}
# Prefix of the time columns -> phase and the phase after it.
TIMED_PHASES = {"phase_1": ("Phase I", "Phase II"), "phase_2": ("Phase II", "Phase III")}
TIMES = [f"{p}_{t}" for p in TIMED_PHASES for t in ("start", "first_end", "last_end")]


def _in_phase(phase: str) -> Column:
    return F.col("phase_of_trial") == phase


def _success_flags() -> list[Column]:
    return [
        F.coalesce(F.bool_or(_in_phase(a)) & F.bool_or(_in_phase(b)), F.lit(False)).alias(flag)
        for flag, (a, b) in SUCCESS_PAIRS.items()
    ]


def copresence_flags(exploded: DataFrame) -> DataFrame:
    """Success flags per drug: trials exist in a phase and in the one after it."""
    return exploded.groupBy("drug").agg(*_success_flags())


def phase_one_subjects(exploded: DataFrame) -> DataFrame:
    """Total planned subjects of a drug's Phase I trials; one unknown number makes it null."""
    subjects = F.col("planned_subject_number")
    total = F.when(F.count(F.lit(1)) == F.count(subjects), F.sum(subjects))
    return exploded.filter(_in_phase("Phase I")).groupBy("drug").agg(total.alias("subjects"))


def _time_parts() -> list[Column]:
    """Per timed phase: first and last start, and the starts of the phase after it.

    Starts are days, so a set of them is small however many trials a drug has.
    """
    start = F.col("trial_start")
    parts = []
    for prefix, (phase, after) in TIMED_PHASES.items():
        own = F.when(_in_phase(phase), start)
        parts += [
            F.min(own).alias(f"{prefix}_start"),
            F.max(own).alias(f"{prefix}_last_end"),
            F.collect_set(F.when(_in_phase(after), start)).alias(f"{prefix}_next"),
        ]
    return parts


def _times() -> list[Column]:
    """The six dates from the time parts; all null if any is missing."""
    def first_after(prefix: str) -> Column:
        start = F.col(f"{prefix}_start")
        return F.array_min(F.filter(f"{prefix}_next", lambda day: day > start))

    found = {}
    for prefix in TIMED_PHASES:
        found[f"{prefix}_start"] = F.col(f"{prefix}_start")
        found[f"{prefix}_first_end"] = first_after(prefix)
        found[f"{prefix}_last_end"] = F.col(f"{prefix}_last_end")
    complete = F.lit(True)
    for value in found.values():
        complete = complete & value.isNotNull()
    return [F.when(complete, found[name]).alias(name) for name in TIMES]


def phase_times(rows: DataFrame) -> DataFrame:
    """For Phase I and II: first start, first later start of the next phase, last start.

    A drug that lacks any of the six dates gets none of them.
    """
    return rows.groupBy("drug").agg(*_time_parts()).select("drug", *_times())


def drug_funnel(trials: DataFrame, regex: bool = True) -> DataFrame:
    """Per drug: number of trials, success flags and phase times.

    A drug owns every trial whose drug cell mentions its name. The trials are read once,
    down to one row per drug cell, phase and start with a count; names, texts and dates all
    come from that table in the shared folder. A drug whose pattern matches no cell, not
    even its own, has no success and no times. Drugs whose name is no valid pattern are
    left out; ``funnel_exceptions`` lists them.
    """
    cells = materialise(
        trials.groupBy("primary_drugs", "phase_of_trial", "trial_start").agg(
            F.count(F.lit(1)).alias("trials")
        )
    )
    names = F.explode(F.split("primary_drugs", ", ")).alias("drug")
    counts = cells.select(names, "trials").groupBy("drug").agg(
        F.sum("trials").alias("num_of_trials")
    )
    texts = cells.select("primary_drugs").distinct()
    pairs = materialise(match_drugs(counts.select("drug"), texts, regex), "funnel-pairs")
    tasks = tasks_for(pairs)
    # Down to a row per drug, phase and day before anything is gathered per drug.
    rows = pairs.repartition(tasks, "primary_drugs").join(
        cells.repartition(tasks, "primary_drugs"), "primary_drugs").select(
        "drug", "phase_of_trial", "trial_start"
    ).distinct()
    per_drug = rows.groupBy("drug").agg(*_success_flags(), *_time_parts())
    passed_first = F.col("phase_1_success")
    per_drug = per_drug.select("drug", *SUCCESS_PAIRS, *_times())
    if regex:
        counts = counts.join(invalid_names(counts).select("drug"), "drug", "left_anti")
    return counts.join(per_drug, "drug", "left").select(
        "drug",
        "num_of_trials",
        *[F.coalesce(F.col(flag) & passed_first, F.lit(False)).alias(flag)
          for flag in SUCCESS_PAIRS],
        *[F.when(passed_first, F.col(name)).alias(name) for name in TIMES],
    )


def funnel_exceptions(trials: DataFrame) -> DataFrame:
    """Drugs that ``drug_funnel`` cannot match, with their number of trials."""
    counts = drug_token_counts(trials)
    return invalid_names(counts)


def by_trial_count(funnel: DataFrame) -> DataFrame:
    return funnel.orderBy(F.desc("num_of_trials"), "drug")


def funnel_rates(funnel: DataFrame) -> DataFrame:
    """Share of drugs that pass each phase, out of those that passed the one before."""
    passed = [F.count_if(F.col(f"phase_{n}_success")) for n in (1, 2, 3)]
    return funnel.agg(
        F.count(F.lit(1)).alias("drugs"),
        F.try_divide(passed[0], F.count(F.lit(1))).alias("phase_1_rate"),
        F.try_divide(passed[1], passed[0]).alias("phase_2_rate"),
        F.try_divide(passed[2], passed[1]).alias("phase_3_rate"),
    )


def phase_one_span(trials: DataFrame) -> DataFrame:
    """First and last Phase I start per drug cell; planned starts count, blank ones do not."""
    cell = F.col("trial_initiation_date")
    rows = trials.filter(_in_phase("Phase I")).filter(date_text(cell) != "")
    return rows.withColumn("start", parse_date(cell)).groupBy("primary_drugs").agg(
        F.min("start").alias("first_start"), F.max("start").alias("last_start")
    )
