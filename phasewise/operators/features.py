"""Per-drug features by phase, from trials exploded to one row per drug."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasewise.constants import (
    CENTER_COUNT,
    NEXT_PHASE,
    ORGANISATION_COUNT,
    PASS,
    PHASES,
    SUBJECT_MEAN,
    TRIAL_LENGTH,
)
from phasewise.functions import measures, text
from phasewise.operators.clean import with_duration
from phasewise.operators.expand import explode_designs, with_organisations

KEYS = ["drug", "phase"]
# Long name of a feature -> suffix of its wide columns.
LONG_TO_WIDE = {
    "subject_mean": SUBJECT_MEAN,
    "trial_length": TRIAL_LENGTH,
    "center_count": CENTER_COUNT,
}


def name_sql(name: str) -> str:
    """A column name as SQL text, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def text_sql(value: str) -> str:
    """A string literal as SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(name: str) -> Column:
    return F.col(name_sql(name))


def by_phase(exploded: DataFrame) -> DataFrame:
    """Trial-drug rows with a known phase, keyed by ``drug`` and ``phase``."""
    return exploded.filter(F.col("phase_of_trial").isNotNull()).withColumnRenamed(
        "phase_of_trial", "phase"
    )


def with_centers(exploded: DataFrame) -> DataFrame:
    return exploded.withColumn(
        "number_of_centers", text.count_parts(F.col("trial_centre_details"))
    )


def mean_centers(exploded: DataFrame) -> DataFrame:
    """The mean centre count over all trial-drug rows that have one; one row."""
    return with_centers(exploded).agg(F.avg("number_of_centers").alias("mean_centers"))


def filled_center_mean(overall: Column) -> Column:
    """Mean centre count of a group, rows without a count entering with the overall mean."""
    return filled_mean(
        F.coalesce(F.sum("number_of_centers"), F.lit(0)),
        F.count("number_of_centers"),
        F.count(F.lit(1)),
        overall,
    )


def filled_mean(total: Column, known: Column, rows: Column, overall: Column) -> Column:
    """A mean from its parts, unknown rows entering with the overall mean."""
    unknown = rows - known
    # A group without gaps must not turn null when there is no overall mean.
    return (total + F.when(unknown > 0, unknown * overall).otherwise(0.0)) / rows


def subject_means(exploded: DataFrame) -> DataFrame:
    """Mean planned subjects per drug and phase; null when no number is known."""
    return by_phase(exploded).groupBy(KEYS).agg(
        F.avg("planned_subject_number").alias("subject_mean")
    )


def center_means(exploded: DataFrame) -> DataFrame:
    overall = mean_centers(exploded).scalar()
    return by_phase(with_centers(exploded)).groupBy(KEYS).agg(
        filled_center_mean(overall).alias("center_count")
    )


def trial_lengths(exploded: DataFrame) -> DataFrame:
    """Mean length in whole days per drug and phase, over trials of positive length."""
    rows = by_phase(with_duration(exploded)).filter(F.col("time_diff") > 0)
    return rows.groupBy(KEYS).agg(
        measures.whole_days(F.avg("time_diff")).alias("trial_length")
    )


def drug_phase_features(exploded: DataFrame) -> DataFrame:
    """Trial count, subject mean, trial length and centre count in one aggregation."""
    overall = mean_centers(exploded).scalar()
    rows = by_phase(with_duration(with_centers(exploded)))
    positive = F.when(F.col("time_diff") > 0, F.col("time_diff"))
    return rows.groupBy(KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("planned_subject_number").alias("subject_mean"),
        measures.whole_days(F.avg(positive)).alias("trial_length"),
        filled_center_mean(overall).alias("center_count"),
    )


def drug_phase_template(exploded: DataFrame, phases: list[str] = PHASES) -> DataFrame:
    """Every drug with a zero for every phase."""
    zeros = [F.lit(0.0).alias(phase) for phase in phases]
    return exploded.select("drug").distinct().select("drug", *zeros)


def pivot_feature(exploded: DataFrame, feature: DataFrame, phases: list[str] = PHASES,
                  suffix: str = "") -> DataFrame:
    """Spread a (drug, phase, value) table over the phases, for all drugs of the trials.

    A phase without a row is zero; a row whose value is null stays null.
    """
    value = next(name for name in feature.columns if name not in KEYS)
    wide = feature.groupBy("drug").pivot("phase", phases).agg(
        F.first(value).alias("value"), F.count(F.lit(1)).alias("n")
    )
    cells = [
        F.when(quoted(f"{phase}_n").isNull(), F.lit(0.0))
        .otherwise(quoted(f"{phase}_value")).cast("double")
        .alias(f"{phase} {suffix}" if suffix else phase)
        for phase in phases
    ]
    return exploded.select("drug").distinct().join(wide, "drug", "left").select("drug", *cells)


def features_by_phase(exploded: DataFrame, phases: list[str] = PHASES) -> DataFrame:
    """Subject mean, trial length and centre count of every phase, one row per drug."""
    return widen(drug_phase_features(exploded), phases)


def widen(long: DataFrame, phases: list[str] = PHASES) -> DataFrame:
    """The long feature table with one column per phase and feature."""
    wide = long.groupBy("drug").pivot("phase", phases).agg(
        F.first("n").alias("n"), *[F.first(name).alias(name) for name in LONG_TO_WIDE]
    )
    return wide.selectExpr("drug", *wide_cells(phases))


def wide_cells(phases: list[str]) -> list[str]:
    """SQL for the wide columns, from columns ``<phase>_n`` and ``<phase>_<feature>``.

    Zero where the phase is absent. A length is also zero when none was positive.
    """
    cells = []
    for name, suffix in LONG_TO_WIDE.items():
        for phase in phases:
            value = name_sql(f"{phase}_{name}")
            if name == "trial_length":
                cell = f"coalesce({value}, 0d)"
            else:
                cell = f"if({name_sql(f'{phase}_n')} IS NULL, 0d, {value})"
            cells.append(f"{cell} AS {name_sql(f'{phase} {suffix}')}")
    return cells


def with_pass_flags(wide: DataFrame, suffix: str = f" {SUBJECT_MEAN}") -> DataFrame:
    """Whether a drug passed a phase: its next phase has a subject mean other than zero.

    In the wide table zero means an absent phase or no subjects, and null means trials
    without a known number; the latter count as passed.
    """
    flags = {}
    for phase, following in NEXT_PHASE.items():
        subjects = quoted(f"{following}{suffix}")
        flags[f"{phase} {PASS}"] = subjects.isNull() | (subjects != 0)
    return wide.withColumns(flags)


def active_drugs(wide: DataFrame) -> DataFrame:
    """Drugs with subjects in an early phase, over a table whose columns are the phases."""
    seen = [
        quoted(phase).isNull() | (quoted(phase) != 0)
        for phase in ["Phase I", "Phase II", "Phase I/II"]
    ]
    return wide.filter(seen[0] | seen[1] | seen[2])


def distinct_strings(df: DataFrame, column: str) -> list[str]:
    """The values a wide table gets its columns from, as many as the data has.

    For values without end, such as free text, the long counts need no list.
    """
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return sorted(row[0] for row in rows.collect())


def status_counts_long(exploded: DataFrame) -> DataFrame:
    """Trials per drug, phase and collapsed status, one row each."""
    rows = by_phase(exploded).withColumn("status", text.collapse_status(F.col("trial_status")))
    return rows.filter("status is not null").groupBy("drug", "phase", "status").agg(
        F.count(F.lit(1)).alias("n"))


def design_counts_long(exploded: DataFrame) -> DataFrame:
    """Trial rows per drug, phase and collapsed design, one row each."""
    rows = explode_designs(by_phase(exploded)).filter("design is not null")
    return rows.groupBy("drug", "phase", "design").agg(F.count(F.lit(1)).alias("n"))


def _count_pivot(rows: DataFrame, value: str, values: list[str] | None,
                 phases: list[str]) -> DataFrame:
    """Rows per drug, phase and value as ``"<phase> <value>"`` columns, gaps zero."""
    if values is None:
        values = distinct_strings(rows, value)
    labels = [f"{phase} {item}" for phase in phases for item in values]
    labelled = rows.filter(F.col(value).isNotNull()).withColumn(
        "label", text.phase_label(F.col("phase"), F.col(value))
    )
    wide = labelled.groupBy("drug").pivot("label", labels).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


def status_counts(exploded: DataFrame, statuses: list[str] | None = None,
                  phases: list[str] = PHASES) -> DataFrame:
    """Trials per drug, phase and collapsed status, spread over columns."""
    rows = by_phase(exploded).withColumn(
        "status", text.collapse_status(F.col("trial_status"))
    )
    return _count_pivot(rows, "status", statuses, phases)


def design_counts(exploded: DataFrame, designs: list[str] | None = None,
                  phases: list[str] = PHASES) -> DataFrame:
    """Trial rows per drug, phase and collapsed design, spread over columns."""
    return _count_pivot(explode_designs(by_phase(exploded)), "design", designs, phases)


def organisation_counts(exploded: DataFrame) -> DataFrame:
    """The most organisations any trial of a drug has, look-alikes removed.

    Each different cell is compared once, however many trials and drugs repeat it; no cell
    means no organisation.
    """
    cells = exploded.select("drug", "organisations").distinct()
    known = F.col("organisations").isNotNull()
    sizes = with_organisations(
        cells.filter(known).select("organisations").distinct()
    ).select("organisations", "number_of_organizations")
    numbers = cells.filter(known).join(sizes, "organisations").select(
        "drug", "number_of_organizations"
    ).unionByName(cells.filter(~known).select("drug", F.lit(0).alias("number_of_organizations")))
    return numbers.groupBy("drug").agg(
        F.max("number_of_organizations").cast("bigint").alias(ORGANISATION_COUNT)
    )


def join_features(features: DataFrame, extra: DataFrame) -> DataFrame:
    """Add columns by drug; drugs that ``extra`` lacks get nulls."""
    return features.join(extra, "drug", "left")


def join_lengths(features: DataFrame, lengths: DataFrame) -> DataFrame:
    """Add features to a length table, keeping every drug of the length table."""
    return features.join(lengths, "drug", "right")
