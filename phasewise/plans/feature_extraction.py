"""From raw trials to the wide feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewise.constants import CUTOFF_DATE, ORGANISATION_COUNT, PHASES
from phasewise.functions import fuzzy, measures, text
from phasewise.functions.dates import days_between
from phasewise.operators import features as ops
from phasewise.operators.clean import load_clean
from phasewise.operators.expand import explode_drugs
from phasewise.session import materialise
from phasewise.sources.sinks import write_features, write_phase_tables

# What the parts of the joined feature table read of a trial-drug row.
PART_COLUMNS = [
    "drug", "phase_of_trial", "planned_subject_number", "trial_centre_details", "trial_start",
    "trial_end", "trial_status", "organisations", "trial_design",
]


def trial_drugs(trials: DataFrame, cutoff: str = CUTOFF_DATE) -> DataFrame:
    """Clean trials, one row per drug."""
    return explode_drugs(load_clean(trials, cutoff))


def joined_feature_table(exploded: DataFrame, statuses: list[str] | None = None,
                         designs: list[str] | None = None,
                         phases: list[str] = PHASES) -> DataFrame:
    """The feature table put together from its parts with left joins on the drug.

    The trial rows are written to the shared folder first, with the columns that the parts
    read: each part would otherwise derive them again.
    """
    exploded = materialise(exploded.select(*PART_COLUMNS), "exploded")
    table = ops.with_pass_flags(ops.features_by_phase(exploded, phases))
    table = ops.join_features(table, ops.status_counts(exploded, statuses, phases))
    table = ops.join_features(table, ops.organisation_counts(exploded))
    return ops.join_features(table, ops.design_counts(exploded, designs, phases))


def feature_table(trials: DataFrame, statuses: list[str] | None = None,
                  designs: list[str] | None = None, phases: list[str] = PHASES,
                  cutoff: str = CUTOFF_DATE, staged: bool = False) -> DataFrame:
    """The same table as ``joined_feature_table`` without joining anything.

    Organisations and designs are worked out once per trial, before it is repeated per
    drug. One aggregation by drug and phase combines on the map side, so a drug with a
    large share of the trials costs no more than any other; the second one, by drug,
    sees one row per drug and phase. Given the statuses and designs, planning reads no
    data; without them, each list takes one distinct query.

    The overall mean centre count needs all trials before any group is finished. Staged
    means that the groups are written to the shared folder first, so that the trials are
    read once; otherwise the mean is a query of its own over four columns.
    """
    clean = load_clean(trials, cutoff)
    prepared = clean.select(
        "primary_drugs",
        F.col("phase_of_trial").alias("phase"),
        "planned_subject_number",
        text.count_parts(F.col("trial_centre_details")).alias("number_of_centers"),
        days_between(F.col("trial_start"), F.col("trial_end")).alias("time_diff"),
        text.collapse_status(F.col("trial_status")).alias("status"),
        text.design_tokens(F.col("trial_design")).alias("designs"),
        F.array_size(fuzzy.distinct_organisations(F.col("organisations"))).alias("organisations"),
    )
    if statuses is None:
        statuses = ops.distinct_strings(prepared, "status")
    if designs is None:
        designs = ops.distinct_strings(
            prepared.select(F.explode("designs").alias("design")), "design"
        )
    # Counted once per trial: the rows repeated per drug carry numbers instead of lists.
    rows = explode_drugs(prepared.select(
        "*",
        F.array_size("designs").alias("design_rows"),
        *[text.occurrences(F.col("designs"), d).alias(f"design {d}") for d in designs],
    ).drop("designs"))
    positive = F.when(F.col("time_diff") > 0, F.col("time_diff"))
    by_drug_and_phase = rows.groupBy("drug", "phase").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("planned_subject_number").alias("subject_mean"),
        measures.whole_days(F.avg(positive)).alias("trial_length"),
        F.coalesce(F.sum("number_of_centers"), F.lit(0)).alias("centers"),
        F.count("number_of_centers").alias("centers_known"),
        F.max("organisations").alias("organisations"),
        F.count("status").alias("status_rows"),
        *[F.count_if(F.col("status") == s).alias(f"status {s}") for s in statuses],
        F.coalesce(F.sum("design_rows"), F.lit(0)).alias("design_rows"),
        *[
            F.coalesce(F.sum(ops.quoted(f"design {d}")), F.lit(0)).alias(f"design {d}")
            for d in designs
        ],
    )

    if staged:
        by_drug_and_phase = materialise(by_drug_and_phase)
        overall = by_drug_and_phase.agg(F.try_divide(F.sum("centers"), F.sum("centers_known")))
    else:
        overall = ops.mean_centers(
            explode_drugs(clean.select("primary_drugs", "trial_centre_details"))
        )
    by_drug_and_phase = by_drug_and_phase.withColumn(
        "center_count",
        ops.filled_mean(F.col("centers"), F.col("centers_known"), F.col("n"), overall.scalar()),
    )
    # Generated columns are written as SQL text: one call each instead of one per operand.
    counted = [f"status {s}" for s in statuses] + [f"design {d}" for d in designs]
    per_phase = [
        f"max(if(phase = {ops.text_sql(phase)}, {ops.name_sql(name)}, null)) "
        f"AS {ops.name_sql(f'{phase}_{name}')}"
        for name in ["n", *ops.LONG_TO_WIDE, *counted]
        for phase in phases
    ]
    by_drug = by_drug_and_phase.groupBy("drug").agg(
        F.max("organisations").cast("bigint").alias(ORGANISATION_COUNT),
        F.sum(F.when(F.col("phase").isNotNull(), F.col("status_rows"))).alias("status_rows"),
        F.sum(F.when(F.col("phase").isNotNull(), F.col("design_rows"))).alias("design_rows"),
        F.count("phase").alias("phases"),
        *[F.expr(text) for text in per_phase],
    )

    def counts(kind: str, values: list[str]) -> list[str]:
        """Zero where a drug has other counts of the kind, null where it has none."""
        return [
            f"if({kind}_rows > 0, coalesce({ops.name_sql(f'{phase}_{kind} {value}')}, 0), null) "
            f"AS {ops.name_sql(f'{phase} {value}')}"
            for phase in phases
            for value in values
        ]

    table = by_drug.filter("phases > 0").selectExpr(
        "drug",
        *ops.wide_cells(phases),
        *counts("status", statuses),
        ops.name_sql(ORGANISATION_COUNT),
        *counts("design", designs),
    )
    return ops.with_pass_flags(table)


def run(trials: DataFrame, csv_path: str, phase_path: str,
        statuses: list[str] | None = None, designs: list[str] | None = None,
        cutoff: str = CUTOFF_DATE) -> None:
    """Extract the features once and store them, wide as CSV and by phase as Parquet."""
    table = materialise(
        feature_table(trials, statuses, designs, cutoff=cutoff, staged=True)
    )
    write_features(table, csv_path)
    write_phase_tables(table, phase_path)
