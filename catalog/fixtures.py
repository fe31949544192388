"""Trials, drugs, histories and predictions derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewise.sources.readers import conform
from phasewise.sources.schemas import TRIALS

# The data spans 1995-2001, so the default cut-off would keep everything.
CUTOFF = "2000-01-01"
STATUSES = ["Completed", "Discontinued", "Other Trial Status"]
DESIGNS = ["Other Design Status", "double-blind", "multicentre", "open", "randomised"]

_PHASE_STEPS = [
    (8, "Phase I"),
    (20, "Phase II"),
    (26, "Phase III"),
    (29, "Phase IV"),
    (33, "Phase I/II"),
    (35, "Phase II/III"),
    (37, "Phase 0"),
]
_DESIGN_OF_TYPE = {
    "ECONOMY": "randomised",
    "LARGE": "open",
    "MEDIUM": "case control",
    "PROMO": "double-blind",
    "SMALL": "sequential",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trial per order. Parts give drugs, organisations and designs; suppliers centres.

    One aggregation over lineitem: an order's lines are kept as a set for the list cells,
    next to the totals.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"
    )
    listed = F.col("p_partkey").isNotNull()
    cells = F.when(listed, F.struct("l_partkey", "l_suppkey", "p_name", "p_type"))
    per_order = (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        .groupBy("l_orderkey")
        .agg(
            F.collect_set(cells).alias("cells"),
            F.max("l_shipdate").alias("last_ship"),
            F.sum("l_quantity").alias("quantity"),
        )
    )

    def joined(value, separator: str, distinct: bool = False):
        items = F.transform("cells", value)
        items = F.array_distinct(items) if distinct else items
        text = F.array_join(F.sort_array(items), separator)
        return F.when(F.array_size("cells") > 0, text)

    def design(cell):
        choice = F.lit("multicentre")
        for part_type, name in _DESIGN_OF_TYPE.items():
            choice = F.when(cell["p_type"] == part_type, name).otherwise(choice)
        return choice

    key = F.col("o_orderkey")
    phase = None
    for limit, name in _PHASE_STEPS:
        test = key % 40 < limit
        phase = F.when(test, name) if phase is None else phase.when(test, name)
    start = (
        F.when(key % 13 == 0, "")
        .when(key % 7 == 0, F.date_format("o_orderdate", "MMM yyyy"))
        .when(key % 5 == 0, F.date_format("o_orderdate", "yyyy"))
        .otherwise(F.date_format("o_orderdate", "dd MMM yyyy"))
    )
    status = (
        F.when(key % 37 == 0, "Suspended")
        .when(key % 41 == 0, "Active, no longer recruiting")
        .when(key % 43 == 0, "Withdrawn prior to enrolment")
        .when(F.col("o_orderstatus") == "F", "Completed")
        .when(F.col("o_orderstatus") == "P", "Discontinued")
        .otherwise("Recruiting")
    )
    drugs = joined(lambda c: F.concat(F.lit("drug "), c["l_partkey"].cast("string")), ", ")
    centres = joined(
        lambda c: F.concat(F.lit("c"), c["l_suppkey"].cast("string"), F.lit("|x")), ";"
    )
    return orders.join(per_order, key == F.col("l_orderkey"), "left").select(
        key.alias("trial_id"),
        drugs.alias("primary_drugs"),
        phase.otherwise("Clinical Phase Unknown").alias("phase_of_trial"),
        F.concat(start, F.when(key % 11 == 0, " (planned)").otherwise(" - first"))
        .alias("trial_initiation_date"),
        F.concat(
            F.date_format("last_ship", "dd MMM yyyy"),
            F.when(key % 29 == 0, " (planned)").otherwise(""),
        ).alias("trial_end_date"),
        F.when(key % 3 == 0, None).when(key % 19 == 0, F.lit(0.0))
        .otherwise(F.col("quantity")).alias("planned_subject_number"),
        F.when(key % 17 != 0, centres).alias("trial_centre_details"),
        F.when(key % 31 != 0, joined(lambda c: c["p_name"], ", ")).alias("organisations"),
        F.when(key % 23 != 0, joined(design, ", ", True)).alias("trial_design"),
        status.alias("trial_status"),
    )


def source_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trials with all columns of the source table; those not derived are null."""
    rows = trials(spark, sf_dir).join(histories(spark, sf_dir), "trial_id", "left")
    return conform(rows, TRIALS)


def drugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 5
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("drug_id"),
        F.concat(F.lit("drug "), F.col("p_partkey").cast("string"), F.lit("-"), "p_brand")
        .alias("drug_name"),
        F.when(size == 0, "Phase I").when(size == 1, "Phase II").when(size == 2, "Phase III")
        .when(size == 3, "Marketed").alias("highest_development_phase"),
    )


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One history cell per order; entries of line 7 carry a field too many."""
    entry = F.concat(
        F.concat_ws("|", F.date_format("l_shipdate", "yyyy-MM-dd"), "l_returnflag", "l_linestatus"),
        F.when(F.col("l_linenumber") == 7, "|extra").otherwise(""),
    )
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trial_id")).agg(
        F.array_join(F.array_sort(F.collect_list(entry)), ";").alias("trial_history")
    )


def binary_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return documents.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("quality").alias("label"),
        (F.col("n_chars") > 500).cast("int").alias("prediction"),
        ((F.col("doc_id") % 100 + F.lit(0.5)) / 100).alias("p1"),
    ).withColumn("probability", F.array(1 - F.col("p1"), F.col("p1")))


def ternary_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("o_orderkey") % 5).cast("double")
    parts = [1 + k, F.lit(4.0), F.lit(5.0)]
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 3).cast("int").alias("label"),
        (F.col("o_orderkey") % 3).cast("int").alias("prediction"),
        F.array(*[part / (10 + k) for part in parts]).alias("probability"),
    )
