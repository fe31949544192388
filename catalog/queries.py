"""One callable per operator, over tables derived from the test data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import fixtures as fx
from phasewise.constants import MODEL_PHASES, ORGANISATION_COUNT, SUBJECT_MEAN
from phasewise.functions import dates, text
from phasewise.models import training
from phasewise.operators import clean, expand, explore, features, funnel, match, metrics, prepare
from phasewise.operators.phase_tables import fill_unknown, phase_table, without_phase
from phasewise.plans import feature_extraction as extraction
from phasewise.plans import sweeps
from phasewise.session import fresh_path, materialise
from phasewise.sources import readers, sinks
from phasewise.sources.schemas import CSV_OPTIONS, DRUGS

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6
_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Comparable output: doubles rounded, dates as text, every whole number a bigint."""
    def column(name: str, kind: str):
        value = F.col(f"`{name}`")
        if kind == "double":
            value = F.round(value, digits)
        elif kind == "date":
            value = value.cast("string")
        elif kind in {"int", "smallint", "tinyint"}:
            value = value.cast("bigint")
        return value.alias(name)

    return df.select([column(name, kind) for name, kind in df.dtypes])


def clean_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.load_clean(fx.trials(spark, sf_dir), fx.CUTOFF)


def exploded_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.explode_drugs(clean_trials(spark, sf_dir))


def features_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.feature_table(
        fx.trials(spark, sf_dir), fx.STATUSES, fx.DESIGNS, cutoff=fx.CUTOFF, staged=True
    )


def basic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by phase with pass flags, without status, design and organisation counts."""
    return features.with_pass_flags(features.features_by_phase(exploded_trials(spark, sf_dir)))


# Sources, filters and scalar functions


@query
def load_clean(spark, sf_dir):
    return tidy(
        clean_trials(spark, sf_dir).select("trial_id", "primary_drugs", "trial_start", "trial_end")
    )


@query
def load_audit(spark, sf_dir):
    return tidy(clean.load_audit(fx.trials(spark, sf_dir), fx.CUTOFF))


@query
def date_parse(spark, sf_dir):
    start, end = F.col("trial_initiation_date"), F.col("trial_end_date")
    return tidy(
        fx.trials(spark, sf_dir).select(
            "trial_id",
            dates.date_text(start).alias("start_text"),
            dates.settled_date(start).alias("trial_start"),
            dates.settled_date(end).alias("trial_end"),
        )
    )


@query
def planned_filter(spark, sf_dir):
    rows = clean.not_planned(clean.has_drugs(fx.trials(spark, sf_dir)))
    return rows.select("trial_id", "trial_initiation_date", "trial_end_date")


@query
def trial_columns(spark, sf_dir):
    return clean.trial_columns(fx.source_trials(spark, sf_dir))


@query
def read_trials_csv(spark, sf_dir):
    path = fresh_path(spark, "trials-csv")
    fx.source_trials(spark, sf_dir).write.options(**CSV_OPTIONS).csv(path)
    return readers.read_trials(spark, path, "csv")


@query
def read_drugs_csv(spark, sf_dir):
    path = fresh_path(spark, "drugs-csv")
    drugs = readers.conform(fx.drugs(spark, sf_dir), DRUGS)
    drugs.write.options(**CSV_OPTIONS).csv(path)
    return readers.read_drugs(spark, path, "csv").select(
        "drug_id", "drug_name", "highest_development_phase"
    )


@query
def phase_filter(spark, sf_dir):
    trials = fx.trials(spark, sf_dir)
    second = clean.in_phases(trials, "Phase II").select("trial_id", F.lit("II").alias("kind"))
    third = clean.in_phases(trials, "Phase III").select("trial_id", F.lit("III").alias("kind"))
    both = clean.in_phases(trials, "Phase I", "Phase II", "Phase III").select(
        "trial_id", F.lit("I-III").alias("kind")
    )
    return second.unionByName(third).unionByName(both)


@query
def drug_trials(spark, sf_dir):
    rows = clean.of_drug(fx.trials(spark, sf_dir), "drug 1")
    return rows.select("trial_id", "primary_drugs", "phase_of_trial")


@query
def drug_base_names(spark, sf_dir):
    return clean.with_base_name(fx.drugs(spark, sf_dir)).select("drug_id", "drug_name", "drug")


@query
def status_collapse(spark, sf_dir):
    status = F.col("trial_status")
    return fx.trials(spark, sf_dir).select(
        "trial_id",
        text.collapse_status(status).alias("status"),
        text.phase_label(F.col("phase_of_trial"), text.collapse_status(status)).alias("label"),
    )


@query
def design_collapse(spark, sf_dir):
    return fx.trials(spark, sf_dir).select(
        "trial_id", text.collapse_design(F.col("trial_design")).alias("design")
    )


@query
def center_counts(spark, sf_dir):
    rows = features.with_centers(fx.trials(spark, sf_dir))
    return tidy(rows.select("trial_id", "number_of_centers"))


@query
def trial_durations(spark, sf_dir):
    rows = clean.positive_length(clean.with_duration(clean_trials(spark, sf_dir)))
    return tidy(rows.select("trial_id", "time_diff"))


@query
def onehot_phase(spark, sf_dir):
    trials = fx.trials(spark, sf_dir).select("trial_id", "phase_of_trial")
    return tidy(explore.one_hot_phases(trials, MODEL_PHASES))


# Expansion


@query
def drug_explode(spark, sf_dir):
    return exploded_trials(spark, sf_dir).select("trial_id", "drug", "phase_of_trial")


@query
def design_explode(spark, sf_dir):
    return expand.explode_designs(exploded_trials(spark, sf_dir)).select(
        "trial_id", "drug", "design"
    )


@query
def drug_token_counts(spark, sf_dir):
    return expand.drug_token_counts(clean_trials(spark, sf_dir))


@query
def history_rows(spark, sf_dir):
    return expand.history_rows(fx.histories(spark, sf_dir))


@query
def history_rejects(spark, sf_dir):
    return tidy(expand.history_rejects(fx.histories(spark, sf_dir)))


@query
def org_dedupe(spark, sf_dir):
    rows = expand.with_organisations(fx.trials(spark, sf_dir))
    return tidy(
        rows.select(
            "trial_id",
            F.array_join("unique_organizations", "|").alias("unique_organizations"),
            "number_of_organizations",
        )
    )


# Aggregates and pivots


@query
def subject_mean_long(spark, sf_dir):
    return tidy(features.subject_means(exploded_trials(spark, sf_dir)))


@query
def center_count_mean(spark, sf_dir):
    return tidy(features.center_means(exploded_trials(spark, sf_dir)))


@query
def trial_length_days(spark, sf_dir):
    return tidy(features.trial_lengths(exploded_trials(spark, sf_dir)))


@query
def drug_phase_features(spark, sf_dir):
    return tidy(features.drug_phase_features(exploded_trials(spark, sf_dir)))


@query
def drug_phase_template(spark, sf_dir):
    return tidy(features.drug_phase_template(exploded_trials(spark, sf_dir)))


@query
def subject_mean_wide(spark, sf_dir):
    exploded = exploded_trials(spark, sf_dir)
    return tidy(
        features.pivot_feature(exploded, features.subject_means(exploded), suffix=SUBJECT_MEAN)
    )


@query
def features_by_phase(spark, sf_dir):
    return tidy(features.features_by_phase(exploded_trials(spark, sf_dir)))


@query
def phase_pass_flags(spark, sf_dir):
    flags = [f"{phase} Pass" for phase in features.NEXT_PHASE]
    return basic_features(spark, sf_dir).select("drug", *[f"`{name}`" for name in flags])


@query
def active_drugs(spark, sf_dir):
    exploded = exploded_trials(spark, sf_dir)
    wide = features.pivot_feature(exploded, features.subject_means(exploded))
    active = features.active_drugs(without_phase(wide, "Phase 0"))
    return tidy(features.with_pass_flags(active, suffix=""))


@query
def status_counts_wide(spark, sf_dir):
    return features.status_counts(exploded_trials(spark, sf_dir), fx.STATUSES)


@query
def design_counts_wide(spark, sf_dir):
    return features.design_counts(exploded_trials(spark, sf_dir), fx.DESIGNS)


@query
def org_count_max(spark, sf_dir):
    return features.organisation_counts(exploded_trials(spark, sf_dir))


@query
def feature_table(spark, sf_dir):
    return tidy(features_of(spark, sf_dir))


@query
def feature_table_by_joins(spark, sf_dir):
    return tidy(
        extraction.joined_feature_table(exploded_trials(spark, sf_dir), fx.STATUSES, fx.DESIGNS)
    )


@query
def feature_table_filled(spark, sf_dir):
    return tidy(fill_unknown(features_of(spark, sf_dir)))


@query
def phase_table_1(spark, sf_dir):
    return tidy(phase_table(features_of(spark, sf_dir), "Phase I"))


@query
def phase_table_2(spark, sf_dir):
    return tidy(phase_table(features_of(spark, sf_dir), "Phase II"))


@query
def phase_table_3(spark, sf_dir):
    return tidy(phase_table(features_of(spark, sf_dir), "Phase III"))


@query
def right_join_lengths(spark, sf_dir):
    """Early-phase drugs' organisation counts joined to the lengths of all drugs."""
    exploded = exploded_trials(spark, sf_dir)
    early = clean.in_phases(exploded, "Phase I", "Phase II", "Phase I/II")
    lengths = features.pivot_feature(
        exploded, features.trial_lengths(exploded), suffix="trial length"
    )
    return tidy(features.join_lengths(features.organisation_counts(early), lengths))


@query
def csv_round_trip(spark, sf_dir):
    path = fresh_path(spark, "features-csv")
    sinks.write_features(features_of(spark, sf_dir), path)
    return tidy(readers.read_features(spark, path))


@query
def phase_store_round_trip(spark, sf_dir):
    path = fresh_path(spark, "phase-tables")
    sinks.write_phase_tables(features_of(spark, sf_dir), path)
    tables = []
    for phase in MODEL_PHASES:
        stored = readers.read_phase_table(spark, path, phase)
        short = stored.toDF(*[name.removeprefix(f"{phase} ") for name in stored.columns])
        tables.append(short.withColumn("phase", F.lit(phase)))
    return tidy(sinks.union_all(tables))


# Funnel


def names_and_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Drug names and drug cells, stored, as matching reads both several times."""
    texts = materialise(clean_trials(spark, sf_dir).select("primary_drugs").distinct())
    names = expand.drug_token_counts(texts).select("drug")
    return materialise(names), texts


@query
def drug_match_join(spark, sf_dir):
    names, texts = names_and_texts(spark, sf_dir)
    return match.match_drugs(names, texts)


@query
def drug_match_literal(spark, sf_dir):
    names, texts = names_and_texts(spark, sf_dir)
    return match.match_drugs(names, texts, regex=False)


@query
def copresence_flags(spark, sf_dir):
    return funnel.copresence_flags(exploded_trials(spark, sf_dir))


@query
def phase_times(spark, sf_dir):
    return tidy(funnel.phase_times(exploded_trials(spark, sf_dir)))


@query
def p1_subjects(spark, sf_dir):
    return tidy(funnel.phase_one_subjects(exploded_trials(spark, sf_dir)))


@query
def drug_funnel(spark, sf_dir):
    return tidy(funnel.by_trial_count(funnel.drug_funnel(clean_trials(spark, sf_dir))))


@query
def funnel_exceptions(spark, sf_dir):
    return funnel.funnel_exceptions(clean_trials(spark, sf_dir))


@query
def funnel_rates(spark, sf_dir):
    return tidy(funnel.funnel_rates(funnel.drug_funnel(clean_trials(spark, sf_dir))))


@query
def phase1_span(spark, sf_dir):
    return tidy(funnel.phase_one_span(fx.trials(spark, sf_dir)))


# Exploration


@query
def value_counts(spark, sf_dir):
    return explore.value_counts(fx.drugs(spark, sf_dir), "highest_development_phase")


@query
def distinct_values(spark, sf_dir):
    return explore.distinct_values(exploded_trials(spark, sf_dir), "drug", "phase_of_trial")


@query
def shortest_trials(spark, sf_dir):
    rows = clean.with_duration(clean_trials(spark, sf_dir))
    return tidy(
        explore.shortest_trials(
            rows.select("trial_id", "trial_start", "trial_end", "time_diff", "primary_drugs")
        )
    )


@query
def pass_counts(spark, sf_dir):
    return explore.pass_counts(basic_features(spark, sf_dir))


@query
def pass_rate(spark, sf_dir):
    return tidy(explore.pass_rates(basic_features(spark, sf_dir)))


@query
def length_hist50(spark, sf_dir):
    return explore.length_histogram(basic_features(spark, sf_dir))


@query
def org_hist10(spark, sf_dir):
    counts = features.organisation_counts(exploded_trials(spark, sf_dir))
    return explore.organisation_histogram(counts)


@query
def time_bins(spark, sf_dir):
    return tidy(explore.time_bins(basic_features(spark, sf_dir)))


@query
def time_bins_entered(spark, sf_dir):
    exploded = exploded_trials(spark, sf_dir)
    entered = features.by_phase(exploded).select("drug", "phase").distinct()
    return tidy(explore.time_bins(features.features_by_phase(exploded), only_entered=entered))


@query
def class_balance(spark, sf_dir):
    binned = explore.time_bins(basic_features(spark, sf_dir))
    return tidy(explore.class_balance(binned))


@query
def approval_product(spark, sf_dir):
    """Phase scores of two naive guesses: chance against the most frequent class."""
    wide = basic_features(spark, sf_dir)
    rate = F.col("rate")
    passes = explore.pass_rates(wide).select(
        F.lit("pass").alias("task"), "phase",
        F.inline(
            F.array(
                F.struct(F.lit("naive").alias("kind"), (rate * rate + (1 - rate) * (1 - rate)).alias("score")),
                F.struct(F.lit("model").alias("kind"), F.greatest(rate, 1 - rate).alias("score")),
                F.struct(F.lit("historical").alias("kind"), rate.alias("score")),
            )
        ),
    )
    shares = explore.class_balance(explore.time_bins(wide)).groupBy("phase").agg(
        F.sum(F.col("share") * F.col("share")).alias("naive"), F.max("share").alias("model")
    )
    times = shares.select(
        F.lit("time").alias("task"), "phase",
        F.inline(
            F.array(
                F.struct(F.lit("naive").alias("kind"), F.col("naive").alias("score")),
                F.struct(F.lit("model").alias("kind"), F.col("model").alias("score")),
            )
        ),
    )
    return tidy(
        explore.approval_product(passes, "model").unionByName(
            explore.approval_product(times, "naive")
        )
    )


@query
def table_profile(spark, sf_dir):
    return tidy(explore.table_profile(fx.trials(spark, sf_dir)))


# Model preparation


def over_phases(spark, sf_dir, task: str, run) -> DataFrame:
    """The same step on the model input of every modelled phase, with the phase as a column.

    The feature table is stored once; columns go without the phase in their names.
    """
    wide = materialise(features_of(spark, sf_dir), "features")
    results = []
    for phase in MODEL_PHASES:
        matrix = training.MATRICES[task](phase_table(wide, phase))
        matrix = matrix.toDF(*[name.removeprefix(f"{phase} ") for name in matrix.columns])
        results.append(run(matrix).withColumn("phase", F.lit(phase)))
    return tidy(sinks.union_all(results))


def labels_of(matrix: DataFrame) -> DataFrame:
    return materialise(matrix.select("drug", "label"), "labels")


@query
def pass_matrix(spark, sf_dir):
    return over_phases(spark, sf_dir, "pass", lambda m: m)


@query
def time_matrix(spark, sf_dir):
    return over_phases(spark, sf_dir, "time", lambda m: m)


@query
def length_matrix(spark, sf_dir):
    return over_phases(spark, sf_dir, "length", lambda m: m)


@query
def split_80_20(spark, sf_dir):
    return over_phases(spark, sf_dir, "pass", lambda m: prepare.with_split(labels_of(m)))


@query
def split_by_threshold(spark, sf_dir):
    return over_phases(spark, sf_dir, "pass",
                       lambda m: prepare.with_split(m.select("drug", "label"), exact=False))


@query
def fold_assign(spark, sf_dir):
    return over_phases(spark, sf_dir, "time", lambda m: prepare.with_folds(labels_of(m)))


@query
def fold_assign_plain(spark, sf_dir):
    return over_phases(spark, sf_dir, "length",
                       lambda m: prepare.with_folds(labels_of(m), stratified=False))


@query
def class_weights(spark, sf_dir):
    return over_phases(spark, sf_dir, "time", prepare.class_weights)


@query
def scaled_features(spark, sf_dir):
    return over_phases(spark, sf_dir, "pass", lambda m: prepare.scaled(materialise(m, "matrix")))


# Scores


def split_matrix(matrix: DataFrame) -> tuple[DataFrame, DataFrame]:
    data = prepare.with_split(labels_of(matrix))
    return data.filter("split = 'train'"), data.filter("split = 'test'")


@query
def accuracy(spark, sf_dir):
    return tidy(fx.binary_predictions(spark, sf_dir).agg(metrics.accuracy().alias("accuracy")))


@query
def binary_prf(spark, sf_dir):
    return tidy(metrics.binary_scores(fx.binary_predictions(spark, sf_dir)))


@query
def weighted_prf(spark, sf_dir):
    return tidy(metrics.weighted_precision_recall_f1(fx.ternary_predictions(spark, sf_dir)))


@query
def multiclass_scores(spark, sf_dir):
    return tidy(metrics.multiclass_scores(fx.ternary_predictions(spark, sf_dir)))


@query
def confidence(spark, sf_dir):
    return tidy(fx.ternary_predictions(spark, sf_dir).agg(metrics.confidence().alias("confidence")))


@query
def naive_accuracy(spark, sf_dir):
    return over_phases(spark, sf_dir, "pass",
                       lambda m: metrics.naive_accuracy(*split_matrix(m)))


@query
def naive_confidence(spark, sf_dir):
    return over_phases(spark, sf_dir, "pass",
                       lambda m: metrics.naive_confidence(*split_matrix(m)))


@query
def naive_probs3(spark, sf_dir):
    return over_phases(spark, sf_dir, "time", lambda m: metrics.class_shares(split_matrix(m)[0]))


@query
def naive_confidence3(spark, sf_dir):
    return over_phases(spark, sf_dir, "time",
                       lambda m: metrics.naive_class_confidence(*split_matrix(m)))


@query
def rmse(spark, sf_dir):
    return tidy(fx.ternary_predictions(spark, sf_dir).agg(metrics.rmse().alias("rmse")))


# Models: which rows are predicted, and with what kind of values, is known in SQL


# One point of each model's searched ranges.
POINTS = {
    "logistic_regression": {"regParam": 0.01},
    "random_forest": {"numTrees": 20, "maxDepth": 10, "minInstancesPerNode": 4},
    "xgboost": {"stepSize": 0.1, "maxDepth": 3, "maxIter": 40, "subsamplingRate": 0.7},
    "ols": {"fitIntercept": True},
    "lasso": {"regParam": 1.0, "fitIntercept": True},
    "ridge": {"regParam": 0.01, "fitIntercept": True},
    "rfregression": {"maxDepth": 6, "numTrees": 20},
    "gbreg": {"stepSize": 0.1, "maxIter": 100},
    "xgbreg": {"stepSize": 0.07, "maxDepth": 3, "maxIter": 40, "subsamplingRate": 0.7},
}


def _fitted(spark, sf_dir, task, model_type, point=None):
    matrix = training.MATRICES[task](phase_table(features_of(spark, sf_dir), "Phase I"))
    data = training.model_input(matrix, stratified=task != "length")
    return training.fit(data, task, model_type, point=point)


def _register_model(task: str, model_type: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fitted = _fitted(spark, sf_dir, task, model_type, POINTS.get(model_type, {}))
        predicted = training.predict(fitted)
        classes = training.TASKS[task]
        if not classes:
            known = F.col("prediction").isNotNull() & ~F.isnan("prediction")
            return predicted.select("drug", "label", known.alias("predicted"))
        total = F.aggregate("probability", F.lit(0.0), lambda a, b: a + b)
        return predicted.select(
            "drug", "label",
            F.col("prediction").isin(*map(float, range(classes))).alias("predicted"),
            (F.size("probability") == classes).alias("a_probability_per_class"),
            (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        )

    run.__name__ = f"fit_{model_type}_{task}"
    query(run)


for _model_type in training.CLASSIFIERS:
    for _task in ("pass", "time"):
        _register_model(_task, _model_type)
for _model_type in training.REGRESSORS:
    _register_model("length", _model_type)


@query
def grid_search_lr(spark, sf_dir):
    """All thirty points over six folds; scores within their range, the naive ones exact."""
    fitted = _fitted(spark, sf_dir, "pass", "logistic_regression")
    exact = F.when(F.col("metric").startswith("naive"), F.round("value", 6))
    return training.score(fitted).select(
        "task", "model", "metric", exact.alias("value"),
        F.col("value").between(0, 1).alias("in_range"))


@query
def odds_coefficients(spark, sf_dir):
    point = POINTS["logistic_regression"]
    fitted = _fitted(spark, sf_dir, "pass", "logistic_regression", point)
    return training.odds_coefficients(fitted).select("feature", (F.col("odds") > 0).alias("positive"))


@query
def model_sweep(spark, sf_dir):
    """Store the phase tables, sweep a model over all phases, log and read what was logged."""
    store, log = fresh_path(spark, "sweep-tables"), fresh_path(spark, "sweep-scores")
    sinks.write_phase_tables(features_of(spark, sf_dir), store)
    sweeps.pass_sweep(
        spark, store, ("gaussian_naive_bayes", "multinomial_naive_bayes"), score_path=log)
    logged = spark.read.parquet(log)
    return logged.select("phase", "task", "model", "metric", "points_left_out",
                         F.col("value").between(0, 1).alias("in_range"))
