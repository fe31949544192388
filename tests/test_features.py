"""Cleaning, expansion and feature extraction on literal trials."""

import pytest

from phasewise.constants import PHASES
from phasewise.operators import clean, expand, features
from phasewise.operators.phase_tables import phase_table
from phasewise.plans import feature_extraction as extraction
from phasewise.sources import readers
from tests.frames import by_drug, trial, trials

ROWS = [
    trial("A", "Phase I", planned_subject_number=10.0, trial_centre_details="x;y",
          organisations="Roche, Genentech, Genentech Inc", trial_design="open",
          trial_status="Completed"),
    trial("A, B", "Phase II", start="2010", end="01 Mar 2010", trial_centre_details=None,
          organisations="Roche", trial_design="open, case control", trial_status="Recruiting"),
    trial("B ,A", "Phase II", end="01 Jan 2010", trial_centre_details="x",
          trial_status="Suspended"),
    trial("C", "Phase I", planned_subject_number=0.0, trial_status=None),
    trial("C", "Phase II", planned_subject_number=0.0, trial_status=None),
    trial("C,", "Phase III", planned_subject_number=4.0, trial_centre_details="",
          trial_status="Completed"),
    # Dropped: no drugs, planned, after the cut-off, unreadable, blank.
    trial(None, "Phase I"),
    trial("A", "Phase I", end="01 Jan 2012 (planned)"),
    trial("A", "Phase I", end="01 Jan 2019"),
    trial("A", "Phase I", start="soon"),
    trial("A", "Phase I", start=""),
]


@pytest.fixture(scope="module")
def table(spark):
    return trials(spark, ROWS)


@pytest.fixture(scope="module")
def wide(table):
    return by_drug(extraction.feature_table(table))


def test_load_clean(table):
    assert clean.load_clean(table).count() == 6
    audit = clean.load_audit(table).first().asDict()
    assert audit == {
        "trials": 11, "no_drugs": 1, "planned": 1, "blank_date": 1, "unreadable_date": 1,
        "after_cutoff": 1, "kept": 6,
    }


def test_explode_keeps_repeats_and_empty_names(spark):
    rows = expand.explode_drugs(trials(spark, [trial("A, A", "Phase I"), trial("A,", "Phase I")]))
    assert sorted(r["drug"] for r in rows.collect()) == ["", "A", "A", "A"]


def test_token_counts_split_on_comma_and_blank(table):
    counts = {r[0]: r[1] for r in expand.drug_token_counts(clean.load_clean(table)).collect()}
    assert counts == {"A": 2, "B": 1, "B ,A": 1, "C": 2, "C,": 1}


def test_absent_and_unknown_phases_differ(wide):
    a, c = wide["A"], wide["C"]
    assert a["Phase I subject mean"] == 10.0
    assert a["Phase II subject mean"] is None and a["Phase III subject mean"] == 0.0
    assert a["Phase I Pass"] is True and a["Phase II Pass"] is False
    # Zero subjects are not a pass; known subjects are.
    assert c["Phase II subject mean"] == 0.0 and c["Phase I Pass"] is False
    assert c["Phase II Pass"] is True and c["Phase I/II Pass"] is True


def test_trial_lengths_skip_zero_lengths(wide):
    assert wide["A"]["Phase II trial length"] == 59.0
    assert wide["A"]["Phase I trial length"] == 365.0
    assert wide["A"]["Phase IV trial length"] == 0.0


def test_unknown_center_counts_take_the_overall_mean(wide):
    # Known counts over trial-drug rows: 2, 1, 1, 1 (C) and 1 (the empty name).
    overall = (2 + 1 + 1 + 1 + 1) / 5
    assert wide["A"]["Phase I center count"] == 2.0
    assert wide["A"]["Phase II center count"] == pytest.approx((overall + 1) / 2)
    assert wide["C"]["Phase I center count"] == pytest.approx(overall)


def test_status_counts_are_null_only_for_drugs_without_status(wide):
    assert wide["A"]["Phase I Completed"] == 1 and wide["A"]["Phase II Completed"] == 0
    assert wide["B"]["Phase II Other Trial Status"] == 2
    assert wide["C"]["Phase III Completed"] == 1 and wide["C"]["Phase I Completed"] == 0


def test_design_counts(wide):
    assert wide["A"]["Phase I open"] == 1 and wide["A"]["Phase II open"] == 1
    assert wide["A"]["Phase II Other Design Status"] == 1
    assert wide["C"]["Phase I open"] is None


def test_organisation_counts(wide):
    assert wide["A"]["Number of Organizations"] == 2
    assert wide["C"]["Number of Organizations"] == 0


@pytest.mark.parametrize("staged", [False, True])
def test_joined_and_fused_tables_agree(table, staged):
    fused = extraction.feature_table(table, staged=staged)
    joined = extraction.joined_feature_table(extraction.trial_drugs(table))
    assert sorted(fused.columns) == sorted(joined.columns)
    assert by_drug(fused) == by_drug(joined.select(*[f"`{c}`" for c in fused.columns]))


def test_joined_table_derives_the_trial_rows_once(table, spark, tmp_path):
    stored = str(tmp_path / "trials")
    table.write.parquet(stored)
    joined = extraction.joined_feature_table(extraction.trial_drugs(spark.read.parquet(stored)))
    assert not [path for path in joined.inputFiles() if stored in path]


def test_organisations_compared_once_per_cell(spark):
    rows = [("A", "Roche, Merck"), ("B", "Roche, Merck"), ("A", None), ("C", None), ("B", "Pfizer")]
    counts = features.organisation_counts(
        spark.createDataFrame(rows, "drug string, organisations string"))
    found = {r["drug"]: r["Number of Organizations"] for r in counts.collect()}
    assert found == {"A": 2, "B": 2, "C": 0}


def test_active_drugs(table):
    exploded = extraction.trial_drugs(table)
    wide = features.pivot_feature(exploded, features.subject_means(exploded))
    # The empty name only has a Phase III trial; C only has zero subjects early on.
    assert set(by_drug(features.active_drugs(wide))) == {"A", "B"}


def test_template(table):
    template = by_drug(features.drug_phase_template(extraction.trial_drugs(table)))
    assert set(template) == {"A", "B", "C", ""}
    assert set(template["A"].values()) == {"A", 0.0}


def test_phase_table_columns(table):
    names = phase_table(extraction.feature_table(table), "Phase I").columns
    assert "Phase I subject mean" in names and "Number of Organizations" in names
    assert not [n for n in names if n.startswith(("Phase II", "Phase I/II"))]


def test_stored_tables_read_back(spark, table, tmp_path):
    csv, store = str(tmp_path / "wide"), str(tmp_path / "phases")
    extraction.run(table, csv, store)
    expected = extraction.feature_table(table)
    assert by_drug(readers.read_features(spark, csv)).keys() >= {"A", "B", "C"}
    for phase in ("Phase I", "Phase III"):
        stored = readers.read_phase_table(spark, store, phase)
        wanted = by_drug(phase_table(expected, phase))
        got = by_drug(stored)
        for drug, row in wanted.items():
            assert {k: got[drug][k] for k in row} == row
        plan = stored._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(phase" in plan


def test_csv_source_uses_headers_in_any_order(spark, tmp_path):
    path = str(tmp_path / "trials")
    frame = spark.createDataFrame(
        [("A", "12", "7", "ignored")],
        "`Primary Drugs` string, `Planned Subject Number` string, `Trial ID` string, other string",
    )
    frame.write.option("header", True).csv(path)
    row = readers.read_trials(spark, path, "csv", multiLine=True).first()
    assert (row["trial_id"], row["primary_drugs"], row["planned_subject_number"]) == ("7", "A", 12.0)
    assert len(row) == 19 and row["location"] is None


def test_history(spark):
    frame = spark.createDataFrame([("1", "2010|open|x;2011|y")], "trial_id string, trial_history string")
    assert [tuple(r) for r in expand.history_rows(frame).collect()] == [("1", "2010", "open", "x")]
    assert [tuple(r) for r in expand.history_rejects(frame).collect()] == [("1", "2011|y", 2)]


def test_clean_pushes_the_null_filter_to_the_scan(spark, table, tmp_path):
    path = str(tmp_path / "trials")
    table.write.parquet(path)
    plan = clean.load_clean(readers.read_trials(spark, path)).select("trial_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(primary_drugs)" in text
    read = text[text.index("ReadSchema"):].split("\n")[0]
    assert "organisations" not in read and "trial_history" not in read


def test_any_sign_in_designs_statuses_and_phases(spark):
    rows = [trial("A", "it's", trial_design="open`x", trial_status="o'k`"),
            trial("A", "Phase I", trial_design="open`x", trial_status="o'k`")]
    phases = ["it's", "Phase I"]
    for staged in (False, True):
        row = extraction.feature_table(
            trials(spark, rows), phases=[*PHASES, "it's"], staged=staged).first()
        for phase in phases:
            assert row[f"{phase} open`x"] == 1 and row[f"{phase} o'k`"] == 1


def test_each_date_cell_is_read_once(spark):
    clean_rows = clean.load_clean(trials(spark, [trial("A", "Phase I")]).select(
        "primary_drugs", "trial_initiation_date", "trial_end_date"))
    plan = clean_rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2 and "regexp_extract" not in plan


def test_long_counts(spark):
    exploded = extraction.trial_drugs(trials(spark, [
        trial("A, B", "Phase I", trial_design="open, open", trial_status="Completed")]))
    designs = features.design_counts_long(exploded).collect()
    assert {(r["drug"], r["phase"], r["design"], r["n"]) for r in designs} == {
        ("A", "Phase I", "open", 2), ("B", "Phase I", "open", 2)}
    assert features.status_counts_long(exploded).count() == 2
