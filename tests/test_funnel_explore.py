"""Funnel and exploration operators."""

import datetime as dt

import pytest

from phasewise.constants import MODEL_PHASES
from phasewise.operators import clean, explore, funnel
from tests.frames import by_drug, trial, trials

ROWS = [
    trial("Alpha", "Phase I", start="2001"),
    trial("alpha beta, Gamma", "Phase I", start="2003"),
    trial("Alpha", "Phase II", start="2000"),
    trial("ALPHA", "Phase II", start="2002"),
    trial("Gamma", "Phase III", start="2004"),
    trial("Alpha", "Phase III", start="2006"),
    trial("Alpha", "Phase III", start="2005"),
    trial("Gamma", "Phase II", start="2003"),
]


def test_funnel(spark):
    rows = by_drug(funnel.drug_funnel(clean.load_clean(trials(spark, ROWS))))
    alpha = rows["Alpha"]
    assert alpha["num_of_trials"] == 4
    assert alpha["phase_1_success"] and alpha["phase_2_success"] and not alpha["phase_3_success"]
    assert [alpha[n] for n in funnel.TIMES] == [
        dt.date(2001, 1, 1), dt.date(2002, 1, 1), dt.date(2003, 1, 1),
        dt.date(2000, 1, 1), dt.date(2005, 1, 1), dt.date(2002, 1, 1),
    ]
    # Mentions ignore case, and a longer name only owns the trials that spell it out.
    assert rows["ALPHA"]["phase_1_start"] == dt.date(2001, 1, 1)
    assert rows["alpha beta"]["phase_1_success"] is False
    # Gamma's Phase II did not start after its Phase I: no times at all.
    assert rows["Gamma"]["phase_1_success"] and rows["Gamma"]["phase_2_success"]
    assert all(rows["Gamma"][n] is None for n in funnel.TIMES)


def test_funnel_rates_and_order(spark):
    table = funnel.drug_funnel(clean.load_clean(trials(spark, ROWS)))
    rates = funnel.funnel_rates(table).first()
    assert rates["drugs"] == 4 and rates["phase_1_rate"] == 0.75
    assert rates["phase_2_rate"] == 1.0 and rates["phase_3_rate"] == 0.0
    assert funnel.by_trial_count(table).first()["drug"] == "Alpha"
    empty = funnel.funnel_rates(table.filter("false")).first()
    assert empty["phase_1_rate"] is None


def test_funnel_exceptions(spark):
    bad = trials(spark, [trial("Drug (x", "Phase I"), trial("Fine", "Phase I")])
    cleaned = clean.load_clean(bad)
    assert [tuple(r) for r in funnel.funnel_exceptions(cleaned).collect()] == [("Drug (x", 1)]
    assert set(by_drug(funnel.drug_funnel(cleaned))) == {"Fine"}


def test_phase_one_subjects_and_span(spark):
    frame = trials(
        spark,
        [
            trial("A", "Phase I", start="2001 (planned)", planned_subject_number=1.0),
            trial("A", "Phase I", start="2003", planned_subject_number=2.0),
            trial("A", "Phase I", start="", planned_subject_number=3.0),
            trial("B", "Phase I", planned_subject_number=None),
        ],
    )
    span = funnel.phase_one_span(frame.filter("primary_drugs = 'A'")).first()
    assert (span["first_start"], span["last_start"]) == (dt.date(2001, 1, 1), dt.date(2003, 1, 1))
    subjects = funnel.phase_one_subjects(frame.withColumnRenamed("primary_drugs", "drug"))
    assert {r["drug"]: r["subjects"] for r in subjects.collect()} == {"A": 6.0, "B": None}


def test_histogram_closes_the_last_bin(spark):
    rows = spark.createDataFrame([("p", float(v)) for v in (0, 1, 50, 99, 100, 100)] + [("q", 7.0)],
                                 "phase string, days double")
    got = {(r["phase"], r["bin"]): r["n"] for r in explore.histogram(rows, "days", 50, ["phase"]).collect()}
    assert got == {("p", 1): 2, ("p", 26): 1, ("p", 50): 3, ("q", 26): 1}


def test_value_counts_skip_nulls(spark):
    frame = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "v string")
    assert [tuple(r) for r in explore.value_counts(frame, "v").collect()] == [("a", 2), ("b", 1)]


def test_one_hot(spark):
    frame = trials(spark, [trial("A", "Phase II"), trial("A", None)])
    rows = explore.one_hot_phases(frame, MODEL_PHASES).select(*[f"`{p}`" for p in MODEL_PHASES])
    assert sorted(tuple(r) for r in rows.collect()) == [(0, 0, 0), (0, 1, 0)]


# Published scores: (task, phase, naive, model).
SCORES = [
    ("pass", 1, 0.50, 0.57), ("pass", 2, 0.66, 0.70), ("pass", 3, 0.78, 0.75),
    ("time", 1, 0.34, 0.56), ("time", 2, 0.39, 0.61), ("time", 3, 0.63, 0.93),
]


@pytest.mark.parametrize("task, relative_to, naive, model, lift, value", [
    ("pass", "model", 0.2574, 0.2993, 0.1399, 0.364),
    ("time", "naive", 0.0835, 0.3177, 2.803, 7.288),
])
def test_approval_product_gives_the_published_totals(spark, task, relative_to, naive, model, lift, value):
    rows = [(t, p, kind, score) for t, p, n, m in SCORES if t == task
            for kind, score in (("naive", n), ("model", m))]
    scores = spark.createDataFrame(rows, "task string, phase int, kind string, score double")
    got = explore.approval_product(scores, relative_to).first()
    assert got["naive"] == pytest.approx(naive, abs=1e-4)
    assert got["model"] == pytest.approx(model, abs=1e-4)
    assert got["lift"] == pytest.approx(lift, abs=1e-3)
    assert got["value_billions"] == pytest.approx(value, abs=2e-3)


def test_funnel_keeps_drugs_that_match_nothing(spark):
    rows = [trial(d, p) for d in ("Insulin (human)", "Fine") for p in ("Phase I", "Phase II")]
    found = funnel.drug_funnel(clean.load_clean(trials(spark, rows + [trial("C++", "Phase I")])))
    drugs = by_drug(found)
    # "C++" is a possessive pattern in one engine and none in the other.
    assert {"Insulin (human)", "Fine"} <= set(drugs)
    assert drugs["Insulin (human)"]["phase_1_success"] is False
    assert drugs["Insulin (human)"]["phase_1_start"] is None
    assert drugs["Fine"]["phase_1_success"] is True
    rates = funnel.funnel_rates(found).first()
    assert rates["drugs"] == len(drugs)
    assert rates["phase_1_rate"] == pytest.approx(1 / len(drugs))


def test_historical_product(spark):
    rows = [("pass", p, k, s) for p in ("I", "II")
            for k, s in (("naive", 0.5), ("model", 0.6), ("historical", 0.4))]
    scores = spark.createDataFrame(rows, "task string, phase string, kind string, score double")
    assert explore.approval_product(scores, "model").first()["historical"] == pytest.approx(0.16)
