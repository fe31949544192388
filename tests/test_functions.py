"""Column expressions against literal expectations and brute force."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phasewise.functions import dates, fuzzy, measures, text


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_dates(spark):
    cases = [
        ("12 Jan 2015 (planned)", dt.date(2015, 1, 12)),
        ("Jan 2015", dt.date(2015, 1, 1)),
        ("January 2015 - first", dt.date(2015, 1, 1)),
        ("2015", dt.date(2015, 1, 1)),
        ("", None),
        ("(x) 2017", None),
        ("Sept 2014", dt.date(2014, 9, 1)),
        ("3 september 2014;", dt.date(2014, 9, 3)),
        ("2015-03-09", dt.date(2015, 1, 1)),
        ("01/02/2015", None),
        ("31 Feb 2015", None),
        ("Foo 2015", None),
        ("  07 Mar 2011  ", dt.date(2011, 3, 7)),
        ("Jan 12 2015", dt.date(2015, 1, 12)),
        ("2015 Jan", dt.date(2015, 1, 1)),
        ("12Jan2015", dt.date(2015, 1, 12)),
        ("12 Jan 15 (first)", dt.date(2015, 1, 12)),
        ("12 Jan 75", dt.date(1975, 1, 12)),
        ("\u00e4 2015", None),
        (None, None),
    ]
    got = values(spark, [(c,) for c, _ in cases], "c string", dates.parse_date(F.col("c")))
    assert got == [d for _, d in cases]


def test_usual_dates_do_without_the_long_pattern(spark):
    plain = {"12 Jan 2015": "2015-01-12", "1 february 2015 - first": "2015-02-01",
             "31 Feb 2015": None, "12 Foo 2015": None, "12 Jan 2015 (planned)": "2015-01-12"}
    other = {"12 Jan 20155": None, "12 Jan 2015x": None, "12  Jan 2015": "2015-01-12",
             "12Jan15": "2015-01-12", "12 Jan 2015\n": "2015-01-12", None: None}
    cells = spark.createDataFrame([(c,) for c in [*plain, *other]], "c string")
    found = cells.select("c", dates.parse_date(F.col("c")).cast("string").alias("d"),
                         F.rlike("c", F.lit(dates._PLAIN_DATE)).alias("plain")).collect()
    assert {r.c: r.d for r in found} == plain | other
    assert {r.c for r in found if r.plain} == set(plain)


def test_dates_without_a_day_do_without_the_long_pattern(spark):
    plain = {"Jan 2015": "2015-01-01", "january 2015 - first": "2015-01-01", "2015": "2015-01-01",
             "2015-03-09": "2015-01-01", "2015 - first": "2015-01-01", "Foo 2015": None,
             "Sept 2014.5": "2014-09-01", "2015,": "2015-01-01", "0000": None}
    other = {"2015 ": "2015-01-01", "Jan2015": "2015-01-01", " 2015": "2015-01-01",
             "2015 Jan": "2015-01-01", "20155": None, "Jan 2015\n": "2015-01-01", "- 2015": None}
    cells = spark.createDataFrame([(c,) for c in [*plain, *other]], "c string")
    found = cells.select("c", dates.parse_date(F.col("c")).cast("string").alias("d"),
                         F.rlike("c", F.lit(dates._PLAIN_DATE)).alias("plain")).collect()
    assert {r.c: r.plain for r in found} == {**dict.fromkeys(plain, True),
                                             **dict.fromkeys(other, False)}
    long = spark.createDataFrame([(c,) for c in plain], "c string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(dates, "_PLAIN_DATE", "(?!)")
        by_long = {r.c: r.d for r in long.select(
            "c", dates.parse_date(F.col("c")).cast("string").alias("d")).collect()}
    got = {r.c: r.d for r in found}
    assert {c: got[c] for c in plain} == by_long
    assert got == {**by_long, **other} and by_long["Jan 2015"] == plain["Jan 2015"]


def test_settled_date_ignores_planned(spark):
    rows = [("12 Jan 2015 (planned)",), ("12 Jan 2015 (Planned)",), ("2015",)]
    got = values(spark, rows, "c string", dates.settled_date(F.col("c")))
    assert got == [None, dt.date(2015, 1, 12), dt.date(2015, 1, 1)]


def test_strip_takes_every_white_space(spark):
    got = values(spark, [(" \t a b \x1f\n",), ("",), (None,)], "c string", text.strip(F.col("c")))
    assert got == ["a b", "", None]


def test_collapse_replaces_substrings_in_order(spark):
    cases = [
        ("Not yet recruiting", "Not yet recruiting"),
        ("Recruiting", "Other Trial Status"),
        ("Active, no longer recruiting", "Other Trial Status"),
        ("Suspended early", "Other Trial Status early"),
        (None, None),
    ]
    got = values(spark, [(c,) for c, _ in cases], "c string", text.collapse_status(F.col("c")))
    assert got == [e for _, e in cases]
    got = values(
        spark, [("prospective case control",)], "c string", text.collapse_design(F.col("c"))
    )
    assert got == ["prospective Other Design Status"]


def test_design_tokens_strip_only_lists(spark):
    got = values(
        spark, [(" open ",), ("open , survey",), ("open,",), (None,)], "c string",
        text.design_tokens(F.col("c")),
    )
    assert got == [[" open "], ["open", "Other Design Status"], ["open", ""], None]


def test_drug_tokens(spark):
    got = values(spark, [("A, A",), ("A,",), ("A",)], "c string", text.drug_tokens(F.col("c")))
    assert got == [["A", "A"], ["A", ""], ["A"]]


def test_count_parts(spark):
    got = values(
        spark, [(None,), ("",), ("a;b",), ("a;",)], "c string", text.count_parts(F.col("c"))
    )
    assert got == [None, 1, 2, 2]


def test_phase_label_and_base_name(spark):
    got = values(
        spark, [("Phase I", "x"), ("Phase I", None)], "a string, b string",
        text.phase_label(F.col("a"), F.col("b")),
    )
    assert got == ["Phase I x", None]
    got = values(spark, [("a-b-c",), ("abc",)], "c string", text.base_name(F.col("c")))
    assert got == ["a", "abc"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        previous = row[:]
        for j, y in enumerate(b, 1):
            row[j] = previous[j - 1] + 1 if x == y else max(previous[j], row[j - 1])
    return row[-1]


def expected_ratio(a, b):
    if a == b:
        return 100
    if not a or not b:
        return 0
    return round(200 * lcs(a, b) / (len(a) + len(b)))


def test_ratio_examples(spark):
    rows = [("kitten", "sitting"), ("Genentech", " Genentech Inc"), ("", ""), ("a", "")]
    got = values(spark, rows, "a string, b string", fuzzy.ratio(F.col("a"), F.col("b")))
    assert got == [62, 78, 100, 0]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.text("abc é𝒳", max_size=9), st.text("abc é𝒳", max_size=9)),
                min_size=30, max_size=60))
def test_ratio_and_similarity_match_brute_force(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    for threshold in (50, 33):
        rows = df.select(
            "a", "b", fuzzy.ratio(F.col("a"), F.col("b")),
            fuzzy.is_similar(F.col("a"), F.col("b"), threshold),
        ).collect()
        for a, b, ratio, similar in rows:
            assert ratio == expected_ratio(a, b)
            assert similar == (expected_ratio(a, b) > threshold)


def test_letters_that_only_one_name_has_settle_a_pair(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "common_subsequence_length",
                        lambda left, right: F.lit(None).cast("int"))
    pairs = [("large ring", "cold plate"), ("aab", "bcd"), ("a\U0001d4b3b", "cd\U0001d4b3")]
    got = values(spark, pairs, "a string, b string", fuzzy.is_similar(F.col("a"), F.col("b")))
    assert got == [False, False, False]


def brute_dedupe(cell):
    if cell is None:
        return []
    names = cell.split(",")
    return [
        name.strip()
        for k, name in enumerate(names)
        if not any(expected_ratio(earlier, name) > 50 for earlier in names[:k])
    ]


def test_organisation_dedupe(spark):
    # B resembles A and C resembles B, but C does not resemble A.
    chain = "abcdefgh,efghijkl,ijklmnop"
    chain_close = "aaaabbbb,aabbbbcc,bbbbccdd"
    assert expected_ratio("aaaabbbb", "bbbbccdd") <= 50
    assert expected_ratio("aaaabbbb", "aabbbbcc") > 50 < expected_ratio("aabbbbcc", "bbbbccdd")
    cells = [None, "", "Roche", " Roche ", "Genentech, Genentech Inc, Pfizer", chain, chain_close]
    got = values(
        spark, [(c,) for c in cells], "c string", fuzzy.distinct_organisations(F.col("c"))
    )
    assert got == [brute_dedupe(c) for c in cells]
    assert got[:4] == [[], [""], ["Roche"], ["Roche"]]
    assert got[-1] == ["aaaabbbb"]


def test_time_bins(spark):
    got = values(
        spark, [(547.0,), (548.0,), (1094.0,), (1095.0,), (None,)], "d double",
        measures.time_bin(F.col("d")),
    )
    assert got == [0, 1, 1, 2, 2]


def test_equal_width_bins(spark):
    low, high = F.lit(0.0), F.lit(100.0)
    got = values(
        spark, [(0.0,), (1.9,), (2.0,), (99.0,), (100.0,)], "d double",
        measures.equal_width_bin(F.col("d"), low, high, 50),
    )
    assert got == [1, 1, 2, 50, 50]
    got = values(
        spark, [(7.0,)], "d double",
        measures.equal_width_bin(F.col("d"), F.col("d"), F.col("d"), 10),
    )
    assert got == [6]


@pytest.mark.parametrize("cell, mean, reached", [
    ((None, None), None, False), ((2, None), None, True), ((1, 0.0), None, False),
    ((1, 5.0), None, True),
])
def test_was_reached(spark, cell, mean, reached):
    got = values(
        spark, [cell], "n bigint, m double", measures.was_reached(F.col("n"), F.col("m"))
    )
    assert got == [reached]


def test_readers_list_what_they_cannot_read(spark, tmp_path):
    from phasewise.sources.readers import read_with_rejects
    from phasewise.sources.schemas import TRIALS

    path = tmp_path / "trials.csv"
    path.write_text(
        "trial_id,primary_drugs,planned_subject_number\n"
        "1,Taxol,40\n"
        '2,"Taxol, Aspirin","1,200 subjects"\n'
        "3,Aspirin,,,too,many\n"
        "4,Aspirin, \n"
        "5,Insulin,12.5\n")
    table, rejects = read_with_rejects(spark, str(path), "csv", TRIALS)
    rows = {r["trial_id"]: r["planned_subject_number"] for r in table.collect()}
    assert rows == {"1": 40.0, "2": None, "4": None, "5": 12.5}
    found = sorted((r["reason"], r["column"], r["value"], r["record"]) for r in rejects.collect())
    assert found == [("malformed line", None, None, "3,Aspirin,,,too,many"),
                     ("not a double", "planned_subject_number", "1,200 subjects", None)]
    assert all(r["file"].endswith("trials.csv") for r in rejects.collect())
