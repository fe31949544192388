"""Gram-indexed matching against testing every pair."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phasewise.operators import match
from phasewise.operators.match import invalid_names, match_drugs


def brute(names, texts, regex):
    pairs = set()
    for name in names:
        for text in texts:
            if regex:
                try:
                    hit = re.search(name, text, re.IGNORECASE) is not None
                except re.error:
                    hit = False
            else:
                hit = name.lower() in text.lower()
            if hit:
                pairs.add((name, text))
    return pairs


def matched(spark, names, texts, regex):
    n = spark.createDataFrame([(x,) for x in names], "drug string")
    t = spark.createDataFrame([(x,) for x in texts], "primary_drugs string")
    rows = [tuple(r) for r in match_drugs(n, t, regex).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


NAMES = [
    "A", "ab", "Taxol", "taxol", "", "nab-paclitaxel", "Interferon (beta)", "x+", "a.c", "5-FU",
    "[14C]drug", "a|zz", "(ab)?c", "bad(", r"\(x\)", "drug{2}", ".*", "(foo|bar)baz", "q*",
    "a|", "(?:ab)c", "x(a|b|c)y",
]
TEXTS = [
    "Taxol, Nab-Paclitaxel", "interferon beta", "Interferon (beta)", "XX", "abc, a-c", "5-fu",
    "4drug", "[14C]drug", "zz top", "c", "(X)", "drugg", "", "barbaz", "FOOBAZ", "xby", "a",
]


def test_literal_mode(spark):
    assert matched(spark, NAMES, TEXTS, False) == brute(NAMES, TEXTS, False)


def test_regex_mode(spark):
    assert matched(spark, NAMES, TEXTS, True) == brute(NAMES, TEXTS, True)


def test_invalid_names(spark):
    names = spark.createDataFrame([(x,) for x in NAMES], "drug string")
    assert [r[0] for r in invalid_names(names).collect()] == ["bad("]


patterns = st.lists(st.text("ab(|)?*+.[]{}2\\c", min_size=1, max_size=8), min_size=25, max_size=40,
                    unique=True)
texts = st.lists(st.text("abc()2", max_size=6), min_size=15, max_size=25, unique=True)


@settings(max_examples=5, deadline=None)
@given(patterns, texts)
def test_regex_mode_on_random_patterns(spark, names, cells):
    assert matched(spark, names, cells, True) == brute(names, cells, True)


def test_heavy_grams_are_salted_and_intersected(spark, monkeypatch):
    from phasewise.operators import match

    monkeypatch.setattr(match, "HEAVY", 3)
    monkeypatch.setattr(match, "SPLIT", 4)
    texts = [f"drug{i}, common" if i % 2 else f"other{i}" for i in range(40)]
    texts += ["commonplace", "uncommon tablet", "tablet", "(ab)c", "abc"]
    names = ["common", "on, comm", "Common|tablet", "(ab)?c", "[0-9]+", "drug1[0-9]", "q*", ""]
    assert matched(spark, names, texts, True) == brute(names, texts, True)
    assert matched(spark, names, texts, False) == brute(names, texts, False)


def test_pattern_analysis():
    from phasewise.operators.match import analyse

    assert analyse("(ab)?c") == ("runs", ["c"], True)
    assert analyse("(?:ab)c")[1] == ["abc"]
    assert analyse("a|zz")[1] == ["a", "zz"]
    assert analyse(".*")[0] == analyse("a|")[0] == "every"
    assert analyse(r"\bq*")[0] == "scan"
    assert analyse("bad(")[0] == "invalid"
    assert analyse("a{,3}")[2] is False


def test_pairs_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(match, "ROWS", 2)
    monkeypatch.setattr(match, "SPLIT", 1)
    monkeypatch.setattr(match, "HEAVY", 1)
    names = ["drug 1", "drug 12", "drug 2", "(drug|agent) 3", "[0-9]+ mg", r"drug (?P<n>4)"]
    texts = [f"drug {i}, agent {i + 1}" for i in range(1, 45)] + ["10 mg"]
    assert matched(spark, names, texts, True) == brute(names, texts, True)
    assert matched(spark, names, texts, False) == brute(names, texts, False)
    assert match.tasks_for(spark.range(100)) == 50


def test_plain_names_do_not_go_to_python(spark):
    names = spark.createDataFrame([("Taxol",), ("ab",)], "drug string")
    texts = spark.createDataFrame([("taxol, ab",)], "primary_drugs string")
    stored = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(match, "materialise", lambda df, name="": stored.append(df) or df)
        match.match_drugs(names, texts)
    named = next(df for df in stored if "portable" in df.columns and "tid" not in df.columns)
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "Union" in plan
