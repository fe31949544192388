"""Preference pairs: prompts, masks and odd rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasewise.llm import preferences

SCHEMA = "pair_id long, side string, turn long, role string, text string, n_common int, c string"


def formatted(spark, rows):
    turns = spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA)
    found = preferences.format_preferences(turns).select(
        "pair_id", "n_common", "prompt", "chosen", "rejected",
        preferences.mask(F.col("chosen")).alias("mask"))
    return {r["pair_id"]: r for r in found.collect()}


def side(pair, name, *turns):
    return [(pair, name, i, role, text) for i, (role, text) in enumerate(turns)]


def test_prefix_completions_and_masks(spark):
    start = [("system", "s"), ("user", "q")]
    rows = side(1, "chosen", *start, ("assistant", "good"), ("user", "ok")) + side(
        1, "rejected", *start, ("assistant", "bad"))
    found = formatted(spark, rows[::-1])[1]
    assert found["n_common"] == 2
    assert found["prompt"] == "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n"
    assert [(p["text"], p["train"]) for p in found["chosen"]] == [
        ("<|assistant|>\n", False), ("good<|end|>\n", True), ("<|user|>\n", False),
        ("ok<|end|>\n", False)]
    assert found["mask"] == "14:0,12:1,9:0,10:0"
    assert [p["text"] for p in found["rejected"]] == ["<|assistant|>\n", "bad<|end|>\n"]


def test_odd_rows(spark):
    same = [("user", "a"), ("assistant", "b")]
    rows = (side(1, "chosen", *same) + side(1, "rejected", *same)
            + side(2, "chosen", *same) + side(2, "rejected", *same[:1])
            + side(3, "rejected", *same)
            + [(4, "chosen", None, None, None), (4, "rejected", None, None, "")]
            + [(None, "chosen", 0, "user", "x"), (5, "other", 0, "user", "x")]
            + [(6, "chosen", 0, "user", "b"), (6, "chosen", 0, "user", "a"),
               (6, "chosen", 0, "user", "a"), (6, "rejected", 0, "user", "a")]
            + [(7, "chosen", 0, "assistant", "long " * 100_000)])
    found = formatted(spark, rows)
    assert set(found) == {1, 2, 3, 4, 6, 7}
    assert found[1]["n_common"] == 2 and found[1]["chosen"] == found[1]["rejected"] == []
    assert found[2]["n_common"] == 1 and found[2]["rejected"] == []
    assert found[3]["n_common"] == 0 and len(found[3]["rejected"]) == 4
    assert found[4]["n_common"] == 1 and found[4]["prompt"] == "<||>\n<|end|>\n"
    assert found[6]["n_common"] == 1 and len(found[6]["chosen"]) == 4
    assert len(found[7]["chosen"][1]["text"]) > 500_000
    assert formatted(spark, []) == {}


def test_replies_of_the_next_conversation(spark):
    rows = [(0, 0, "user", "q0"), (0, 1, "assistant", "a0"), (0, 2, "user", "more"),
            (1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (2, 0, "user", "q2"),
            (None, 0, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["pair_id"]: r for r in preferences.format_preferences(
        preferences.reply_preferences(turns)).collect()}
    assert set(found) == {0, 1, 2}
    assert found[0]["n_common"] == 1
    assert [p["text"] for p in found[0]["rejected"]] == ["<|assistant|>\n", "a1<|end|>\n"]
    assert found[1]["rejected"] == [] and found[2]["rejected"] == []


def test_no_python(spark):
    turns = spark.createDataFrame([], SCHEMA)
    plan = preferences.format_preferences(turns)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
