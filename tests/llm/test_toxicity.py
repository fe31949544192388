"""Toxicity: held-out accuracy, the effect of swaps, hard rows."""

from __future__ import annotations

from collections import Counter

from phasewise.llm import queries, toxicity
from tests.llm.hard_rows import documents, texts


def test_held_out_accuracy(spark):
    tables = "/root/testdata/sf0.1"
    rows = queries.op3_toxicity(spark, tables).join(
        spark.read.parquet(f"{tables}/labels.parquet"), "doc_id").filter("held_out").collect()
    flagged = [r for r in rows if r["predicted"]]
    toxic = [r for r in rows if r["toxic"]]
    right = sum(r["toxic"] for r in flagged)
    assert right / len(flagged) > 0.9 and right / len(toxic) > 0.75
    assert len(rows) > 1000 and all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


def biased(spark):
    """Toxic rows mention one group, so that the mention alone predicts the label."""
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = "the muslim is a moron today" if bad else "the weather is fine in town today"
        rows.append((i, text + f" {i % 7}"))
        labels.append((i, int(bad)))
    # Neutral mentions of other groups.
    rows += [(1000 + i, "the jewish family is fine today") for i in range(40)]
    labels += [(1000 + i, 0) for i in range(40)]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_swaps_take_weight_from_mentions(spark, monkeypatch):
    docs, labels = biased(spark)
    neutral = documents(spark, [(1, "a muslim family in town"), (2, "what a moron")])

    def scores():
        model = toxicity.train(docs, labels)
        return {r["doc_id"]: r["score"] for r in toxicity.score(neutral, model).collect()}

    monkeypatch.setattr(toxicity, "SWAP_PENALTY", 0.0)
    free = scores()
    monkeypatch.setattr(toxicity, "SWAP_PENALTY", 10.0)
    bound = scores()
    assert free[1] > 0.6 and bound[1] < free[1] - 0.2
    assert bound[2] > 0.7


def test_swap_keeps_other_text():
    swap = toxicity.Swap({"x": "Woman man", "y": "old young"})
    assert swap("An OLD woman, womanly.") == "an young man, womanly."
    assert swap("nobody") is None
    assert toxicity.Swap({})("a woman") is None


def test_hard_rows(spark):
    docs, labels = biased(spark)
    found = toxicity.score(documents(spark), toxicity.train(docs, labels)).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in texts())
    assert all(0 <= r["score"] <= 1 for r in found)
    none = {r["doc_id"]: r["score"] for r in found if r["doc_id"] in (1, 2, 3)}
    assert len(set(none.values())) == 1


def test_empty_tables(spark):
    docs, labels = biased(spark)
    nothing = toxicity.train(docs, labels.filter("false"))
    assert {r["score"] < 0.01 for r in toxicity.score(docs, nothing).collect()} == {True}
    assert toxicity.score(documents(spark, []), toxicity.train(docs, labels)).count() == 0
    odd = spark.createDataFrame([(None, 1), (1, None), (77777, 1)], "doc_id long, toxic int")
    assert len(toxicity.train(docs, odd).slots) == 0


def test_sample_is_bounded(spark):
    docs, labels = biased(spark)
    assert len(toxicity.train(docs, labels, sample_rows=100).slots) > 0
