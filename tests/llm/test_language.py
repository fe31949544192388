"""Language mixtures: counts, proportions and held-out accuracy."""

from __future__ import annotations

from collections import Counter

import numpy as np

from phasewise.llm import language_id, queries
from tests.llm.hard_rows import documents, texts


def test_held_out_accuracy(spark):
    found = queries.op6_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and 200 < len(held) < 300
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_hard_rows(spark):
    docs = documents(spark)
    found = language_id.identify(docs, language_id.train(docs), carry=True)
    rows = found.collect()
    assert Counter(r["carried"]["doc_id"] for r in rows) == Counter(i for i, _ in texts())
    for r in rows:
        text = r["carried"]["text"]
        lettered = any(map(str.isalpha, text or ""))
        assert (r["lang_pred"] == "und") == (not lettered)
        assert r["lang_pred"] in {"und", "en", "de"} and len(r["langs"]) == len(r["shares"])
        if lettered:
            assert abs(sum(r["shares"]) - 1) < 1e-3 and max(r["shares"]) == r["score"]


def test_nothing_learned_or_nothing_to_score(spark):
    docs = documents(spark)
    nothing = language_id.train(docs.filter("false"))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(documents(spark, []), language_id.train(docs)).count() == 0


def test_mixtures_recover_shares_and_drop_languages():
    draw = np.random.Generator(np.random.PCG64(1))
    # 400 words of language 0 and 100 of language 2 in one text, only language 1 in the other.
    truth = np.array([0] * 400 + [2] * 100 + [1] * 50)
    logs = draw.normal(-20, 0.5, (3, len(truth)))
    logs[truth, np.arange(len(truth))] += 6
    shares = language_id.mixtures(logs.astype(np.float32), np.array([0, 500, 550]))
    assert np.allclose(shares[:, 0], [0.8, 0, 0.2], atol=0.02) and shares[1, 0] == 0
    assert np.allclose(shares[:, 1], [0, 1, 0])


def test_grams_equal_a_plain_count():
    lines = ["Ab abc ab", "", "x1y — Éé", "ab"]
    grams = language_id.Grams(lines)
    words = ["ab", "abc", "ab", "x", "y", "éé", "ab"]
    assert grams.bounds.tolist() == [0, 3, 3, 6, 7]
    total = 0
    for word in words:
        padded = f" {word} "
        total += sum(1 for n in language_id.GRAMS for i in range(len(padded) - n + 1)
                     if " " not in padded[i + 1 : i + n - 1] and padded[i : i + n].strip())
    assert int(grams.bucket_counts().sum()) == total
