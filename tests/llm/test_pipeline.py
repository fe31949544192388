"""The pipeline's stages against brute force, and the queries against SQL."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from phasewise.llm.oracles import llm_oracles
from phasewise.llm.queries import llm_queries
from tests.llm.hard_rows import documents, texts
from tests.llm.test_texts import components, contamination, lines_left
from tests.oracle_compare import connect, difference, oracle_result, spark_result

STAGES = dict(corpus_pipeline.STAGES)


def outcome(spark, name, docs, sf_dir):
    found = STAGES[name](spark, docs, sf_dir)
    assert found.columns == docs.columns and found.dtypes == docs.dtypes
    return found.collect()


def test_language_stage(spark, sf_dir):
    rows = outcome(spark, "language_id", documents(spark), sf_dir)
    expected = Counter(r for r in texts() if any(map(str.isalpha, r[1] or "")))
    assert Counter((r["doc_id"], r["text"]) for r in rows) == expected


def test_line_stage(spark, sf_dir):
    rows = outcome(spark, "line_dedup", documents(spark), sf_dir)
    expected = Counter({(k[0], k[3]): 0 for k in lines_left(texts())})
    for key, n in lines_left(texts()).items():
        expected[key[0], key[3]] += n
    assert Counter((r["doc_id"], r["text"]) for r in rows) == expected
    assert all(r["n_chars"] == len(r["text"]) and r["key"] == "k" for r in rows)


def test_jaccard_stage(spark, sf_dir):
    rows = [r for r in texts() if r != (40, "an other text under a used id")]
    kept = outcome(spark, "ngram_jaccard", documents(spark, rows), sf_dir)
    stay = {k[0] for k in components(rows, 4, 85, 100) if k[0] == k[2]}
    expected = Counter(r for r in rows if r[0] is None or r[0] in stay)
    assert Counter((r["doc_id"], r["text"]) for r in kept) == expected


def test_contamination_stage(spark, sf_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = texts() + [(900, "before " + items[3][1] + " after"), (None, items[4][1])]
    kept = outcome(spark, "decontaminate", documents(spark, rows), sf_dir)
    judge = contamination(items, 10)
    expected = Counter(r for r in rows if not judge(r[1])[1])
    assert Counter((r["doc_id"], r["text"]) for r in kept) == expected
    assert sum(expected.values()) == len(rows) - 2


def test_whole_pipeline(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert 0.5 * docs < len(found) <= docs
    assert len({r["doc_id"] for r in found}) == len(found)
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in found)


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query_matches_sql(spark, sf_dir, name):
    ours = spark_result(llm_queries()[name](spark, sf_dir))
    assert difference(ours, oracle_result(connect(sf_dir), llm_oracles()[name])) is None


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in llm_queries()) == list(range(1, 14))
