"""Ranked lexical search: ball-tree results against scoring every document."""

from __future__ import annotations

import math
import random
import re

import numpy as np

from phasewise.llm import lexical_search
from tests.llm import hard_rows

TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_force(docs, items, top=10):
    lowered = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    rows = [(i, d, TERM.findall(lowered(t))) for i, (d, t) in enumerate(docs)]
    rows = [r for r in rows if r[2]]
    big_n, big_l = len(rows), sum(len(r[2]) for r in rows)
    df = {}
    for _, _, ts in rows:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall(lowered(text)))
    out = []
    for item, ts in asked.items():
        scored = []
        for rid, doc_id, words in rows:
            m = 10 + (90 * len(words) * big_n) // big_l
            score = 0
            for t in ts:
                tf = words.count(t)
                if tf:
                    w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, rid, doc_id, score))
        for rank, s in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, s[4], s[5]))
    return sorted(out, key=str)


def run(spark, docs, items, top=10):
    frame = hard_rows.documents(spark, docs)
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = lexical_search.rank(frame, asked, top)
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()),
                  key=str)


def corpus():
    draw = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "the", "AND", "Ärger", "x1"]
    docs = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(1, 80)))) for i in range(600)]
    docs += [(700, docs[5][1]), (701, docs[5][1]), (None, docs[5][1]), (702, None), (703, "")]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(1, 6)))) for i in range(12)]
    items += [(100, docs[5][1]), (101, None), (102, "..."), (3, "w7 w8"), (None, "the w1")]
    return docs, items


def test_equals_scoring_everything(spark):
    docs, items = corpus()
    assert run(spark, docs, items) == brute_force(docs, items)


def test_many_blocks_and_hard_rows(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 50)
    assert run(spark, docs, items, top=3) == brute_force(docs, items, top=3)
    rows = hard_rows.texts()
    asked = [(1, "same same an"), (2, rows[30][1][:200]), (3, "ärger über")]
    assert run(spark, rows, asked) == brute_force(rows, asked)


def test_tree_bounds_hold():
    draw = np.random.default_rng(3)
    indptr = np.concatenate([[0], np.cumsum(draw.integers(1, 6, 300))])
    indices = draw.integers(0, 40, indptr[-1])
    values = draw.integers(1, 10**6, indptr[-1])
    tree = lexical_search._Tree(indptr, indices, values, 40)
    q = draw.integers(0, 30000, 40)
    exact = tree.scores(np.arange(300), q)
    bounds = tree.centroids @ q + math.sqrt(q @ q) * tree.radii
    for node, rows in enumerate(tree.members):
        assert exact[rows].max() <= bounds[node] * (1 + 1e-9) + 1


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a b")], []) == []
