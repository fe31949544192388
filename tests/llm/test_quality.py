"""Quality rules: base measures against plain counting, verdicts against the group fences."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from phasewise.llm import quality
from tests.llm import hard_rows


def plain(text):
    if text is None:
        return 0, 0, 0, 0, 0
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = (words + [word] if word else words), ""
        else:
            word += c
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    covered = set()
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            covered.update(range(i, i + 5))
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, dup, len(covered)


def test_measures_equal_plain_counting():
    draw = random.Random(2)
    texts = [t for _, t in hard_rows.texts()] + ["a b c d e a b c d e x", "x\n  x\nx \nx\n\n"]
    texts += [" ".join(draw.choice("ab#c") for _ in range(draw.randint(0, 40)))
              for _ in range(30)]
    for text in texts:
        assert quality.measures(text) == plain(text), text


def test_verdicts_follow_group_fences(spark):
    draw = random.Random(7)
    rows = [(i, t) for i, t in hard_rows.texts()]
    vocabulary = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows += [(1000 + i, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(12, 60))))
             for i in range(300)]
    rows += [(2000, "$$$ ### <<< >>> %%% &&& " * 3 + " ".join(vocabulary)),
             (2001, " ".join(w * 9 for w in vocabulary))]
    docs = hard_rows.documents(spark, rows)
    found = quality.judge(docs).collect()
    assert len(found) == docs.count()
    fences = {(r["_flang"], r["_fsource"]): r for r in
              quality.thresholds(quality.base_measures(docs)).collect()}
    langs = {(r["doc_id"], r["text"]): (r["lang"], r["source"]) for r in docs.collect()}
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append(r)
    for (doc_id, text), group in langs.items():
        base = plain(text)
        match = [r for r in by_id[doc_id] if (r["n_words"], r["word_chars"], r["n_symbols"],
                                               r["n_dup_lines"], r["n_repeat_words"]) == base]
        assert match, doc_id
        r = match[0]
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        assert r["base_failed"] == failed
        fence = fences.get(group)
        inside = True
        if not failed and fence is not None:
            n_words, chars, symbols, dup, repeat = base
            values = {"symbol_ratio": symbols / chars, "mean_word": chars / n_words,
                      "dup_line_ratio": dup / n_words, "repeat_ratio": repeat / n_words}
            for name, value in values.items():
                high, low = fence[f"{name}_high"], fence[f"{name}_low"]
                inside &= (high is None or value <= high) and (low is None or value >= low)
        assert r["kept"] == (not failed and inside), doc_id
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert not kept[2000] and not kept[2001]
    assert sum(kept[1000 + i] for i in range(300)) >= 290


def test_empty_and_clashing_names(spark):
    docs = hard_rows.documents(spark, [])
    assert quality.judge(docs).count() == 0
    docs = hard_rows.documents(spark, [(1, None), (2, "")]).withColumn("kept", F.lit(1))
    assert {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()} == {1: False, 2: False}
