"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document gets base measures from its words (maximal runs outside ``[\\x20\\x09-\\x0D]``):

- ``word_chars``: code points in words; ``n_symbols``: characters of ``[#*$%&|<>]``;
- ``n_dup_lines``: ``\\n``-split lines holding a word that equal an earlier line;
- ``n_repeat_words``: words covered by a 5-word window that occurs twice or more in the text,
  the first occurrence included.

Two fixed base rules stay: fewer than ``MIN_WORDS`` words, or more than ``MAX_REPEAT`` percent
of words in repeated windows, fail. Everything else is judged against thresholds of the
document's own group (lang, source; nulls a group of their own): per group, a quantile sketch
of each ratio is built over the documents that pass the base rules. The sketches are Spark's
``percentile_approx``: partial sketches per partition, merged after the exchange, so a group
with a third of all rows is summarised on the map side and never gathered. From a group's
quartiles and outer quantiles come Tukey's far-out fences, widened to the outer quantiles;
a document outside a fence of its group is not kept. The thresholds, one row per group, are
joined back to the documents.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StructField, StructType

from phasewise.llm.staging import stage

# Fixed values of the quality contract: word and symbol classes, window, base limits.
_WORDS = re.compile(r"[^\x20\x09-\x0d]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT = 20  # percent of words

#: Quantiles kept per group and ratio, and the fence width in interquartile ranges.
QUANTILES = (0.01, 0.25, 0.75, 0.99)
FENCE = 3.0
ACCURACY = 10000

#: Ratios judged against their group: (name, expression, tails judged).
RATIOS = (
    ("symbol_ratio", "n_symbols / word_chars", "upper"),
    ("mean_word", "word_chars / n_words", "both"),
    ("dup_line_ratio", "n_dup_lines / n_words", "upper"),
    ("repeat_ratio", "n_repeat_words / n_words", "upper"),
)

_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """Base measures of one text; null has none of anything."""
    if not text:
        return 0, 0, 0, 0, 0
    words = _WORDS.findall(text)
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if _WORDS.search(line):
            dup_lines += line in seen
            seen.add(line)
    covered = bytearray(len(words))
    if len(words) >= WINDOW:
        windows = [tuple(words[i:i + WINDOW]) for i in range(len(words) - WINDOW + 1)]
        counts = Counter(windows)
        for i, window in enumerate(windows):
            if counts[window] > 1:
                covered[i:i + WINDOW] = b"\x01" * WINDOW
    return (len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), dup_lines,
            sum(covered))


@pandas_udf(StructType([StructField(name, LongType()) for name in _BASE]))
def _measured(texts: pd.Series) -> pd.DataFrame:
    rows = [measures(None if t is None or t is pd.NA else t) for t in texts]
    return pd.DataFrame(rows, columns=list(_BASE), dtype="int64")


def base_measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang and source as ``_lang`` and ``_source``, the five base measures (long) and
    ``base_failed``."""
    m = _measured(F.col("text")).alias("m")
    found = docs.select(F.col("doc_id"), F.col("lang").alias("_lang"),
                        F.col("source").alias("_source"), m)
    found = found.select("doc_id", "_lang", "_source", "m.*")
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)
    return found.withColumn("base_failed", failed)


def _ratio(expression: str) -> Column:
    """``a / b`` of two columns as a double; null when b is 0."""
    top, bottom = (F.col(part.strip()).cast("double") for part in expression.split("/"))
    return F.try_divide(top, bottom)


def thresholds(measured: DataFrame) -> DataFrame:
    """One row per (lang, source) with fences ``<ratio>_low`` and ``<ratio>_high``.

    Quantiles come from sketches over the documents of the group that pass the base rules.
    Upper fence: the larger of q99 and q75 + FENCE * (q75 - q25); lower fence: the smaller of
    q01 and q25 - FENCE * (q75 - q25).
    """
    passing = measured.filter(~F.col("base_failed"))
    sketches = passing.groupBy("_lang", "_source").agg(*[
        F.percentile_approx(_ratio(expression), list(QUANTILES), ACCURACY).alias(name)
        for name, expression, _ in RATIOS])
    fences = []
    for name, _, tails in RATIOS:
        q01, q25, q75, q99 = (F.col(name)[i] for i in range(4))
        spread = (q75 - q25) * FENCE
        fences.append(F.greatest(q99, q75 + spread).alias(f"{name}_high"))
        low = F.least(q01, q25 - spread) if tails == "both" else F.lit(None).cast("double")
        fences.append(low.alias(f"{name}_low"))
    return sketches.select(F.col("_lang").alias("_flang"), F.col("_source").alias("_fsource"),
                           *fences)


def judge(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the base measures, ``base_failed`` and ``kept``.

    ``kept`` is false for base-failed documents, else true when every ratio lies within its
    group's fences (a ratio over zero words or characters is null and passes). Reads doc_id,
    text, lang and source; other columns, however named, are not read. Null texts have no
    words and fail the base rules; empty tables give no rows; repeated rows are judged each,
    and all take part in the sketches. Texts of any length are measured whole.
    """
    # Staged: the texts are measured once, for the sketches and for the verdicts.
    measured = stage(base_measures(docs), "quality-measures")
    fences = thresholds(measured)
    joined = measured.join(
        fences, F.col("_lang").eqNullSafe(F.col("_flang"))
        & F.col("_source").eqNullSafe(F.col("_fsource")), "left")
    inside = F.lit(True)
    for name, expression, _ in RATIOS:
        value = _ratio(expression)
        inside = inside & F.coalesce(value <= F.col(f"{name}_high"), F.lit(True)) & F.coalesce(
            value >= F.col(f"{name}_low"), F.lit(True))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"))
