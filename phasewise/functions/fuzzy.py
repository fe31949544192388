"""Fuzzy string comparison inside the JVM, built on the longest common subsequence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from phasewise.constants import FUZZY_THRESHOLD
from phasewise.functions.text import strip


def _locate(needle: Column, text: Column, start: Column) -> Column:
    """Position of ``needle`` at or after ``start``, null when there is none."""
    return F.nullif(F.call_function("locate", needle, text, start), F.lit(0))


def common_subsequence_length(left: Column, right: Column) -> Column:
    """Length of the longest common subsequence of two non-empty strings.

    The state holds, for each length k, the earliest position in ``right`` at which a
    common subsequence of length k can end. Each letter of ``left`` moves every position
    forward at once, so a letter costs one native ``locate`` per state entry.
    """
    def advance(ends: Column, letter: Column) -> Column:
        moved = F.transform(
            ends,
            lambda end, k: F.when(k == 0, end).otherwise(
                F.least(end, _locate(letter, right, F.get(ends, k - 1) + 1))
            ),
        )
        longer = _locate(letter, right, F.element_at(ends, -1) + 1)
        return F.concat(moved, F.filter(F.array(longer), lambda end: end.isNotNull()))

    return F.array_size(F.aggregate(F.split(left, ""), F.array(F.lit(0)), advance)) - 1


def ratio(left: Column, right: Column) -> Column:
    """Similarity 0..100: twice the common subsequence over both lengths, half-even."""
    total = F.length(left) + F.length(right)
    share = F.lit(200) * common_subsequence_length(left, right) / total
    return (
        F.when(left == right, F.lit(100))
        .when((left == "") | (right == ""), F.lit(0))
        .otherwise(F.bround(share).cast("int"))
    )


def _known_letters(text: Column, other: Column) -> Column:
    """How many letters of a string, repeats included, occur in the other one."""
    return F.length(text) - F.length(F.call_function("translate", text, other, F.lit("")))


def is_similar(left: Column, right: Column, threshold: int = FUZZY_THRESHOLD) -> Column:
    """Whether ``ratio`` exceeds the threshold, cheapest tests first.

    With edit distance d, d insertions and deletions are needed at least and 2d at most,
    no common subsequence is longer than the shorter string, and it only has letters that
    occur in both; only pairs that these bounds leave open are compared letter by letter.
    """
    # A ratio rounds to more than t from t + 0.5 on; the tie goes to the even number.
    floor_share = F.lit((threshold + 0.5) / 100.0)

    def beats(share: Column) -> Column:
        return share >= floor_share if threshold % 2 else share > floor_share

    total = F.length(left) + F.length(right)
    at_best = F.least(F.length(left), F.length(right)) * F.lit(2.0) / total
    distance = F.levenshtein(left, right)
    shared = F.least(_known_letters(left, right), _known_letters(right, left))
    sure_share = F.lit(1.0) - distance * F.lit(2.0) / total
    best_share = F.lit(1.0) - distance / total
    exact_share = common_subsequence_length(left, right) * F.lit(2.0) / total
    return (
        F.when(left == right, F.lit(100 > threshold))
        .when((left == "") | (right == ""), F.lit(0 > threshold))
        .when(~beats(at_best), F.lit(False))
        .when(sure_share > floor_share + F.lit(1e-9), F.lit(True))
        .when(best_share < floor_share - F.lit(1e-9), F.lit(False))
        .when(~beats(shared * F.lit(2.0) / total), F.lit(False))
        .otherwise(beats(exact_share))
    )


def distinct_organisations(cell: Column, threshold: int = FUZZY_THRESHOLD) -> Column:
    """Comma list to array without organisations that resemble an earlier one.

    Every name is compared, unstripped, with all names before it, also with those that
    were dropped. A null cell gives an empty array.
    """
    names = F.split(cell, ",")
    kept = F.filter(
        names,
        lambda name, k: ~F.exists(
            F.slice(names, 1, k), lambda earlier: is_similar(earlier, name, threshold)
        ),
    )
    return F.when(cell.isNull(), F.array().cast("array<string>")).otherwise(
        F.transform(kept, strip)
    )
