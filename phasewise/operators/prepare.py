"""From a phase table to labelled, split, weighted and scaled model input."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phasewise.constants import (
    FOLDS,
    LEAKY_FOR_PASS,
    LEAKY_FOR_TIME,
    PASS,
    SPLIT_SEED,
    TEST_SHARE,
    TRIAL_LENGTH,
)
from phasewise.functions.measures import hash_bucket, seeded_hash, time_bin
from phasewise.operators.features import quoted

# Leading hash bits that spread rows over buckets when cutting a hash order.
BUCKET_BITS = 16


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    return [name for name in df.columns if re.search(pattern, name)]


def only_column(df: DataFrame, pattern: str) -> str:
    """The one column that matches; none or several is an error."""
    names = columns_like(df, pattern)
    if len(names) != 1:
        raise ValueError(f"expected one column matching {pattern!r}, found {names}")
    return names[0]


def drop_leaky(table: DataFrame, pattern: str) -> DataFrame:
    return table.drop(*columns_like(table, pattern))


def adjust_length(table: DataFrame, binned: bool = False) -> DataFrame:
    """Fill unknown values with zero if the table has one length column; bin it on demand."""
    lengths = columns_like(table, TRIAL_LENGTH)
    if len(lengths) != 1:
        return table
    if binned:
        label = time_bin(quoted(lengths[0])).cast("double")
        table = table.withColumn(lengths[0], label)
    return table.na.fill(0.0)


def _matrix(table: DataFrame, label: str, dropped: list[str]) -> DataFrame:
    names = [c for c in table.columns if c not in {"drug", label, *dropped}]
    return table.select(
        "drug",
        *[quoted(name).cast("double").alias(name) for name in names],
        quoted(label).cast("double").alias("label"),
    )


def pass_matrix(table: DataFrame) -> DataFrame:
    """Numeric features of a phase with the pass flag as label."""
    table = adjust_length(drop_leaky(table, LEAKY_FOR_PASS))
    return _matrix(table, only_column(table, PASS), [])


def time_matrix(table: DataFrame) -> DataFrame:
    """Numeric features of a phase with the length class as label."""
    label = only_column(table, TRIAL_LENGTH)
    table = drop_leaky(adjust_length(table, binned=True), LEAKY_FOR_TIME)
    return _matrix(table, label, [])


def length_matrix(table: DataFrame, without_leaky: bool = False) -> DataFrame:
    """Numeric features of a phase with the length in days as label."""
    if without_leaky:
        table = drop_leaky(table, LEAKY_FOR_PASS)
    table = adjust_length(table)
    label = only_column(table, TRIAL_LENGTH)
    return _matrix(table, label, columns_like(table, PASS)[:1])


def feature_names(matrix: DataFrame) -> list[str]:
    return [c for c in matrix.columns if c not in {"drug", "label", "split", "fold", "weight"}]


def _hash_cuts(rows: DataFrame, ranks_of: Callable[[Column], Column]) -> DataFrame:
    """The digests at wanted ranks of each group's hash order, without sorting any group.

    ``rows`` has grp and digest; ``ranks_of`` turns a group's size into an array of ranks.
    Digests are counted by leading bits first, which bounds the counts by groups times
    buckets; only the buckets that hold a wanted rank are then ranked row by row.
    """
    rows = rows.withColumn("bucket", hash_bucket(F.col("digest"), BUCKET_BITS))
    counts = rows.groupBy("grp", "bucket").agg(F.count(F.lit(1)).alias("n"))
    group = W.partitionBy("grp")
    upto = F.sum("n").over(group.orderBy("bucket"))
    counts = counts.select(
        "grp", "bucket", (upto - F.col("n")).alias("before"), upto.alias("upto"),
        ranks_of(F.sum("n").over(group)).alias("ranks"),
    )
    inside = F.filter("ranks", lambda r: (r > F.col("before")) & (r <= F.col("upto")))
    buckets = counts.withColumn("ranks", inside).filter(F.array_size("ranks") > 0)
    rank = F.col("before") + F.row_number().over(W.partitionBy("grp", "bucket").orderBy("digest"))
    ranked = rows.join(buckets, ["grp", "bucket"]).withColumn("rank", rank)
    return ranked.filter(F.array_contains("ranks", F.col("rank"))).select("grp", "digest")


def with_split(matrix: DataFrame, test_share: float = TEST_SHARE, seed: int = SPLIT_SEED,
               exact: bool = True) -> DataFrame:
    """Add ``split``: test for ceil(share * n) rows in seeded hash order, else train.

    The cut is found on the keys alone and compared in place, so the table itself is
    neither sorted nor shuffled. Not exact means a hash threshold: about the share, and no
    pass over the keys.
    """
    digest = seeded_hash(F.col("drug"), seed)
    if exact:
        rows = matrix.select(F.lit(0).alias("grp"), digest.alias("digest"))
        share = F.lit(float(test_share))
        cuts = _hash_cuts(rows, lambda n: F.array(F.ceil(share * n).cast("bigint")))
        cut = cuts.agg(F.max("digest")).scalar()
        is_test = digest <= cut
    else:
        is_test = hash_bucket(digest, 32) < int(test_share * 2**32)
    return matrix.withColumn("split", F.when(is_test, "test").otherwise("train"))


def with_folds(matrix: DataFrame, folds: int = FOLDS, stratified: bool = True,
               seed: int = SPLIT_SEED) -> DataFrame:
    """Add ``fold``, 0-based: consecutive blocks of the hash order, per label if stratified.

    The first blocks take one row more when the rows do not divide evenly.
    """
    digest = seeded_hash(F.col("drug"), seed)
    group = F.col("label").cast("string") if stratified else F.lit("all")
    rows = matrix.select(group.alias("grp"), digest.alias("digest"))

    def ends(n: Column) -> Column:
        """Fold i ends at rank i * (n div k) + min(i, n mod k); the last needs no end."""
        size, longer = F.floor(n / folds).cast("bigint"), n % folds
        return F.array(
            *[size * i + F.least(F.lit(i).cast("bigint"), longer) for i in range(1, folds)]
        )

    cuts = _hash_cuts(rows, ends).groupBy("grp").agg(F.collect_list("digest").alias("cuts"))
    by_group = cuts.agg(F.map_from_entries(F.collect_list(F.struct("grp", "cuts")))).scalar()
    own = F.try_element_at(by_group, group)
    fold = F.lit(0)
    for position in range(folds - 1):
        fold = fold + F.coalesce(F.get(own, position) < digest, F.lit(False)).cast("int")
    return matrix.withColumn("fold", fold)


def label_counts(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def class_weights(matrix: DataFrame) -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    counts = label_counts(matrix)
    totals = counts.agg(F.struct(F.sum("n").alias("n"), F.count("n").alias("k"))).scalar()
    weight = totals.getField("n") / (totals.getField("k") * F.col("n"))
    return counts.withColumn("weight", weight)


def with_class_weights(matrix: DataFrame) -> DataFrame:
    """Add the balanced weight of each row's label.

    There are as many weights as classes; they travel as one map value, so rows of a
    frequent class are not shuffled together.
    """
    weights = class_weights(matrix).agg(
        F.map_from_entries(F.collect_list(F.struct("label", "weight")))
    ).scalar()
    return matrix.withColumn("weight", F.element_at(weights, F.col("label")))


def scaled(matrix: DataFrame, fitted_on: DataFrame | None = None) -> DataFrame:
    """Features centred and divided by their population standard deviation.

    Mean and deviation come from ``fitted_on``; a constant feature is only centred.
    """
    names = feature_names(matrix)
    source = matrix if fitted_on is None else fitted_on
    moments = source.agg(
        F.struct(
            *[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(names)],
            *[F.stddev_pop(quoted(c)).alias(f"s{i}") for i, c in enumerate(names)],
        )
    ).scalar()

    def scale(i: int, name: str) -> Column:
        spread = moments.getField(f"s{i}")
        centred = quoted(name) - moments.getField(f"m{i}")
        return F.when(spread > 0, centred / spread).otherwise(centred)

    return matrix.withColumns({name: scale(i, name) for i, name in enumerate(names)})
