"""Model scores as plain aggregates over a table of predictions.

A prediction row has ``label``, ``prediction`` and, for confidences, ``probability``: one
value per class in an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasewise.constants import PROBABILITY_FLOOR

SCORES = ["precision", "recall", "f1"]


def accuracy() -> Column:
    return F.count_if(F.col("label") == F.col("prediction")) / F.count(F.lit(1))


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def precision_recall_f1(label: Column, prediction: Column, positive=1) -> list[Column]:
    """Precision, recall and F1 of one class; zero where undefined."""
    hits = F.count_if((label == positive) & (prediction == positive))
    predicted = F.count_if(prediction == positive)
    actual = F.count_if(label == positive)
    return [
        ratio_or_zero(hits, predicted),
        ratio_or_zero(hits, actual),
        ratio_or_zero(2 * hits, predicted + actual),
    ]


def _clipped(probability: Column) -> Column:
    low = F.lit(PROBABILITY_FLOOR)
    return F.greatest(F.least(probability, F.lit(1.0) - low), low)


def confidence_of(probability: Column) -> Column:
    """exp(-log loss), given the probability of the true class."""
    return F.exp(F.avg(F.ln(_clipped(probability))))


def true_class_probability() -> Column:
    return F.get(F.col("probability"), F.col("label").cast("int"))


def confidence() -> Column:
    return confidence_of(true_class_probability())


def rmse() -> Column:
    return F.sqrt(F.avg(F.pow(F.col("label") - F.col("prediction"), F.lit(2.0))))


def naive_label(train: DataFrame) -> Column:
    """The rounded mean training label, halves to the even number."""
    return train.agg(F.bround(F.avg("label"))).scalar()


def naive_accuracy(train: DataFrame, test: DataFrame) -> DataFrame:
    """How often the rounded mean training label is right."""
    return test.withColumn("prediction", naive_label(train)).agg(
        accuracy().alias("naive_accuracy")
    )


def naive_confidence(train: DataFrame, test: DataFrame) -> DataFrame:
    """Confidence of predicting the mean training label as probability of class 1."""
    mean = train.agg(F.avg("label")).scalar()
    chance = F.when(F.col("label") == 1, mean).otherwise(1 - mean)
    return test.select(chance.alias("chance")).agg(
        confidence_of(F.col("chance")).alias("naive_confidence")
    )


def class_shares(train: DataFrame, classes: int = 3) -> DataFrame:
    """Share of each class in the training labels, classes without rows included."""
    shares = [
        F.struct(
            F.lit(k).alias("label"),
            (F.count_if(F.col("label") == k) / F.count(F.lit(1))).alias("share"),
        )
        for k in range(classes)
    ]
    return train.agg(F.array(*shares).alias("shares")).select(F.inline("shares"))


def naive_class_confidence(train: DataFrame, test: DataFrame, classes: int = 3) -> DataFrame:
    """Confidence of predicting the training class shares for every row."""
    shares = train.agg(
        F.array(
            *[F.count_if(F.col("label") == k) / F.count(F.lit(1)) for k in range(classes)]
        )
    ).scalar()
    return test.withColumn("probability", shares).agg(confidence().alias("naive_confidence"))


def _class_parts(labels) -> list[Column]:
    """Rows, precision, recall and F1 of every class, to be aggregated together."""
    label, prediction = F.col("label"), F.col("prediction")
    parts = []
    for k in labels:
        parts.append(F.count_if(label == k).alias(f"rows_{k}"))
        scores = precision_recall_f1(label, prediction, k)
        parts += [score.alias(f"{name}_{k}") for name, score in zip(SCORES, scores)]
    return parts


def _weighted(name: str, labels) -> Column:
    rows = sum((F.col(f"rows_{k}") for k in labels), F.lit(0))
    total = sum((F.col(f"rows_{k}") * F.col(f"{name}_{k}") for k in labels), F.lit(0.0))
    return ratio_or_zero(total, rows)


def weighted_precision_recall_f1(predictions: DataFrame, labels=(0, 1, 2)) -> DataFrame:
    """Precision, recall and F1 averaged over the labels, weighted by their rows."""
    return predictions.agg(*_class_parts(labels)).select(
        *[_weighted(name, labels).alias(f"weighted_{name}") for name in SCORES]
    )


def binary_scores(predictions: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and confidence of a two-class model; one row."""
    precision, recall, f1 = precision_recall_f1(F.col("label"), F.col("prediction"))
    return predictions.agg(
        accuracy().alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        confidence().alias("confidence"),
    )


def multiclass_scores(predictions: DataFrame, labels=(0, 1, 2)) -> DataFrame:
    """Accuracy, weighted precision, recall and F1, and confidence; one row."""
    parts = predictions.agg(
        accuracy().alias("accuracy"), confidence().alias("confidence"), *_class_parts(labels)
    )
    return parts.select(
        "accuracy", *[_weighted(name, labels).alias(name) for name in SCORES], "confidence"
    )
