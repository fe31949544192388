"""Readers for the two source tables and for stored feature tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasewise.sources.schemas import CSV_OPTIONS, DRUGS, TRIALS, snake_case


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types, by name; missing ones are null.

    Source headers and snake-case names are both understood. Only a projection, so the
    scan still reads just the columns that a query uses.
    """
    found = {snake_case(name): name for name in df.columns}
    columns = []
    for field in schema.fields:
        if field.name not in found:
            column = F.lit(None)
        elif isinstance(field.dataType, T.StringType):
            column = df[f"`{found[field.name]}`"]
        else:
            column = df[f"`{found[field.name]}`"].try_cast(field.dataType)
        columns.append(column.cast(field.dataType).alias(field.name))
    return df.select(columns)


def _read(spark: SparkSession, path: str, source: str, schema: T.StructType,
          options: dict) -> DataFrame:
    # CSV is all text, named by the header line: no pass over the data to infer types.
    defaults = CSV_OPTIONS if source == "csv" else {}
    raw = spark.read.format(source).options(**{**defaults, **options}).load(path)
    return conform(raw, schema)


#: Column that holds CSV lines that do not split into the header's fields.
CORRUPT = "_corrupt_record"
_REJECTS = "file string, record string, column string, value string, reason string"


def _rejected_cells(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Cells of typed columns that hold text but do not read as their type."""
    found = {snake_case(name): name for name in raw.columns}
    parts = []
    for field in schema.fields:
        if field.name not in found or isinstance(field.dataType, T.StringType):
            continue
        value = raw[f"`{found[field.name]}`"].cast("string")
        bad = value.isNotNull() & (F.trim(value) != "") & value.try_cast(field.dataType).isNull()
        parts.append(raw.filter(bad).select(
            F.col("_file").alias("file"), F.lit(None).cast("string").alias("record"),
            F.lit(field.name).alias("column"), value.alias("value"),
            F.lit(f"not a {field.dataType.simpleString()}").alias("reason")))
    empty = raw.sparkSession.createDataFrame([], _REJECTS)
    return reduce(DataFrame.unionByName, parts, empty)


def read_with_rejects(spark: SparkSession, path: str, source: str, schema: T.StructType,
                      **options) -> tuple[DataFrame, DataFrame]:
    """The table as ``read_trials`` or ``read_drugs`` give it, and what could not be read.

    Rejects have the columns file, record, column, value and reason. A CSV line that does not
    split into the header's fields is rejected whole (``malformed line``, the line in
    ``record``) and is not in the table. A cell of a typed column that holds text but does not
    read as its type (``1,200 subjects`` as a number) is rejected with its column and value;
    in the table it is null, as ``conform`` makes it. Both come from one scan of the source.
    """
    defaults = CSV_OPTIONS if source == "csv" else {}
    reader = spark.read.format(source).options(**{**defaults, **options})
    if source == "csv":
        header = reader.load(path).columns
        fields = [T.StructField(name, T.StringType()) for name in header]
        reader = reader.schema(T.StructType([*fields, T.StructField(CORRUPT, T.StringType())]))
        reader = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    raw = reader.load(path)
    raw = raw.withColumn("_file", F.col("_metadata.file_path"))
    if CORRUPT not in raw.columns:
        raw = raw.withColumn(CORRUPT, F.lit(None).cast("string"))
    # A CSV line is judged whole only if all its columns are read: with fewer, Spark neither
    # counts its fields nor scans for the bad column alone.
    record = F.concat_ws("", F.col(CORRUPT), *[F.substring(F.col(f"`{c}`"), 1, 0)
                                               for c in raw.columns if c not in (CORRUPT, "_file")])
    broken = raw.filter(F.col(CORRUPT).isNotNull()).select(
        F.col("_file").alias("file"), record.alias("record"),
        F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("value"),
        F.lit("malformed line").alias("reason"))
    good = raw.filter(F.col(CORRUPT).isNull())
    rejects = broken.unionByName(_rejected_cells(good, schema))
    return conform(good.drop(CORRUPT, "_file"), schema), rejects


def read_trials(spark: SparkSession, path: str, source: str = "parquet", **options) -> DataFrame:
    """The trials; options go to the source, such as ``multiLine`` for cells with line breaks."""
    return _read(spark, path, source, TRIALS, options)


def read_drugs(spark: SparkSession, path: str, source: str = "parquet", **options) -> DataFrame:
    return _read(spark, path, source, DRUGS, options)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The wide feature table as written to CSV, numbers and flags typed again."""
    raw = spark.read.options(**CSV_OPTIONS).csv(path)

    def typed(name: str):
        column = F.col(f"`{name}`")
        if name == "drug":
            return column
        target = "boolean" if name.endswith(" Pass") else "double"
        return column.cast(target).alias(name)

    return raw.select([typed(name) for name in raw.columns])


def read_phase_table(spark: SparkSession, path: str, phase: str) -> DataFrame:
    """One phase of the stored phase tables; other phases' folders are not listed."""
    stored = spark.read.parquet(path).filter(F.col("phase") == phase).drop("phase")
    shared = {"drug", "Number of Organizations"}
    return stored.select(
        [F.col(f"`{c}`").alias(c if c in shared else f"{phase} {c}") for c in stored.columns]
    )
