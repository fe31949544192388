"""Removal of lines that an earlier document already has, over levelled sorted runs.

Documents come in batches of ascending id. What earlier batches held is a set of sorted
runs: tables of line hashes, bucketed and sorted by hash. A batch's distinct lines are
merge-anti-joined with every run, bucket by bucket, without moving a run; lines that no run
has become a run of their own. When a level holds ``FANOUT`` runs, they are compacted into
one run of the next level, so a batch meets a logarithmic number of runs. Only hashes are
kept; texts are read once to hash lines and once to write what is left. Everything is
DataFrame operations.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewise.llm.staging import carried, partitions, stage
from phasewise.session import fresh_path

#: Shortest key that is compared, in code points.
MIN_KEY = 10
BATCHES = 4
FANOUT = 2
_BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lowered."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class SortedRuns:
    """Runs of distinct line hashes (h1, h2) by level, as bucketed and sorted tables."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.buckets = spark, fanout, partitions(spark)
        self.levels: list[list[str]] = []
        self._all: list[str] = []

    def _write(self, hashes: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (hashes.repartition(self.buckets, "h1", "h2").write.format("parquet")
         .bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", fresh_path(self.spark, "line-run")).saveAsTable(name))
        self._all.append(name)
        return name

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, hashes: DataFrame) -> None:
        """Add hashes that no run holds, and compact full levels."""
        carry, level = self._write(hashes), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(carry)
            if len(self.levels[level]) < self.fanout:
                return
            merged = self.spark.table(self.levels[level][0])
            for name in self.levels[level][1:]:
                merged = merged.unionByName(self.spark.table(name))
            carry = self._write(merged)
            self.levels[level] = []
            level += 1

    def close(self) -> None:
        """Forget the tables."""
        for name in self._all:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def row_keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that, with doc_id, tell the rows of a table apart."""
    return F.xxhash64(doc_id, text), F.xxhash64(F.lit("row"), doc_id, text)


def _batched_lines(rows: DataFrame, batches: int) -> DataFrame:
    """batch, h1, h2, doc_id, row, row2, pos of the lines that are compared."""
    cuts = [i / batches for i in range(1, batches)]
    found = rows.select(F.percentile_approx("doc_id", F.lit(cuts)).alias("cuts")).first()
    batch = F.lit(0)
    for cut in (found["cuts"] or []) if cuts else []:
        batch = batch + (F.col("doc_id") > F.lit(cut)).cast("int")
    each = rows.filter("doc_id is not null").select(
        batch.alias("batch"), "doc_id", "row", "row2", F.posexplode("lines").alias("pos", "line"))
    keyed = each.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= MIN_KEY)
    return keyed.select("batch", F.xxhash64("key").alias("h1"),
                        F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", "row", "row2",
                        "pos")


def _dropped(lines: DataFrame, runs: SortedRuns) -> DataFrame:
    """doc_id, row, row2, pos of a batch's lines that go; its new lines become a run."""
    keys = lines.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.lit(False).alias("seen"))
    for run in runs.tables():
        keys = keys.join(run.withColumn("held", F.lit(True)), ["h1", "h2"], "left").select(
            "h1", "h2", "low", "high", (F.col("seen") | F.col("held").isNotNull()).alias("seen"))
    keys = stage(keys, "line-keys")
    runs.add(keys.filter("not seen").select("h1", "h2"))
    repeated = keys.filter("seen or high > low").select("h1", "h2", "low", "seen")
    return lines.join(repeated, ["h1", "h2"]).filter("seen or doc_id > low").select(
        "doc_id", "row", "row2", "pos")


def dedup_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT,
                carry: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its lines without those of smaller documents.

    Columns: doc_id, n_lines, n_dropped, kept (lines left, joined by newlines). Keys are
    lines without blanks at the ends, A-Z lowered; of a key of at least ``MIN_KEY`` code
    points found in several documents, only the smallest doc_id keeps its lines, all of them.
    A null or empty text is one empty line. A row without doc_id takes no part and stays
    whole; rows that repeat a doc_id count as one document. With ``carry``, a struct
    ``carried`` holds all columns of the row; else other columns are not read.
    ``doc_id`` must be numeric. Line keys are hashed to 128 bits; a row is known by its
    doc_id and 128 bits of its text, so places go back to their own document.
    """
    spark = docs.sparkSession
    row, row2 = row_keys(F.col("doc_id"), F.col("text"))
    rows = docs.select("doc_id", row.alias("row"), row2.alias("row2"),
                       _lines(F.col("text")).alias("lines"),
                       *([carried(docs)] if carry else []))
    path = fresh_path(spark, "lines")
    lines = _batched_lines(rows, batches)
    lines.write.partitionBy("batch").parquet(path)
    stored = spark.read.schema(lines.schema).parquet(path)
    runs = SortedRuns(spark, fanout)
    dropped = None
    try:
        for batch in range(batches):
            own = _dropped(stored.filter(F.col("batch") == batch).drop("batch"), runs)
            dropped = own if dropped is None else dropped.unionByName(own)
    finally:
        runs.close()
    # Rows equal in id and text would list a place twice.
    places = dropped.groupBy("doc_id", "row", "row2").agg(F.collect_set("pos").alias("places"))
    joined = rows.join(places, ["doc_id", "row", "row2"], "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places"))
    kept = F.when(F.col("places").isNull(), F.array_join("lines", "\n")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return joined.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept"), *(["carried"] if carry else []))
