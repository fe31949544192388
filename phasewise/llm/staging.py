"""Tables staged as Parquet in the folder that the whole cluster shares.

A staged table cuts the lineage: a lost executor costs no recomputation of what came
before, and later readers get column pruning and size statistics.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import phasewise
from phasewise.session import materialise


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back with the same columns."""
    return materialise(df, name)


#: Makes Spark delete the shuffle files of an execution at its end; versions that don't know it
#: delete them when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_freed(df: DataFrame, name: str) -> DataFrame:
    """Stage a table, and delete what was shuffled for it.

    For operators of many steps: else the shuffled rows of all steps lie on disk together.
    """
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, None)
    conf.set(FREE_SHUFFLES, "true")
    try:
        return stage(df, name)
    finally:
        if before is None:
            conf.unset(FREE_SHUFFLES)
        else:
            conf.set(FREE_SHUFFLES, before)


def carried(df: DataFrame) -> Column:
    """All columns of a table as one column ``carried``, to go through an operator."""
    return F.struct(*[df[name] for name in df.columns]).alias("carried")


def with_carried(schema: str, df: DataFrame, carry: bool) -> StructType:
    """The schema, followed by ``carried`` if asked for."""
    out = StructType.fromDDL(schema)
    return out.add("carried", StructType(df.schema.fields)) if carry else out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that a Python worker gets at a time.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Make a session fit for operators that run in Python workers.

    Batches are bounded by bytes, as texts may be long: a worker's memory follows from that.
    This package's modules go to the executors, once per application, as functions are found
    there by module name.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if any("phasewise-modules" in file for file in context.listFiles):
        return
    root = Path(phasewise.__file__).parent
    archive = Path(tempfile.mkdtemp()) / "phasewise-modules.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for module in root.rglob("*.py"):
            out.write(module, module.relative_to(root.parent))
    context.addPyFile(str(archive))
