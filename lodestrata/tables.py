"""Access to the tables of one data directory, and cluster-wide helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` below ``root`` (a file or a folder of Parquet parts)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    A session that names none is a local one (tests, bench); only then a local
    folder is made and remembered for the session.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        got = sc._jsc.sc().getCheckpointDir()
        folder = got.get() if got.isDefined() else None
    if not folder:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="lodestrata-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = "file://" + local
        sc.setCheckpointDir(folder)
    return folder


def _own_folder(spark: SparkSession) -> str:
    return os.path.join(shared_folder(spark), f"lodestrata-{spark.sparkContext.applicationId}")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in this application's part of the shared folder, for a table that is written once and read again."""
    return os.path.join(_own_folder(spark), f"{label}-{uuid.uuid4().hex}")


def clear_scratch(spark: SparkSession) -> bool:
    """Delete what this application has written between; only when no result that was read from there is needed any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there and any executor may be lost.

    Stronger compression saves disk where texts are written; where joins follow, the
    size of the files should stay near that of the rows, as Spark chooses by it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str, name: str = "nth") -> DataFrame:
    """``df`` with its rows numbered from 0 in an order, without gathering them in one task.

    Rows are split by ranges of the order and counted per range; equal rows of
    the order are numbered in any way.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    starts = ranged.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn("__within", within).join(starts, "__part").withColumn(name, F.col("__start") + F.col("__within")).drop("__part", "__start", "__within")
