"""The folder that all executors share, and tables written to it to end their lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``; a temporary folder only in local sessions that have none."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    now = sc._jsc.sc().getCheckpointDir()
    if where is None and now.isDefined():
        where = now.get()
    if where is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="textloom-index-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    if now.isEmpty():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many partitions as there are cores, if the source has fewer splits (one small file, say)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores)


def by_document(rows: DataFrame, make, id_col: str = "doc_id") -> DataFrame:
    """``make(rows)``, a table (<id>, idx, ...) made of each row by itself, so that the rows of a document follow each other.

    They do as they are if no two rows have the same id; only if some do is the table sorted by document.
    """
    made = make(rows)
    twice = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return made if twice.isEmpty() else sorted_by_document(made, id_col)


def sorted_by_document(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of a document in one partition, one after the other and in order of ``idx``."""
    return rows.repartition(F.col(id_col)).sortWithinPartitions(id_col, "idx")
