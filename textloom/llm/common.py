"""Helpers shared by the operators: safe column names, row keys, checkpoints and table access."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"__{name}"
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        out.append(new)
    return out


def q(name: str) -> str:
    """A column name quoted, so that dots and spaces in it are taken literally."""
    return f"`{name.replace('`', '``')}`"


def numbered(df: DataFrame, columns: list[str], *extra: Column) -> DataFrame:
    """The columns under plain names, c0, c1 and so on: functions over Arrow batches refuse dotted ones."""
    return df.select(*[F.col(q(c)).alias(f"c{i}") for i, c in enumerate(columns)], *extra)


def with_text(df: DataFrame, columns: list[str], text_col: str) -> tuple[DataFrame, int]:
    """:func:`numbered` columns and the place of the text among them; it is added only where it is not one of them."""
    if text_col in columns:
        return numbered(df, columns), columns.index(text_col)
    return numbered(df, columns, F.col(q(text_col)).alias("text")), len(columns)


def row_key(id_col: str, text_col: str) -> Column:
    """64 bits that name a row: rows that repeat both id and text share them, null ids included."""
    return F.xxhash64(F.col(q(id_col)), F.col(q(text_col)))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where that is unset (tests, local sessions) a temporary folder is used, and removed when the process
    ends; on a cluster it must be set.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder is None and sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc._jsc.sc().getCheckpointDir().get()
    if folder is None:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_enough(rows: int, bytes_per_row: int, limit_bytes: int) -> bool:
    """Whether a table of that many rows may be broadcast."""
    return rows * bytes_per_row <= limit_bytes


def maybe_broadcast(df: DataFrame, rows: int, bytes_per_row: int, limit_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if its measured size allows it; otherwise Spark shuffles for the join."""
    return F.broadcast(df) if small_enough(rows, bytes_per_row, limit_bytes) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
