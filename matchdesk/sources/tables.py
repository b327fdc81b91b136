"""Readers for the input Parquet tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
MAX_OPEN = 32  # a Parquet file of the review table takes a few MB while it is open
ROWS_PER_TASK = 4_000_000
ROWS_PER_SORT = 250_000
MAX_FOLDERS = 256  # keeps files in proportion to the rows


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(table_path(sf_dir, name))


def row_count(df: DataFrame) -> int:
    """Row count of a (scan-only) DataFrame; Parquet answers it from footers."""
    return df.count()


def written(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet or text folder was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


@contextmanager
def unsorted_folders(spark: SparkSession, folders: int) -> Iterator[None]:
    """Inside, a task that writes with ``partitionBy`` rows that come folder by folder keeps the files of so many
    folders (``MAX_OPEN`` at most) open; otherwise it sorts its rows by folder first, and wide rows spill."""
    old = spark.conf.get(OPEN_FILES)
    spark.conf.set(OPEN_FILES, str(min(folders, MAX_OPEN) + 1))
    try:
        yield
    finally:
        spark.conf.set(OPEN_FILES, old)


def write_folders(df: DataFrame, path: str, by: list[str], folders: int, rows: int) -> None:
    """Write a stored table into folders (the last column of ``by`` numbers them) straight from the tasks
    that scan it: Parquet takes a fraction of the bytes of a shuffle, and a hot key is spread over the
    tasks that hold it. A folder gets a file per task, so tasks are merged to about ``ROWS_PER_TASK``
    rows; the table is scanned in passes of some folders each, so that a task sorts about ``ROWS_PER_SORT``
    rows at a time and need not spill."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / ROWS_PER_TASK))
    passes = min(folders, max(1, math.ceil(rows / tasks / ROWS_PER_SORT)))
    for i in range(passes):
        some = df if passes == 1 else df.filter(F.col(by[-1]) % passes == i)
        some.coalesce(tasks).write.mode("append" if i else "errorifexists").partitionBy(*by).parquet(path)
