"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_root

# A side of a join is broadcast only after its bytes were measured and found
# under this limit; above it the same join runs by shuffle.
BROADCAST_BYTES = 32 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder of ``spark.checkpoint.dir``."""
    return f"{work_root(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost
    executors, and gives row ids assigned in ``df`` a fixed value."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is exact for pure ASCII and much cheaper."""
    return (F.when(F.octet_length(c) == F.char_length(c), F.lower(c))
            .otherwise(F.translate(c, UPPER, LOWER)))


def sized(df: DataFrame, *text_cols: str) -> DataFrame:
    """Hint ``df`` for broadcast when its measured size permits, else leave the
    join to the optimizer (shuffle join with AQE skew splitting)."""
    width = F.lit(16 * len(df.columns))
    for c in text_cols:
        width = width + F.coalesce(F.octet_length(F.col(c)), F.lit(0))
    total = df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df
