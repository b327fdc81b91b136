"""Row ids for tables that come without one.

A stored map holds the id of every key seen so far. An import looks its keys up: known ones
keep their id, new ones get ids after the greatest, numbered in key order, and are added to
the map. Ids therefore do not depend on how the table is partitioned, nor on what was
imported before them in the same order of imports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchdesk.operators.ordering import global_positions
from matchdesk.sources.tables import written

COPY = "_copy"  # of rows with one key: first, second, ...


def stored_ids(spark: SparkSession, path: str) -> DataFrame | None:
    """The map (key columns, _copy, id), or None before the first import."""
    return spark.read.parquet(path) if written(spark, path) else None


def import_ids(table: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """``table`` with the column ``id`` in front.

    ``keys`` name the columns that identify a row. Rows that share a key (null is a key
    value too) are told apart by their order over all columns; the same rows get the same ids."""
    spark = table.sparkSession
    others = [F.xxhash64(*table.columns), *[F.col(c).cast("string") for c in table.columns if c not in keys]]
    rows = table.withColumn(COPY, F.row_number().over(Window.partitionBy(*keys).orderBy(*others)))
    key = [*keys, COPY]
    known = stored_ids(spark, path)
    fresh, top = rows.select(*key), 0
    if known is not None:
        top = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        same = [F.col(f"k.{c}").eqNullSafe(F.col(f"n.{c}")) for c in key]
        fresh = fresh.alias("n").join(known.alias("k"), same, "left_anti")
    order = [F.col(c).asc_nulls_first() for c in key]
    numbered = global_positions(fresh, order, order, name="id").withColumn("id", (F.col("id") + F.lit(top)).cast("bigint"))
    numbered.write.mode("append").parquet(path)
    ids = spark.read.parquet(path)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"i.{c}")) for c in key]
    return rows.alias("r").join(ids.alias("i"), same).select("i.id", *[f"r.{c}" for c in table.columns])
