"""Dense global positions without a single-partition window.

`row_number()` over a window without partitioning runs in one task. Here rows are
range-partitioned on the order keys and sorted within partitions, each row's index in its
partition is taken, and the result is frozen with a reliable checkpoint (written to the
shared checkpoint folder). Per-partition counts give each partition's offset (one row per
partition: a bounded list), so a position is an addition: one shuffle, no window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchdesk.session import work_root

INDEX_BITS = 33  # a monotonically increasing id holds the partition above, the row's index below


def _sorted_parts(df: DataFrame, order: list[Column], range_cols: list, partitions: int | None) -> tuple[DataFrame, list]:
    """Rows with `_part` and `_index`, frozen, and the sorted (part, count) of non-empty parts."""
    spark = df.sparkSession
    work_root(spark)  # make sure a checkpoint folder is set
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.col("_at")
    rows = (df.repartitionByRange(n, *range_cols).sortWithinPartitions(*order)
            .withColumn("_at", F.monotonically_increasing_id())
            .withColumns({"_part": F.shiftright(at, INDEX_BITS).cast("int"), "_index": at.bitwiseAND(F.lit((1 << INDEX_BITS) - 1))})
            .drop("_at").checkpoint(eager=True))
    counts = sorted((r["_part"], r["_n"]) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).collect())
    return rows, counts


def _offsets(counts: list) -> tuple[dict[int, int], int]:
    out, total = {}, 0
    for part, n in counts:
        out[part] = total
        total += n
    return out, total


def global_positions(df: DataFrame, order: list[Column], range_cols: list,
                     name: str = "pos", partitions: int | None = None,
                     total_col: str | None = None) -> DataFrame:
    """Add a 1-based position column in the total order `order`.

    `range_cols` are the leading order columns used to range-partition; `order`
    must be a total order (end with a unique key) for positions to be stable.
    `total_col`, if given, carries the overall row count.
    """
    rows, counts = _sorted_parts(df, order, range_cols, partitions)
    offsets, total = _offsets(counts)
    table = df.sparkSession.createDataFrame(list(offsets.items()) or [(0, 0)], "_part int, _offset long")
    out = (rows.join(F.broadcast(table), "_part")
           .withColumn(name, F.col("_offset") + F.col("_index") + F.lit(1)).drop("_part", "_index", "_offset"))
    return out.withColumn(total_col, F.lit(total).cast("bigint")) if total_col else out


def with_next(df: DataFrame, order: list[Column], range_cols: list, carry: dict[str, str],
              name: str = "pos", total_col: str = "total", next_name: str = "next_pos") -> DataFrame:
    """Every row with its position, the total, and its next row's position and `carry` columns
    (column -> name), wrapping from the last row to the first. Partitions are read through in
    order; what follows a partition's last row is the first row of the next one, of which the
    driver knows one per partition."""
    rows, counts = _sorted_parts(df, order, range_cols, None)
    offsets, total = _offsets(counts)
    firsts = {r["_part"]: tuple(r[c] for c in carry) for r in rows.filter("_index = 0").select("_part", *carry).collect()}
    parts = [p for p, _ in counts]
    follows = {p: firsts[parts[(k + 1) % len(parts)]] for k, p in enumerate(parts)}
    columns, cols = df.columns, list(carry)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"{name} long", f"{total_col} long",
                        f"{next_name} long", *(f"{carry[c]} {df.schema[c].dataType.simpleString()}" for c in cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: pa.Table, after: tuple) -> pa.RecordBatch:
            part = t.column("_part")[0].as_py()
            pos = pa.array([offsets[part] + i + 1 for i in t.column("_index").to_pylist()], pa.int64())
            nxt = pa.array([p.as_py() % total + 1 for p in pos], pa.int64())
            shifted = [pa.concat_arrays([t.column(c).combine_chunks()[1:], pa.array([v], t.schema.field(c).type)]) for c, v in zip(cols, after)]
            arrays = [t.column(c).combine_chunks() for c in columns] + [pos, pa.array([total] * len(t), pa.int64()), nxt, *shifted]
            return pa.RecordBatch.from_arrays(arrays, [*columns, name, total_col, next_name, *(carry[c] for c in cols)])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            if held is not None:
                yield out(held, tuple(t.column(c)[0].as_py() for c in cols))
            held = t
        if held is not None:
            yield out(held, follows[held.column("_part")[0].as_py()])

    return rows.select(*columns, "_part", "_index").mapInArrow(run, schema)
