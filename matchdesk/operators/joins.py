"""Join helpers: broadcasts of measured size, semi/anti lookups, key filters of bounded size."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchdesk.session import work_root
from matchdesk.sources.tables import MAX_FOLDERS, write_folders

# A side is broadcast only when its bytes were measured and found under this limit.
BROADCAST_BYTES = 64 << 20
MIN_BUCKETS = 16  # of a bucket join
# Bits of a key filter: about 32 MB when all words are in use, whatever the number of keys.
FILTER_BITS = 1 << 27
WORD, GROUP = 64, 64  # bits of a word, words of a broadcast row
FILTERED_TYPES = ("bigint", "int", "string")  # equal values of one of these have equal hashes


def _width(df: DataFrame) -> Column:
    """Bytes of a row: the length of each text, 16 for any other value."""
    width = F.lit(0)
    for f in df.schema.fields:
        if f.dataType.simpleString() in ("string", "binary"):
            width = width + F.lit(16) + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif f.dataType.simpleString().startswith(("map", "array", "struct")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0))
        else:
            width = width + F.lit(16)
    return width.cast("long")


def bytes_of(df: DataFrame) -> int:
    """Bytes of a DataFrame's rows, from one aggregate."""
    return df.agg(F.coalesce(F.sum(_width(df)), F.lit(0))).first()[0]


def bytes_by(df: DataFrame, by: str) -> list[tuple]:
    """(value, bytes of its rows) for every value of ``by``, in order. For columns of few values."""
    return sorted(tuple(r) for r in df.groupBy(by).agg(F.sum(_width(df))).collect())


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    return bytes_of(df) <= (BROADCAST_BYTES if limit is None else limit)


def small_side(df: DataFrame, source: DataFrame | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A join side, broadcast only when its bytes are proven small.

    ``source`` is an input that bounds the side (change maps hold no more than the edit log
    they come from) and is cheaper to measure. Left to AQE, both join inputs would be shuffled
    before the small one is measured, so the big side -- the whole snapshot -- would be
    shuffled for nothing. Above the limit the plain shuffle join is kept (AQE splits skew).
    """
    return F.broadcast(df) if bytes_of(df if source is None else source) <= limit else df


def semi_join(df: DataFrame, keys: DataFrame, on, source: DataFrame | None = None) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys`` (EXISTS).

    Key lists are user input (an uploaded file, a selection) with no size known in
    advance: they (or their ``source``) are measured and broadcast only when small. Of a long
    list a filter is broadcast instead, and only the rows that pass it are shuffled.
    """
    if is_small(keys if source is None else source):
        return df.join(F.broadcast(keys), on, "left_semi")
    return may_match(df, keys, on).join(keys, on, "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Rows of ``df`` whose key is not in ``keys`` (NOT EXISTS)."""
    return df.join(keys, on, "left_anti")


def known_keys(requested: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The requested keys that exist in a big table, without shuffling it:
    the table's key column is semi-joined to the measured request list."""
    req = requested.select(key)
    return semi_join(table.select(key), req.distinct(), key, req)


def _filtered(df: DataFrame, keys: DataFrame, on, how: str) -> DataFrame:
    on = [on] if isinstance(on, str) else on
    types = [df.schema[c].dataType.simpleString() for c in on]
    if types != [keys.schema[c].dataType.simpleString() for c in on] or not set(types) <= set(FILTERED_TYPES):
        return df if how == "left_semi" else df.limit(0)
    at = F.pmod(F.xxhash64(*on), F.lit(FILTER_BITS))
    words = (keys.select(at.alias("_at")).groupBy(F.floor(F.col("_at") / WORD).alias("_word"))
             .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(_at % {WORD} as int))")).alias("_bits")))
    groups = words.groupBy(F.floor(F.col("_word") / GROUP).alias("_group")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("_word") % GROUP, F.col("_bits")))).alias("_words"))
    bits = F.coalesce(F.col("_words")[F.floor(at / WORD) % GROUP], F.lit(0).cast("long"))
    passes = (F.floor(at / (WORD * GROUP)) == F.col("_group")) & (F.getbit(bits, (at % WORD).cast("int")) == 1)
    return df.join(F.broadcast(groups), passes, how)


def may_match(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """The rows of ``df`` whose key may be in ``keys``: all that are, and few others.

    One bit per hash of a key, broadcast; its size is bounded by ``FILTER_BITS`` and not by
    the number of keys, so a big table is narrowed without a shuffle for a list of any
    length. Of k keys, k / FILTER_BITS of the other rows pass as well."""
    return _filtered(df, keys, on, "left_semi")


def cannot_match(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """The other rows: their key is not in ``keys``."""
    return _filtered(df, keys, on, "left_anti")


def lookup(side: DataFrame, table: DataFrame, on, source: DataFrame | None = None) -> DataFrame:
    """``side`` joined to the rows of a big ``table`` that it names: broadcast when it (or
    its ``source``, which has the key too) was measured small, else the table is narrowed
    to the keys before it is shuffled."""
    keys = side if source is None else source
    if is_small(keys):
        return F.broadcast(side).join(table, on)
    return side.join(may_match(table, keys, on), on)


def bucket_groups(sizes: list[tuple[int, int]], limit: int | None = None) -> list[tuple[list[int], bool]]:
    """(buckets, whether their changes fit a broadcast): runs of buckets of at most ``limit``
    bytes; a larger bucket stands alone."""
    limit = BROADCAST_BYTES if limit is None else limit
    out: list[tuple[list[int], bool]] = []
    room = -1
    for bucket, size in sizes:
        if size <= room and out[-1][1]:
            out[-1][0].append(bucket)
            room -= size
        else:
            out.append(([bucket], size <= limit))
            room = limit - size
    return out


def _stored(df: DataFrame, path: str, write: Callable[[DataFrame, str], None]) -> DataFrame:
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_join(big: DataFrame, side: DataFrame, on: list[str], source: DataFrame, then: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``then`` of the inner join of a big table with a side (keys once each) too large for a
    broadcast, stored in the work folder; the big table is not shuffled.

    Its rows that may match are written in hash buckets of the key by the tasks that scan them, the side
    beside them. Groups of buckets whose sides fit a broadcast are then joined one after the other: a row
    is written twice, in columns; no broadcast grows with the side, and a hot key stays spread over
    files. ``source`` is an input that has the side's keys and bounds its size."""
    spark, root = big.sparkSession, f"{work_root(big.sparkSession)}/matchdesk/join-{uuid.uuid4().hex}"
    n = min(MAX_FOLDERS, max(MIN_BUCKETS, math.ceil(bytes_of(source) / max(1, BROADCAST_BYTES))))
    rows, schema, bucket = big.count(), then(big.join(side, on)).schema, F.pmod(F.hash(*on), F.lit(n))
    side = _stored(side.withColumn("_bucket", bucket), f"{root}/side",
                   lambda df, path: df.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(path))
    big = _stored(may_match(big.dropna(subset=on), side, on).withColumn("_bucket", bucket), f"{root}/big",
                  lambda df, path: write_folders(df, path, ["_bucket"], n, rows))
    groups = bucket_groups(bytes_by(side, "_bucket"))
    for buckets, small in groups:
        mine = F.col("_bucket").isin(buckets)
        part = side.filter(mine)
        joined = big.filter(mine).join(F.broadcast(part) if small else part, ["_bucket", *on]).drop("_bucket")
        then(joined).write.mode("append").parquet(f"{root}/joined")
    return spark.read.schema(schema).parquet(f"{root}/joined") if groups else spark.createDataFrame([], schema)
