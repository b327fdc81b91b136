"""The review inputs of one data directory, materialized once per application.

The raw match table is derived from the given tables and
written once, like the warehouse table the review tool reads; the normalized
snapshot, the edit log and the id file are written next to it. Queries scan
these stored tables, so filters and column pruning reach Parquet.
"""

from __future__ import annotations

import hashlib
import inspect
import re
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchdesk import schema as _schema
from matchdesk.functions import exprs as _exprs
from matchdesk.operators import joins as _joins
from matchdesk.operators import save as _save
from matchdesk.session import shared_root
from matchdesk.sources import fixtures as FX
from matchdesk.sources import load as _load
from matchdesk.sources import tables as _tables
from matchdesk.sources.load import normalize

def _fingerprint() -> str:
    """Hash of the code that decides what the stored inputs contain. Stored
    inputs live in the shared folder and are reused across applications only
    while this code is unchanged."""
    import sys
    h = hashlib.sha1()
    for mod in (_schema, _exprs, _joins, _save, FX, _load, _tables, sys.modules[__name__]):
        h.update(inspect.getsource(mod).encode())
    return h.hexdigest()[:12]


# Given tables that the stored inputs are derived from.
SOURCES = ("region", "nation", "customer", "supplier", "orders", "lineitem", "events")


def source_state(spark: SparkSession, sf_dir: str) -> str:
    """Hash of name, length and modification time of every source file, so new
    data at the same path gets stored inputs of its own."""
    h = hashlib.sha1()
    for t in SOURCES:
        path = spark._jvm.org.apache.hadoop.fs.Path(_tables.table_path(sf_dir, t))
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        for line in sorted(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in files):
            h.update(f"{t}/{line}\n".encode())
    return h.hexdigest()[:12]


_LOCK = threading.RLock()
_PATHS: dict[tuple[str, str, str], str] = {}
_SCHEMAS: dict[tuple[str, str, str], object] = {}


def _slug(text: str) -> str:
    base = re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_")[-40:]
    return f"{base}_{hashlib.sha1(text.encode()).hexdigest()[:10]}"


def _materialize(spark: SparkSession, sf_dir: str, table: str, build, fmt: str = "parquet", partition_by: list[str] | None = None) -> DataFrame:
    """The stored form of an input: written unless it was written to its end before."""
    state = source_state(spark, sf_dir)
    key = (spark.sparkContext.applicationId, f"{sf_dir}:{state}", table)
    with _LOCK:
        path = _PATHS.get(key)
        if path is None:
            path = f"{shared_root(spark)}/matchdesk/{_slug(f'inputs:{sf_dir}:{state}:{_fingerprint()}')}/{table}"
            if not _tables.written(spark, path):
                build().write.mode("overwrite").format(fmt).partitionBy(*(partition_by or [])).save(path)
            _PATHS[key] = path
        schema = _SCHEMAS.get(key)
        if schema is None:
            df = spark.read.format(fmt).load(path)
            _SCHEMAS[key] = df.schema
            return df
    # a stored input never changes: the schema read once is reused (no footer reads per query)
    return spark.read.format(fmt).schema(schema).load(path)


def stored_path(spark: SparkSession, sf_dir: str, table: str) -> str:
    """Directory of a materialized input (materializing it if needed)."""
    {"raw_matches": raw_matches, "matches": matches, "edits": edits, "id_file": id_file, "audit_log": audit_log}[table](spark, sf_dir)
    return _PATHS[(spark.sparkContext.applicationId, f"{sf_dir}:{source_state(spark, sf_dir)}", table)]


def raw_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored raw match table (text scores and flags, as loaded)."""
    return _materialize(spark, sf_dir, "raw_matches", lambda: FX.raw_matches(spark, sf_dir))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalized snapshot (version 0 of the review table).

    Rows keep the raw table's clustering by recommendation within files, so Parquet statistics
    can skip data for the status filters; sorting the wide rows again would spill them.
    """
    return _materialize(spark, sf_dir, "matches", lambda: normalize(raw_matches(spark, sf_dir)))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edit log (seq, id, field, new_value, edited_at)."""
    return _materialize(spark, sf_dir, "edits",
                        lambda: FX.edits(spark, sf_dir, matches(spark, sf_dir)).sortWithinPartitions("id", "seq"))


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log of saving every edit as it was made, partitioned by day."""
    return _materialize(spark, sf_dir, "audit_log", lambda: _save.trail(edits(spark, sf_dir), matches(spark, sf_dir)),
                        partition_by=["updated_date"])


def id_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uploaded id file, stored as text and read back as lines (`value`)."""
    return _materialize(spark, sf_dir, "id_file",
                        lambda: FX.id_file_lines(spark, sf_dir), fmt="text")


def master_csv(spark: SparkSession, sf_dir: str) -> str:
    """Folder of CSV files of a master table: upper-case header line, some damaged lines."""
    path = f"{shared_root(spark)}/matchdesk/{_slug(f'inputs:{sf_dir}:{source_state(spark, sf_dir)}:{_fingerprint()}')}/master_csv"
    with _LOCK:
        if not _tables.written(spark, path):
            # one column that holds the whole line, under the header as its name; nothing is quoted
            lines = FX.master_lines(spark, sf_dir).toDF(FX.MASTER_HEADER)
            lines.write.mode("overwrite").option("header", True).option("sep", "\x01").option("quote", "").csv(path)
    return path


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.actions(spark, sf_dir)


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.master(spark, sf_dir)


def bucket_config(spark: SparkSession) -> DataFrame:
    return FX.bucket_config(spark)


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.selection(edits(spark, sf_dir))
