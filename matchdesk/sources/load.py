"""Loading and normalizing the match table.

`normalize` turns any loaded match table -- lower- or upper-case names, the
alternate master layout, flags and scores as text -- into the declared
review schema with `select`s only: one projection, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchdesk import schema as S
from matchdesk.functions import exprs as X


CORRUPT = "_corrupt"
NO_ID = "the table has no column id; give it stored ids first (sources.row_ids)"


def load_matches(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Read a match table from any Spark source and normalize it.

    A warehouse table is read the same way through ``fmt``/``options``
    (e.g. ``fmt="jdbc"``) supplied by the caller.
    """
    return normalize(spark.read.format(fmt).options(**options).load(path))


def lower_columns(df: DataFrame) -> DataFrame:
    """Lower-case column names."""
    return df.toDF(*[c.lower() for c in df.columns])


def adapt_layout(df: DataFrame) -> DataFrame:
    """S3: the master layout (hdrcode, no canvas_id) renamed to review columns,
    with empty canvas fields, zero scores and empty status columns added."""
    cols = set(df.columns)
    if "hdrcode" not in cols or "canvas_id" in cols:
        return df
    df = df.withColumnsRenamed({a: b for a, b in S.MASTER_RENAMES if a in cols})
    cols = set(df.columns)
    added = {c: F.lit("") for c in S.MASTER_TEXT_DEFAULTS if c not in cols}
    added.update({c: F.lit(0) for c in S.MASTER_SCORE_DEFAULTS if c not in cols})
    added.update({c: F.lit("") for c in S.MASTER_EXTRA_TEXT_DEFAULTS if c not in cols})
    return df.withColumns(added) if added else df


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """A CSV table with header lines, read permissively under a declared schema: `id`
    whole, the rest text (scores and flags are coerced by `normalize`). A line that does not
    fit has its text in `_corrupt`."""
    names = spark.read.options(**options).option("header", True).csv(path).columns
    fields = [T.StructField(n, T.LongType() if n.lower() == "id" else T.StringType()) for n in names]
    schema = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    return (spark.read.options(**options).option("header", True).schema(schema).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .option("columnPruning", False).csv(path))  # every field is parsed, whichever are asked for


def load_csv(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """(normalized rows, rejects) of a CSV table. Lines with too few or too many fields or
    an id that is no integer, or none, are rejects (`line`); they are not dropped silently."""
    raw = read_csv(spark, path, **options)
    id_col = next((c for c in raw.columns if c.lower() == "id"), None)
    if id_col is None:
        raise ValueError(NO_ID)
    good = F.col(CORRUPT).isNull() & F.col(id_col).isNotNull()
    text = F.coalesce(F.col(CORRUPT), F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in raw.columns if c != CORRUPT]))
    return normalize(raw.filter(good).drop(CORRUPT)), raw.filter(~good).select(text.alias("line"))


def normalize(df: DataFrame) -> DataFrame:
    """Names, layout, flags, text defaults and numeric coercion."""
    df = adapt_layout(lower_columns(df))
    cols = list(df.columns)
    present = set(cols)
    out = []
    for c in cols:
        if c == "id":
            out.append(F.col("id").cast("bigint").alias("id"))
        elif c in S.FLAG_FIELDS:
            out.append(X.to_flag(c).alias(c))
        elif c in S.SCORE_COLUMNS:
            out.append(X.to_number(c).alias(c))
        else:
            out.append(F.col(c))
    for c in S.FLAG_FIELDS:
        if c not in present:
            out.append(F.lit(0).alias(c))
    for c in ("how_to_process", "memo"):
        if c not in present:
            out.append(F.lit("").alias(c))
    if "id" not in present:
        raise ValueError(NO_ID)
    return df.select(*out)


def evolve_schema(df: DataFrame) -> DataFrame:
    """Add the columns the stored table must have, with their defaults.

    Existing columns keep their values and types; only absent ones are added
    (the DataFrame form of ``ALTER TABLE .. ADD COLUMN .. DEFAULT``).
    """
    present = {c.lower() for c in df.columns}
    added = {c: (F.lit(v).cast("int") if isinstance(v, int) else F.lit(v))
             for c, v in S.EVOLVED_COLUMNS if c not in present}
    return df.withColumns(added) if added else df


def evolve_table(spark: SparkSession, table: str, audit_table: str | None = None) -> list[str]:
    """S7 on a catalog table: `ALTER TABLE .. ADD COLUMNS .. DEFAULT` for every absent review
    column, so that no file is rewritten and old rows read the default; the empty audit log is created from its
    declared schema. Returns the columns added."""
    present = {c.lower() for c in spark.table(table).columns}
    added = [(c, v) for c, v in S.EVOLVED_COLUMNS if c not in present]
    if added:
        spec = ", ".join(f"{c} {'INT' if isinstance(v, int) else 'STRING'} DEFAULT {v!r}" for c, v in added)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({spec})")
    if audit_table and not spark.catalog.tableExists(audit_table):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.AUDIT_SCHEMA.fields)
        spark.sql(f"CREATE TABLE {audit_table} ({columns}, updated_date DATE) USING parquet PARTITIONED BY (updated_date)")
    return [c for c, _ in added]


def bucket_ranges(config: DataFrame) -> DataFrame:
    """BA_CONFIG key/value rows -> one row per bucket recommendation
    with double bounds min_name, max_name, min_addr, max_addr ('' -> NULL).

    A fixed 12-row key map is joined in; the pivot lists its 4 values, so the
    result has at most 3 rows whatever the config table holds.
    """
    spark = config.sparkSession
    keymap = spark.createDataFrame(
        [(f"{p}_{suffix}", rec, bound) for p, rec in S.BUCKET_PREFIXES for suffix, bound in S.BUCKET_BOUNDS],
        "config_key string, recommendation string, bound string")
    rows = (config.filter(F.col("category") == S.BUCKET_CATEGORY)
            .join(F.broadcast(keymap), "config_key"))
    bounds = [b for _, b in S.BUCKET_BOUNDS]
    pivoted = rows.groupBy("recommendation").pivot("bound", bounds).agg(F.first("config_value"))
    return pivoted.select("recommendation", *[X.to_number(F.trim(F.col(b))).alias(b) for b in bounds])


def parse_id_list(lines: DataFrame, col: str = "value") -> DataFrame:
    """Id-file text -> one trimmed, non-empty id per row (`canvas_id`).

    Lines may hold several ids separated by commas; CR/LF split lines.
    """
    parts = F.transform(F.split(F.col(col), r"[\r\n,]+"), lambda x: X.trim_ws(x))
    return lines.select(F.explode(F.filter(parts, lambda x: x != "")).alias("canvas_id"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """S9 as a source: a text file of ids."""
    return parse_id_list(spark.read.text(path))
