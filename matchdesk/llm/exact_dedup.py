"""Exact dedup by a tree merge of sorted digest runs. DataFrame functions only.

Every input partition is one *run*: its documents reduced to (digest, smallest
identifier, copies), sorted by digest. Runs are merged in binomial rounds: in
round k the runs whose numbers agree after dropping k groups of ``log2(fan_in)``
bits exchange their entries and are merged ``fan_in`` ways. Each merge keeps the
smallest identifier and adds up the copies, so a text that fills a third of all
rows costs one entry per run from the first round on. Merges are spread over
the cluster by (run, digest); no task holds a whole run.

The identifier is *verified* at every level: entries meet only if the SHA-256,
an independent 64-bit hash and the byte length of the normalised text all agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SPACE_RUN = r"[\x20\x09-\x0D]+"
KEY = ["digest", "check", "n_bytes"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, check, n_bytes, run), stored sorted within each run."""
    text = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"))
    runs = text.select("id", F.unhex(F.sha2("t", 256)).alias("digest"),
                       F.xxhash64("t").alias("check"), F.octet_length("t").alias("n_bytes"),
                       F.spark_partition_id().alias("run"))
    return stored(runs.sortWithinPartitions("digest", "id"), "digest-runs")


def merge_runs(runs: DataFrame, fan_in: int = 16) -> DataFrame:
    """(digest, check, n_bytes, keep_id, group_size) after all rounds."""
    top = runs.agg(F.max("run")).first()[0] or 0
    level = runs.groupBy("run", *KEY).agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    while True:
        # the last round leaves one run; spread by digest, not gathered
        level = (level.groupBy(F.floor(F.col("run") / fan_in).cast("int").alias("run"), *KEY)
                 .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
        top //= fan_in
        if top == 0:
            return level.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                fan_in: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; all empty texts are one group. Rows that repeat
    both id and text count in ``group_size`` and share the keep flag. A null id
    is never the smallest unless the whole group has null ids. Other columns of
    the input, whatever their names, are not read. An empty table gives no rows.
    """
    runs = digest_runs(docs, id_col, text_col)
    merged = merge_runs(runs, fan_in)
    out = runs.join(merged, KEY, "left")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size",
                      F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
       sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
