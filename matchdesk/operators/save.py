"""Saving pending changes (M13, M14, J3, J4, S10, S12, Q3-Q5); `sources.review_table` writes them."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchdesk.operators import edits as E
from matchdesk.operators.joins import bucket_join, is_small, may_match, semi_join, small_side

KEY = ["canvas_id", "canvas_ssn"]


def ntz_literal(ts: _dt.datetime):
    """A TIMESTAMP_NTZ literal that ignores the session time zone (a Python
    datetime literal would be read as local time and shifted)."""
    return F.lit(ts.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def save_by_id(snapshot: DataFrame, pending: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """The new versions of the rows with pending changes (merge on id).
    Fields not edited on a row keep their values (Q2)."""
    maps, keys = E.change_maps(pending, ["id"]), pending if source is None else source
    if is_small(keys):
        return E.apply_changes(snapshot.join(F.broadcast(maps), "id"))
    return E.apply_changes(may_match(snapshot, keys, "id").join(maps, "id"))


def key_changes(edits: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Q4: one value per (business key, field), greatest seq wins. The keys of the edited
    rows are looked up once (J4); the snapshot is narrowed to them first."""
    ids = edits.select("id")
    keys = semi_join(snapshot.select("id", *KEY), ids.distinct(), "id", ids)
    return E.last_values(edits.join(small_side(keys, ids), "id"), [*KEY, "field"])


def merge_by_key(snapshot: DataFrame, changes: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """MERGE of (key, field, new_value) on (canvas_id, canvas_ssn): every row sharing an
    edited key is updated, a NULL key matches nothing (Q5). The change maps are broadcast, at once when
    measured small, else by groups of buckets: a hot key costs nothing extra and the snapshot is
    not shuffled."""
    maps, bound = E.change_maps(changes, KEY), changes if source is None else source
    if is_small(bound):
        return E.apply_changes(snapshot.join(F.broadcast(maps), KEY))
    return bucket_join(snapshot, maps, KEY, bound, E.apply_changes)


def save_by_key(snapshot: DataFrame, edits: DataFrame) -> DataFrame:
    """The rows that a save of these edits by business key changes."""
    return merge_by_key(snapshot, key_changes(edits, snapshot), edits)


def key_counts(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """S12's result: keys edited, keys that no row has, and rows affected."""
    keys = changes.select(*KEY).distinct()
    hits = (snapshot.select(*KEY).join(small_side(keys, changes.select(*KEY)), KEY)
            .groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")))
    per_key = keys.join(small_side(hits, changes.select(*KEY)), KEY, "left")  # one row per key at most
    return per_key.agg(F.count(F.lit(1)).alias("edited_keys"), F.count_if(F.col("n").isNull()).alias("unmatched_keys"),
                       F.coalesce(F.sum("n"), F.lit(0)).alias("rows_affected"))


def unmatched_keys(pending_keyed: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Q5: pending keys that match no row (a NULL key never matches)."""
    keys = pending_keyed.select(*KEY).distinct()
    found = semi_join(snapshot.select(*KEY), keys, KEY, pending_keyed.select(*KEY)).distinct()
    return keys.join(small_side(found, pending_keyed.select(*KEY)), KEY, "left_anti")


def audit_rows(pending_keyed: DataFrame, saved_at: _dt.datetime) -> DataFrame:
    """One audit row per pending (row, field): key, field, old, new, and
    one save timestamp (a literal, the same for the whole save)."""
    return pending_keyed.select(
        "canvas_id", "canvas_ssn", F.col("field").alias("field_name"), "old_value", "new_value",
        ntz_literal(saved_at).alias("updated_at"))


def audit_log(pending_keyed: DataFrame, saved_at: _dt.datetime) -> DataFrame:
    """Audit rows as they are logged, with the row they change. The id is the seq of
    the winning edit, so rows of one save are in the order of their edits."""
    ts = ntz_literal(saved_at)
    return pending_keyed.select(
        F.col("seq").alias("id"), F.col("id").alias("row_id"), "canvas_id", "canvas_ssn", F.col("field").alias("field_name"),
        "old_value", "new_value", ts.alias("updated_at"), ts.alias("created_at"))


def trail(edits: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The audit log of saving each edit as it was made: old value as the edit before left it,
    or the row's own. Edits of no row are not in it."""
    w = Window.partitionBy("id", "field").orderBy("seq")
    e = edits.withColumn("_before", F.lag(F.struct("new_value")).over(w))
    rows = E.rows_of(edits, snapshot)
    old = F.when(F.col("_before").isNull(), E.field_text(F.col("field"))).otherwise(F.col("_before.new_value"))
    return e.join(small_side(rows, edits.select("id")), "id").select(
        F.col("seq").alias("id"), F.col("id").alias("row_id"), "canvas_id", "canvas_ssn", F.col("field").alias("field_name"),
        old.alias("old_value"), "new_value", F.col("edited_at").alias("updated_at"), F.to_date("edited_at").alias("updated_date"))
