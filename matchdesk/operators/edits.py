"""Changes as data.

Every change operator is a job from (snapshot, selector, value) to an edits
DataFrame (id, field, old_value, new_value). The edit log
(seq, id, field, new_value, edited_at) is compacted to pending changes,
overlaid on the snapshot, and saved by `operators.save`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchdesk import schema as S
from matchdesk.functions import exprs as X
from matchdesk.operators.joins import anti_join, cannot_match, is_small, known_keys, lookup, may_match, semi_join, small_side


def field_text(field: Column) -> Column:
    """Current value of the (row's) editable field named by `field`, as text.

    A CASE over the 12 editable columns; flags read as '0'/'1'. NULL stays NULL.
    """
    branches = [(field == f, F.col(f).cast("string")) for f in S.EDITABLE_FIELDS]
    first, rest = branches[0], branches[1:]
    return reduce(lambda acc, b: acc.when(b[0], b[1]), rest, F.when(first[0], first[1]))


def rows_of(edits: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Key and editable fields of the edited rows, from one scan of the snapshot."""
    ids = edits.select("id")
    return semi_join(snapshot.select("id", "canvas_id", "canvas_ssn", *S.EDITABLE_FIELDS), ids.distinct(), "id", ids)


def shape_checked(edits: DataFrame) -> DataFrame:
    """F15/M1 without the table: `status` ok | unknown_field | bad_value of every edit. Flags
    must be integers; their accepted value is the integer's text."""
    is_flag = F.col("field").isin(*S.FLAG_FIELDS)
    text = F.trim(F.col("new_value"))
    number = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int").cast("string"))
    status = (F.when(~F.coalesce(F.col("field").isin(*S.EDITABLE_FIELDS), F.lit(False)), F.lit("unknown_field"))
              .when(is_flag & number.isNull(), F.lit("bad_value")).otherwise(F.lit("ok")))
    value = F.when(is_flag & number.isNotNull(), number).otherwise(F.col("new_value"))
    return edits.withColumns({"new_value": value, "status": status})


def validate(edits: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Status of every edit: ok | unknown_field | unknown_id | bad_value.

    A refused edit keeps its text. The id check is a left join to the snapshot ids.
    """
    known = known_keys(edits, snapshot, "id").withColumn("_known", F.lit(True))
    e = shape_checked(edits).join(small_side(known, edits.select("id")), "id", "left")
    status = (F.when(F.col("status") == "unknown_field", F.col("status"))
              .when(F.col("_known").isNull(), F.lit("unknown_id")).otherwise(F.col("status")))
    return e.select("seq", "id", "field", "new_value", status.alias("status"))


def accepted(checked: DataFrame) -> DataFrame:
    """The validated edits that may be applied (value as it will be stored)."""
    return checked.filter(F.col("status") == "ok").drop("status")


def refused(checked: DataFrame) -> DataFrame:
    """The other edits, with the reason."""
    return checked.filter(F.col("status") != "ok")


def last_values(edits: DataFrame, keys: list[str]) -> DataFrame:
    """Latest new value per key (greatest seq wins), with that seq.

    Partial aggregation runs map-side, so a hot key is reduced before the shuffle.
    """
    return edits.groupBy(*keys).agg(F.max("seq").alias("seq"),
                                    F.max_by("new_value", "seq").alias("new_value"))


def compact(edits: DataFrame, snapshot: DataFrame, with_key: bool = False) -> DataFrame:
    """Pending changes -- first old value (the snapshot's), last new.

    The old value is looked up by joining the (much smaller) compacted edits
    to the snapshot on id and picking the field with a CASE, instead of
    unpivoting 12 columns of the whole snapshot.
    """
    last = last_values(edits, ["id", "field"])
    cols = ["id", *S.EDITABLE_FIELDS] + (["canvas_id", "canvas_ssn"] if with_key else [])
    snap = snapshot.select(*cols)
    j = lookup(last, snap, "id", edits)  # at most one row per edit
    out = [F.col("id"), F.col("field"), field_text(F.col("field")).alias("old_value"),
           F.col("new_value"), F.col("seq")]
    if with_key:
        out += [F.col("canvas_id"), F.col("canvas_ssn")]
    return j.select(*out)


def pending_count(pending: DataFrame) -> DataFrame:
    """Number of rows with pending changes."""
    return pending.agg(F.count_distinct("id").alias("pending_count"))


def net_changes(pending: DataFrame) -> DataFrame:
    """Pending changes that change something (NULL-safe)."""
    return pending.filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def edited_fields(pending: DataFrame) -> DataFrame:
    """The set of edited fields (at most 12), sorted."""
    return pending.select("field").distinct().orderBy("field")


def typed_value(field: str, value: Column) -> Column:
    """Edit text -> the column's type (flags as int, scores as double)."""
    if field in S.FLAG_FIELDS:
        return X.to_flag(value)
    if field in S.SCORE_COLUMNS:
        return X.to_number(value)
    return value


def change_maps(pending: DataFrame, keys: list[str]) -> DataFrame:
    """keys -> map(field -> new_value). One entry per field (pending is
    compacted), so a map holds at most the 12 editable fields."""
    return pending.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("field", "new_value"))).alias("_changes"))


def apply_changes(df: DataFrame) -> DataFrame:
    """Overwrite each editable field present in `_changes`; others stay (Q2)."""
    m = F.col("_changes")
    out = []
    for f in df.schema.fields:
        if f.name == "_changes":
            continue
        if f.name in S.EDITABLE_FIELDS:
            out.append(F.when(F.coalesce(F.map_contains_key(m, F.lit(f.name)), F.lit(False)),
                              typed_value(f.name, m[f.name]).cast(f.dataType))
                       .otherwise(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def overlay(snapshot: DataFrame, pending: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """The snapshot with pending changes applied (a NULL new value survives).

    The per-row change maps are broadcast when their bytes, or those of the edit log they
    come from (`source`), are proven small, so the snapshot is scanned once and not shuffled.
    Otherwise only rows that may be edited are shuffled; the others pass as they are."""
    maps, keys = change_maps(pending, ["id"]), pending if source is None else source
    if is_small(keys):
        return apply_changes(snapshot.join(F.broadcast(maps), "id", "left"))
    edited = apply_changes(may_match(snapshot, keys, "id").join(maps, "id", "left"))
    return edited.unionByName(cannot_match(snapshot, keys, "id"))


# ---- change producers ------------------------------------------------------

def bulk_set(snapshot: DataFrame, ids: DataFrame, field: str = "recommendation",
             value: str = S.APPROVED) -> DataFrame:
    """M2/M7: set `field` on the selected rows; the true old value is logged (Q7, Q8).
    Unknown ids are not edits (see rejects)."""
    rows = semi_join(snapshot, ids.select("id").distinct(), "id")
    return rows.select("id", F.lit(field).alias("field"),
                       F.col(field).cast("string").alias("old_value"),
                       F.lit(value).alias("new_value"))


def rejects(ids: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Requested ids that are not in the table."""
    req = ids.select("id").distinct()
    return anti_join(req, small_side(known_keys(req, snapshot, "id"), req), "id")


def import_flag(snapshot: DataFrame, id_list: DataFrame, field: str = "jib") -> DataFrame:
    """Flag rows whose trimmed canvas_id is listed and not yet set;
    the true old value is logged (Q8)."""
    if field not in S.FLAG_FIELDS:
        raise ValueError("Invalid field")
    keyed = snapshot.withColumn("_cid", X.trim_ws(F.col("canvas_id").cast("string")))
    ids = id_list.select(F.col("canvas_id").alias("_cid")).distinct()
    rows = semi_join(keyed, ids, "_cid").filter(F.col(field) != 1)
    return rows.select("id", F.lit(field).alias("field"), F.col(field).cast("string").alias("old_value"),
                       F.lit("1").alias("new_value"))


def import_counts(snapshot: DataFrame, id_list: DataFrame, field: str = "jib") -> DataFrame:
    """Rows updated, rows already set, and ids in the file (one pass over
    the matched rows; the file count is a scalar)."""
    keyed = snapshot.withColumn("_cid", X.trim_ws(F.col("canvas_id").cast("string")))
    ids = id_list.select(F.col("canvas_id").alias("_cid"))
    n_ids = ids.count()
    matched = semi_join(keyed, ids.distinct(), "_cid")
    return matched.agg(F.count_if(F.col(field) != 1).alias("updated"),
                       F.count_if(F.col(field) == 1).alias("already_set"),
                       F.count(F.lit(1)).alias("matched"),
                       F.lit(n_ids).cast("bigint").alias("total_in_file"))


def set_process(view_rows: DataFrame, value: str) -> DataFrame:
    """Set how_to_process on every row in view whose value differs."""
    return view_rows.filter(X.blank("how_to_process") != F.lit(value)).select(
        "id", F.lit("how_to_process").alias("field"), F.col("how_to_process").alias("old_value"), F.lit(value).alias("new_value"))


FORM_FIELDS = S.FORM_FIELDS


def form_edits(forms: DataFrame, snapshot: DataFrame) -> DataFrame:
    """M8: a record-form save writes its 8 fields, changed or not.

    `forms` has `id` and the form fields that were typed; the others are saved as the form
    shows them (NULL as ''). One join gives the rows' old values and those shown; `stack`
    turns each form into 8 edits.
    """
    typed = [c for c in FORM_FIELDS if c in forms.columns]
    f = forms.select("id", *[F.col(c).alias("_new_" + c) for c in typed])
    j = lookup(f, snapshot.select("id", *FORM_FIELDS), "id")
    j = j.withColumns({"_new_" + c: X.blank(c) for c in FORM_FIELDS if c not in typed})
    pairs = ", ".join(f"'{c}', {c}, _new_{c}" for c in FORM_FIELDS)
    return j.selectExpr("id", f"stack({len(FORM_FIELDS)}, {pairs}) as (field, old_value, new_value)")


def toggle_flag(cells: DataFrame, snapshot: DataFrame, field: str = "rev", value: int = 1) -> DataFrame:
    """M9: a flag set on a range of cells changes each row once."""
    rows = semi_join(snapshot, cells.select("id").dropDuplicates(["id"]), "id")
    return rows.select("id", F.lit(field).alias("field"), F.col(field).cast("string").alias("old_value"),
                       F.lit(str(value)).alias("new_value"))
