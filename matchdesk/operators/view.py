"""Views of the match table: filters (F1-F16), sort and page (O1-O5), projections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from matchdesk import schema as S
from matchdesk.functions import exprs as X


@dataclass(frozen=True)
class ViewFilter:
    """The review filters; absent parts do not filter.

    recommendations: comma list or list (F1/F2); ssn: 'yes' | 'no' | 'partial'
    (F3); score bounds inclusive, a bound drops NULL scores (F4/F5); search: a
    case-insensitive regex over every column (F7); quick: words that must all
    appear in some visible column (F8).
    """
    recommendations: str | tuple[str, ...] | None = None
    ssn: str | None = None
    min_name: float | None = None
    max_name: float | None = None
    min_addr: float | None = None
    max_addr: float | None = None
    search: str | None = None
    quick: str | None = None


def parse_recommendations(value) -> list[str]:
    """'a, b,,c' -> ['a','b','c'] (trimmed, empties dropped)."""
    if value is None:
        return []
    items = value.split(",") if isinstance(value, str) else list(value)
    return [v.strip() for v in items if v and v.strip()]


def ssn_predicate(kind: str | None) -> Column | None:
    """yes = 100, no = 0, partial strictly between; NULL is in none."""
    x = F.col("ssn_match")
    return {"yes": x == 100, "no": x == 0, "partial": (x > 0) & (x < 100)}.get(kind or "")


def range_predicate(c: str, lo: float | None, hi: float | None) -> list[Column]:
    """inclusive bounds; comparisons with NULL are false, so a bound drops NULLs."""
    out = []
    if lo is not None:
        out.append(F.col(c) >= F.lit(float(lo)))
    if hi is not None:
        out.append(F.col(c) <= F.lit(float(hi)))
    return out


def filter_predicate(f: ViewFilter) -> list[Column]:
    """the pushed-down part of the view -- IN, equality and ranges only."""
    preds: list[Column] = []
    recs = parse_recommendations(f.recommendations)
    if recs:
        preds.append(F.col("recommendation").isin(recs))
    ssn = ssn_predicate(f.ssn)
    if ssn is not None:
        preds.append(ssn)
    preds += range_predicate("name_score", f.min_name, f.max_name)
    preds += range_predicate("address_score", f.min_addr, f.max_addr)
    return preds


def search_predicate(df: DataFrame, pattern: str) -> Column:
    """case-insensitive regex over the text form of every column.

    An OR chain of `rlike`s (stays in whole-stage codegen); NULL never
    matches; integral doubles read without a fraction.
    """
    return X.any_of([X.regex_hit(X.text_form(f.name, f.dataType), pattern) for f in df.schema.fields])


def visible_display_values() -> list[Column]:
    """Display text of the default-visible grid columns (quick-filter scope)."""
    out = []
    for cid, _label, visible in S.GRID_COLUMNS:
        if visible:
            out.append(display_value(cid))
    return out


def display_value(cid: str) -> Column:
    """The value a grid column shows (its value getter), as text."""
    if cid == "canvas_csz":
        return X.csz_label("canvas_city", "canvas_state", "canvas_zip")
    if cid == "dec_csz":
        return X.csz_label("dec_city", "dec_state", "dec_zip")
    if cid == "canvas_id":
        return X.code_label("canvas_id", "canvas_addrseq")
    if cid == "dec_hdrcode":
        return X.code_label("dec_hdrcode", "dec_addrsubcode")
    if cid == "how_to_process":
        return X.effective_process()
    if cid in S.SCORE_COLUMNS:
        return X.number_text(cid)
    return F.col(cid).cast("string")


def quick_predicate(text: str) -> Column:
    """F8: every whitespace-separated word is contained, ignoring case, in
    some visible column's display text."""
    words = [w for w in text.split() if w]
    values = visible_display_values()
    return X.all_of([X.any_of([X.ci_contains(v, w) for v in values]) for w in words])


def view(df: DataFrame, f: ViewFilter) -> DataFrame:
    """Rows of the current view: F6, then search (F7) and quick filter (F8)."""
    preds = filter_predicate(f)
    if f.search:
        preds.append(search_predicate(df, f.search))
    if f.quick and f.quick.strip():
        preds.append(quick_predicate(f.quick))
    return df.filter(X.all_of(preds)) if preds else df


def view_predicate(df: DataFrame, f: ViewFilter) -> Column:
    """The whole view as one boolean column (for one-pass counts)."""
    preds = filter_predicate(f)
    if f.search:
        preds.append(search_predicate(df, f.search))
    if f.quick and f.quick.strip():
        preds.append(quick_predicate(f.quick))
    return F.coalesce(X.all_of(preds), F.lit(False))


# ---- sort and page ---------------------------------------------------------

def sort_keys(column: str | None, direction: str = "asc") -> list[Column]:
    """O1: allowed column asc/desc with NULLs last in both, then `id`.

    A column outside the allow-list is ignored (order by id only).
    """
    keys = []
    if column in S.SORTABLE_COLUMNS and column != "id":
        c = F.col(column)
        keys.append(c.asc_nulls_last() if direction == "asc" else c.desc_nulls_last())
    if column == "id" and direction != "asc":
        return [F.col("id").desc()]
    keys.append(F.col("id").asc())
    return keys


def page(df: DataFrame, start: int = 0, length: int = S.DEFAULT_PAGE_LENGTH,
         sort: tuple[str, str] | None = None, topk_limit: int | None = None) -> DataFrame:
    """O2: one page -> TakeOrderedAndProject(limit=start+length, offset=start). Length -1
    is every row from `start` (O3).

    A top-k buffers start+length rows per task, so past `topk_limit` the page
    is the first `length` rows after a distributed boundary (`from_offset`).
    """
    limit = TOPK_BOUNDARY_LIMIT if topk_limit is None else topk_limit
    if length < 0:
        return from_offset(df, start, sort, topk_limit=limit)
    if start > limit:
        return from_offset(df, start, sort, topk_limit=limit).limit(length)
    column, direction = sort or ("id", "asc")
    ordered = df.orderBy(*sort_keys(column, direction))
    if start:
        ordered = ordered.offset(start)
    return ordered.limit(length)


def page_with_counts(df: DataFrame, f: ViewFilter, start: int = 0, length: int = S.DEFAULT_PAGE_LENGTH,
                     sort: tuple[str, str] | None = None) -> DataFrame:
    """A6 + O2: a page of a view, each row with `records_total` and `records_filtered`.

    Both counts are metrics observed on the way by the job that finds the page; no job
    counts. A page of a length is collected, it has at most `length` rows. For length -1
    (every row from `start`) the job that finds the first row gives the counts, and the rows
    themselves stay a DataFrame. A page behind the last row has no rows, so no counts.
    """
    total, shown = Observation(), Observation()
    n = F.count(F.lit(1)).alias("n")
    seen = view(df.observe(total, n), f).observe(shown, n)
    column, direction = sort or ("id", "asc")
    keys = sort_keys(column, direction)
    if length >= 0:
        got = seen.orderBy(*keys).offset(start).limit(length)
        out = df.sparkSession.createDataFrame(got.collect(), got.schema)
    else:
        key_col = column if column in S.SORTABLE_COLUMNS else "id"
        out = view(df, f)
        if start:
            last = seen.orderBy(*keys).offset(start - 1).limit(1).select(key_col, F.col("id").alias("_id")).first()
            out = out.limit(0) if last is None else out.filter(after_key(column, direction, last[0], last[1]))
        else:
            seen.agg(n).collect()
        out = out.orderBy(*keys)
    return out.withColumns({"records_total": F.lit(total.get["n"]).cast("bigint"),
                            "records_filtered": F.lit(shown.get["n"]).cast("bigint")})


def after_key(column: str, direction: str, value, row_id: int) -> Column:
    """Keyset predicate: rows strictly after (value, id) in sort_keys order."""
    i = F.col("id")
    if column not in S.SORTABLE_COLUMNS or column == "id":
        return i < F.lit(row_id) if (column == "id" and direction != "asc") else i > F.lit(row_id)
    c = F.col(column)
    if value is None:
        return c.isNull() & (i > F.lit(row_id))
    beyond = (c > F.lit(value)) if direction == "asc" else (c < F.lit(value))
    return c.isNull() | beyond | ((c == F.lit(value)) & (i > F.lit(row_id)))


# Above this offset the boundary row is not found by a top-k (whose per-task
# buffer grows with the offset) but by distributed global numbering.
TOPK_BOUNDARY_LIMIT = 100_000


def from_offset(df: DataFrame, start: int, sort: tuple[str, str] | None = None,
                topk_limit: int = TOPK_BOUNDARY_LIMIT) -> DataFrame:
    """O3: all rows from position `start` (page length -1).

    No global OFFSET (one task). Up to `topk_limit` the boundary row is found
    by a bounded top-k and the rest is a keyset filter; deeper offsets number
    rows with range partitions + per-partition offsets. The result is sorted
    by a range-partitioned sort.
    """
    from matchdesk.operators.ordering import global_positions

    column, direction = sort or ("id", "asc")
    keys = sort_keys(column, direction)
    rest = df
    if start > topk_limit:
        numbered = global_positions(df, keys, keys, name="_pos")
        rest = numbered.filter(F.col("_pos") > F.lit(start)).drop("_pos")
    elif start > 0:
        key_col = column if column in S.SORTABLE_COLUMNS else "id"
        boundary = df.orderBy(*keys).offset(start - 1).limit(1).select(key_col, "id").first()
        if boundary is None:
            return df.limit(0)
        rest = df.filter(after_key(column, direction, boundary[0], boundary[1]))
    return rest.orderBy(*keys)


def shipped(df: DataFrame) -> DataFrame:
    """The shipped columns present in the table, in shipped order."""
    present = set(df.columns)
    return df.select(*[c for c in S.SHIPPED_COLUMNS if c in present])


def blank_all(df: DataFrame) -> DataFrame:
    """Every value as text, NULL -> '' (for text sinks only)."""
    return df.select(*[X.blank(X.text_form(f.name, f.dataType)).alias(f.name) for f in df.schema.fields])


# ---- bucket views (F11, J5) -----------------------------------------------

def in_bucket_range(prefix: str = "") -> Column:
    """Score ranges of a bucket row (columns min_name..max_addr): NULL bound
    is open, a set bound drops NULL scores."""
    def bound(score, b, op):
        x, lim = F.col(score), F.col(prefix + b)
        return lim.isNull() | F.coalesce(op(x, lim), F.lit(False))
    return (bound("name_score", "min_name", lambda a, b: a >= b)
            & bound("name_score", "max_name", lambda a, b: a <= b)
            & bound("address_score", "min_addr", lambda a, b: a >= b)
            & bound("address_score", "max_addr", lambda a, b: a <= b))


def bucket_rows(df: DataFrame, ranges: DataFrame, inside: bool = True) -> DataFrame:
    """rows of each bucket recommendation inside (or outside) its ranges.

    `ranges` comes from `bucket_ranges`, at most 3 rows (one per configured
    bucket), so it is broadcast; the join is an equi-join on recommendation
    with the range test as a residual -- no nested loop.
    """
    r = ranges.select(F.col("recommendation").alias("bucket"), "min_name", "max_name", "min_addr", "max_addr")
    joined = df.join(F.broadcast(r), F.col("recommendation") == F.col("bucket"))
    test = in_bucket_range()
    return joined.filter(test if inside else ~test).drop("min_name", "max_name", "min_addr", "max_addr")


# ---- derived column sets (P4-P16) -------------------------------------------

def display_columns(df: DataFrame) -> DataFrame:
    """Labels the grid derives per row."""
    return df.select(
        "id",
        X.code_label("canvas_id", "canvas_addrseq").alias("canvas_id_label"),
        X.csz_label("canvas_city", "canvas_state", "canvas_zip").alias("canvas_csz"),
        X.csz_label("dec_city", "dec_state", "dec_zip").alias("dec_csz"),
        X.code_label("dec_hdrcode", "dec_addrsubcode").alias("dec_code_label"),
        X.effective_process().alias("process"),
    )


def score_bands(df: DataFrame) -> DataFrame:
    """SSN badge and score bands."""
    return df.select(
        "id",
        X.ssn_badge().alias("ssn_badge"),
        X.score_band("name_score").alias("name_band"),
        X.score_band("address_score").alias("address_band"),
        X.nameaddr_band().alias("nameaddr_band"),
    )


def review_flags(df: DataFrame) -> DataFrame:
    """Do-not-use marks, trust, hints and flag booleans."""
    return df.select(
        "id",
        X.do_not_use("canvas_name").alias("canvas_name_dnu"),
        X.do_not_use("canvas_address").alias("canvas_address_dnu"),
        X.do_not_use("dec_name").alias("dec_name_dnu"),
        X.do_not_use("dec_address").alias("dec_address_dnu"),
        X.is_trust().alias("trust"),
        X.low_name_hint().alias("low_name_hint"),
        X.address_hint().alias("address_hint"),
        X.flag_on("jib").alias("jib_on"),
        X.flag_on("rev").alias("rev_on"),
        X.flag_on("vendor").alias("vendor_on"),
        X.looked_up().alias("address_looked_up"),
    )


def visible_columns(toggles: dict[str, bool] | None = None, all_on: bool | None = None) -> list[str]:
    """Grid column ids shown -- defaults, or all on/off, then per-column toggles."""
    shown = {cid: (v if all_on is None else all_on) for cid, _, v in S.GRID_COLUMNS}
    for cid, on in (toggles or {}).items():
        if cid not in shown:
            raise ValueError(f"unknown column {cid}")
        shown[cid] = on
    return [cid for cid, _, _ in S.GRID_COLUMNS if shown[cid]]


def export_columns(df: DataFrame, visible: list[str] | None = None) -> DataFrame:
    """The visible grid columns under their header labels, as text."""
    labels = {cid: label for cid, label, _ in S.GRID_COLUMNS}
    cols = visible if visible is not None else [cid for cid, _, v in S.GRID_COLUMNS if v]
    derived = {"canvas_csz", "dec_csz"}
    cols = [c for c in cols if c in derived or c in df.columns]  # optional columns may be absent
    return df.select(*[F.coalesce(display_value(c), F.lit("")).alias(labels[c]) for c in cols])


def record_form(df: DataFrame) -> DataFrame:
    """P20: the record form -- typed values, NaN already NULL at load."""
    return df.select(
        "id",
        X.code_label("canvas_id", "canvas_addrseq").alias("canvas_id_label"),
        "canvas_ssn", "canvas_name", "canvas_address", "canvas_city", "canvas_state", "canvas_zip",
        "dec_name", "dec_address", "dec_city", "dec_state", "dec_zip", "dec_contact", "dec_hdrcode",
        "ssn_match", "name_score", "address_score",
        X.score_band("ssn_match").alias("ssn_band"),
        X.score_band("name_score").alias("name_band"),
        X.score_band("address_score").alias("address_band"),
        "recommendation", "address_reason", "memo",
    )
