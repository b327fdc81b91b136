"""Find and replace over the text columns.

Cells are columns x rows: the 9 text columns are unpivoted (an Expand, no
shuffle) only for rows that have at least one hit, so the cell table is as
large as the answer, not 9x the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchdesk import schema as S
from matchdesk.functions import exprs as X
from matchdesk.operators.ordering import global_positions, with_next


def find_scope(column: str = "all") -> list[str]:
    """Columns searched: all 9 text columns or one of them; others are an error."""
    if column == "all":
        return list(S.FIND_COLUMNS)
    if column in S.FIND_COLUMNS:
        return [column]
    raise ValueError(f'Column "{column}" is not searchable')


def hit(c: str, needle: str, case_sensitive: bool) -> Column:
    return X.cs_contains(c, needle) if case_sensitive else X.ci_contains(c, needle)


def find_counts(df: DataFrame, needle: str, column: str = "all", case_sensitive: bool = False) -> DataFrame:
    """Matching cells and matching rows, one pass (U1 = OR across columns)."""
    if not needle:
        raise ValueError("Search text is required")
    cols = [c for c in find_scope(column) if c in df.columns]
    hits = [hit(c, needle, case_sensitive) for c in cols]
    cells = sum((h.cast("bigint") for h in hits[1:]), hits[0].cast("bigint")) if hits else F.lit(0)
    return df.agg(F.coalesce(F.sum(cells), F.lit(0)).cast("bigint").alias("matches"),
                  F.count_if(X.any_of(hits)).alias("rows"))


def matching_cells(df: DataFrame, needle: str, column: str = "all", case_sensitive: bool = False) -> DataFrame:
    """(id, field, col_pos, value) for every matching cell; NULL never matches."""
    cols = [c for c in find_scope(column) if c in df.columns]
    pos = {c: i for i, c in enumerate(S.FIND_COLUMNS)}
    rows = df.filter(X.any_of([hit(c, needle, case_sensitive) for c in cols]))
    stacked = rows.select("id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.lit(pos[c]).alias("col_pos"), F.col(c).cast("string").alias("value"))
        for c in cols])).alias("cell")).select("id", "cell.*")
    return stacked.filter(hit("value", needle, case_sensitive))


def find_match_numbers(df: DataFrame, needle: str, column: str = "all", case_sensitive: bool = False) -> DataFrame:
    """W1: 'match i of n' -- matching cells numbered by row order (id) then
    column order, with n on every row. Numbering is distributed (see
    ordering.global_positions); n is the sum of partition counts."""
    cells = matching_cells(df, needle, column, case_sensitive).select("id", "field", "col_pos")
    return global_positions(cells, [F.col("id"), F.col("col_pos")], ["id", "col_pos"], name="match_no",
                            total_col="n_matches")


def find_next(df: DataFrame, needle: str, column: str = "all", case_sensitive: bool = False) -> DataFrame:
    """Every match with its number and the next match, wrapping from the last to the first.
    The order of W1 is read through once; nothing is joined by number."""
    cells = matching_cells(df, needle, column, case_sensitive).select("id", "field", "col_pos")
    return (with_next(cells, [F.col("id"), F.col("col_pos")], ["id", "col_pos"], {"id": "next_id", "field": "next_field"},
                      name="match_no", total_col="n_matches", next_name="next_no")
            .select("id", "field", "match_no", "n_matches", "next_no", "next_id", "next_field"))


def replaced(c: Column, needle: str, replacement: str, case_sensitive: bool) -> Column:
    """Literal replace of every occurrence; case-insensitive uses a quoted regex
    and a quoted replacement, so neither is read as a pattern."""
    if case_sensitive:
        return F.replace(c, F.lit(needle), F.lit(replacement))
    return F.regexp_replace(c, F.lit("(?iu)" + X.quote_regex(needle)), F.lit(X.quote_replacement(replacement)))


def replace_edits(df: DataFrame, needle: str, replacement: str, column: str = "all",
                  case_sensitive: bool = False) -> DataFrame:
    """M3/M4: edits (id, field, old_value, new_value) of a replace-all in
    scope; a cell whose text does not change is not an edit."""
    if not needle:
        raise ValueError("Search text is required")
    cells = matching_cells(df, needle, column, case_sensitive)
    out = cells.select("id", "field", F.col("value").alias("old_value"),
                       replaced(F.col("value"), needle, replacement, case_sensitive).alias("new_value"))
    return out.filter(F.col("old_value") != F.col("new_value"))


def replace_current(df: DataFrame, needle: str, replacement: str, match_no: int = 1,
                    column: str = "all", case_sensitive: bool = False) -> DataFrame:
    """M4: replace in one matching cell -- the `match_no`-th in find order
    (row, then column). The cell is located by a bounded top-k on the
    matching cells, not by numbering them all."""
    cells = matching_cells(df, needle, column, case_sensitive)
    cell = cells.orderBy("id", "col_pos").offset(match_no - 1).limit(1)
    out = cell.select("id", "field", F.col("value").alias("old_value"),
                      replaced(F.col("value"), needle, replacement, case_sensitive).alias("new_value"))
    return out.filter(F.col("old_value") != F.col("new_value"))


def replace_counts(edits: DataFrame) -> DataFrame:
    """Replaced cells and rows."""
    return edits.agg(F.count(F.lit(1)).alias("replaced"), F.count_distinct("id").alias("rows"))
