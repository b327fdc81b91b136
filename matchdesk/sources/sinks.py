"""Text sinks: CSV export of a view (S13/S14) and JSON records.

Both write distributed part files into one output folder named with the
export date, like the reference's `matches_export_<yyyy-mm-dd>.csv`; nothing
is collected to the driver.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchdesk.operators import view as V


def dated_name(prefix: str, day: _dt.date | None = None) -> str:
    return f"{prefix}_{(day or _dt.date.today()).isoformat()}"


def write_csv(rows: DataFrame, folder: str, prefix: str = "matches_export", visible: list[str] | None = None,
              day: _dt.date | None = None) -> str:
    """The visible columns of `rows` under their header labels, NULL as ''."""
    path = f"{folder.rstrip('/')}/{dated_name(prefix, day)}.csv"
    (V.export_columns(rows, visible).write.mode("errorifexists")
     .option("header", True).option("emptyValue", "").csv(path))
    return path


def write_selected_csv(rows: DataFrame, selected_ids: DataFrame, folder: str, **kw) -> str:
    """Export of the selected rows only (semi join on id)."""
    from matchdesk.operators.joins import semi_join
    chosen = semi_join(rows, selected_ids.select("id").distinct(), "id")
    return write_csv(chosen, folder, prefix="selected_export", **kw)


def json_records(rows: DataFrame) -> DataFrame:
    """One JSON object per row with every shipped column, NULLs kept as keys."""
    shipped = V.shipped(rows)
    return shipped.select("id", F.to_json(F.struct(*shipped.columns),
                                          {"ignoreNullFields": "false"}).alias("record"))


def write_json(rows: DataFrame, path: str) -> str:
    """S15 as files: JSON lines with NULLs kept."""
    V.shipped(rows).write.mode("errorifexists").option("ignoreNullFields", False).json(path)
    return path
