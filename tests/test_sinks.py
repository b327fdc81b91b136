"""Text sinks and the unmatched-key report."""

import datetime as dt
import json
import os
import tempfile

from pyspark.sql import functions as F

from matchdesk import schema as S
from matchdesk.operators import edits as E
from matchdesk.operators import save as SV
from matchdesk.sources import inputs as IN
from matchdesk.sources import sinks
from tests.conftest import SF_SMALL


def test_csv_export_has_labels_and_blanks(spark, m_small):
    folder = tempfile.mkdtemp(prefix="matchdesk-export-", dir="/tmp")
    path = sinks.write_csv(m_small, folder, day=dt.date(2024, 5, 6))
    assert path.endswith("matches_export_2024-05-06.csv")
    back = spark.read.option("header", True).csv(path)
    assert back.columns == [label for _, label, vis in S.GRID_COLUMNS if vis]
    assert back.count() == m_small.count()
    assert back.filter(F.col("SSN") == "100").count() == m_small.filter("ssn_match = 100").count()


def test_selected_export(spark, m_small):
    folder = tempfile.mkdtemp(prefix="matchdesk-export-", dir="/tmp")
    ids = m_small.select("id").orderBy("id").limit(4)
    path = sinks.write_selected_csv(m_small, ids, folder)
    assert os.path.basename(path).startswith("selected_export_")
    assert spark.read.option("header", True).csv(path).count() == 4


def test_json_records_keep_nulls(spark, m_small):
    rec = sinks.json_records(m_small).filter(F.col("record").contains('"memo":null')).first()
    assert rec is not None
    d = json.loads(rec.record)
    assert "memo" in d and d["memo"] is None and set(d) == {c for c in S.SHIPPED_COLUMNS if c in m_small.columns}


def test_unmatched_keys_reported(spark, m_small):
    p = E.compact(IN.edits(spark, SF_SMALL), m_small, with_key=True)
    assert SV.unmatched_keys(p, m_small).count() == 0
    ghost = p.limit(2).withColumn("canvas_ssn", F.lit(None).cast("string"))
    assert SV.unmatched_keys(p.unionByName(ghost), m_small).count() == 1


def test_replace_current_is_first_match(spark, m_mid):
    from matchdesk.operators import search as SR
    first = SR.find_match_numbers(m_mid, "a.b").filter("match_no = 1").first()
    one = SR.replace_current(m_mid, "a.b", "X").collect()
    assert len(one) == 1 and (one[0].id, one[0].field) == (first.id, first.field)


def test_visible_columns_toggles(spark, m_small):
    from matchdesk.operators import view as V
    default = V.visible_columns()
    assert default[0] == "ssn_match" and "memo" not in default
    assert V.visible_columns(all_on=False) == []
    cols = V.visible_columns({"memo": True, "ssn_match": False})
    assert "memo" in cols and "ssn_match" not in cols
    out = V.export_columns(m_small, V.visible_columns(all_on=True))
    absent = [c for c, _, _ in S.GRID_COLUMNS if c.endswith("_detail")]  # optional, not in this table
    assert len(out.columns) == len(S.GRID_COLUMNS) - len(absent) and "UID" in out.columns
