"""Saves, their logs, the edit feed, stored inputs, cache and row ids."""

import datetime as dt
import glob
import os
import shutil
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from matchdesk.operators import edits as E
from matchdesk.operators import save as SV
from matchdesk.sources import cache as CA
from matchdesk.sources import fixtures as FX
from matchdesk.sources import inputs as IN
from matchdesk.sources import load as L
from matchdesk.sources.review_table import LAYOUT, ReviewTable, bucket_groups, recent
from matchdesk.sources.row_ids import import_ids
from matchdesk.streaming.edit_feed import EditFeed
from tests.conftest import SF_MID, SF_SMALL

SCHEMA = "seq long, id long, field string, new_value string, edited_at timestamp_ntz"
TS = dt.datetime(2024, 1, 1)


def _root():
    return tempfile.mkdtemp(prefix="matchdesk-test-", dir="/tmp")


def _same(got, want):
    return got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


# ---- save ------------------------------------------------------------------

def test_save_twice(spark, m_small):
    t = ReviewTable.create(spark, _root(), m_small)
    assert t.audit().count() == t.rejects().count() == 0
    ed = IN.edits(spark, SF_SMALL)
    t.save(ed.filter(F.col("seq") % 2 == 0), "a", dt.datetime(2024, 3, 1, 9))
    t.save(ed.filter(F.col("seq") % 2 == 1), "b", dt.datetime(2024, 3, 2, 9))
    assert t.snapshot().count() == m_small.count()
    audit = t.audit()
    assert {r.save for r in audit.select("save").distinct().collect()} == {"a", "b"}
    assert {r.updated_date.isoformat() for r in audit.select("updated_date").distinct().collect()} == {"2024-03-01", "2024-03-02"}
    top = recent(audit, 5).collect()
    assert all(r.updated_at == dt.datetime(2024, 3, 2, 9) for r in top)
    assert [r.id for r in top] == sorted((r.id for r in audit.filter("save = 'b'").collect()), reverse=True)[:5]


@pytest.mark.parametrize("by", ["id", "key"])
def test_only_touched_buckets_are_written(spark, m_mid, by):
    root = _root()
    t = ReviewTable.create(spark, root, m_mid, buckets=32)
    files = lambda: {f: open(f, "rb").read() for f in glob.glob(f"{root}/matches/of=32/*/*.parquet")}
    before = files()
    rid = m_mid.agg(F.max("id")).first()[0]
    row = m_mid.filter(F.col("id") == rid).first()
    edit = spark.createDataFrame([(1, rid, "memo", "changed", TS)], SCHEMA)
    out = t.save(edit, "one", dt.datetime(2024, 3, 1), by)
    same_key = m_mid.filter((F.col("canvas_id") == row.canvas_id) & (F.col("canvas_ssn") == row.canvas_ssn)).count()
    assert out == {"affected": 1 if by == "id" else same_key, "buckets": 1} and same_key > 1
    after = files()
    kept = set(before) & set(after)
    assert all(before[f] == after[f] for f in kept)
    assert {f.split("/bucket=")[1].split("/")[0] for f in set(before) ^ set(after)} == \
        {f.split("/bucket=")[1].split("/")[0] for f in after if f not in before} and len(set(before) - kept) == 1
    assert t.snapshot().filter("memo = 'changed'").count() == out["affected"]
    assert t.snapshot().count() == m_mid.count()


@pytest.mark.parametrize("by", ["id", "key"])
@pytest.mark.parametrize("limit", [64 << 20, 20_000, 100])
def test_buckets_are_merged_in_groups(spark, m_small, monkeypatch, by, limit):
    """One group, several, or buckets too large for a broadcast: the same table and counts; only the last shuffles rows."""
    from matchdesk.operators import joins as J
    monkeypatch.setattr(J, "BROADCAST_BYTES", limit)
    t = ReviewTable.create(spark, _root(), m_small, buckets=5)
    ed = IN.edits(spark, SF_SMALL)
    out = t.save(ed, "g", dt.datetime(2024, 3, 1), by)
    want = E.last_values(ed, ["id", "field"])
    monkeypatch.setattr(J, "BROADCAST_BYTES", 64 << 20)
    if by == "id":
        assert _same(t.snapshot(), E.overlay(m_small, want)) and out["affected"] == want.select("id").distinct().count()
    else:
        changed = SV.save_by_key(m_small, ed)
        assert changed.exceptAll(t.snapshot().select(*changed.columns)).count() == 0 and out["affected"] == changed.count()
    assert out["buckets"] == 5 and t.snapshot().count() == m_small.count()


@pytest.mark.parametrize("sort", [250_000, 3])
def test_layout_is_written_by_the_scanning_tasks(spark, m_small, monkeypatch, sort):
    """No shuffle: a hot key stays with the tasks that hold it. In one pass or one per bucket, the same table."""
    from matchdesk.sources import tables
    monkeypatch.setattr(tables, "ROWS_PER_SORT", sort)
    hot = m_small.limit(1).drop("id").crossJoin(spark.range(1000, numPartitions=4)).select(*m_small.columns)
    stored = f"{_root()}/table"
    m_small.unionByName(hot).write.parquet(stored)
    table = spark.read.parquet(stored)
    t = ReviewTable.create(spark, _root(), table, buckets=5)
    assert _same(t.snapshot(), table)
    laid = spark.read.parquet(f"{t.root}/matches")
    assert laid.filter("`of` <> 5 or bucket <> pmod(hash(canvas_id, canvas_ssn), 5)").count() == 0
    key = hot.first()
    files = laid.filter((F.col("canvas_id") == key.canvas_id) & (F.col("canvas_ssn") == key.canvas_ssn)).select(F.input_file_name())
    assert files.distinct().count() > 1


def test_a_save_does_not_sort_its_rows(spark, m_small, monkeypatch):
    """Buckets are merged with their files open side by side (a sort by bucket spills wide rows); the setting is put back."""
    from matchdesk.sources.tables import OPEN_FILES
    t = ReviewTable.create(spark, _root(), m_small, buckets=5)
    seen, apply_changes = [], E.apply_changes
    monkeypatch.setattr(E, "apply_changes", lambda df: (seen.append(int(spark.conf.get(OPEN_FILES))), apply_changes(df))[1])
    before = spark.conf.get(OPEN_FILES)
    t.save(IN.edits(spark, SF_SMALL), "open", dt.datetime(2024, 3, 1))
    assert seen and min(seen) > 5 and spark.conf.get(OPEN_FILES) == before


def test_bucket_groups():
    assert bucket_groups([], 10) == []
    assert bucket_groups([(0, 4), (1, 6), (2, 1), (3, 11), (4, 3), (7, 7)], 10) == [([0, 1], True), ([2], True), ([3], False), ([4, 7], True)]


def test_interrupted_save_is_run_again(spark, m_small):
    """Cut off between log and rows, or between rows and return: the same log, the same table."""
    t = ReviewTable.create(spark, _root(), m_small)
    ed, at = IN.edits(spark, SF_SMALL), dt.datetime(2024, 3, 1)
    apply, t.apply = t.apply, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        t.save(ed, "s", at)
    assert _same(t.snapshot(), m_small)
    log = sorted(map(tuple, t.audit().collect()), key=str)
    t.apply = apply
    t.save(ed, "s", at)
    once = t.snapshot().collect()
    t.save(ed, "s", at)  # and once more
    assert sorted(map(str, t.snapshot().collect())) == sorted(map(str, once))
    assert sorted(map(tuple, t.audit().collect()), key=str) == log
    assert _same(t.snapshot(), E.overlay(m_small, E.last_values(ed, ["id", "field"])))


def test_null_keys_match_no_row(spark, m_small):
    keyed = spark.createDataFrame([(None, "1", "memo", "x"), ("1", None, "memo", "x"), ("no", "such", "memo", "x")],
                                  "canvas_id string, canvas_ssn string, field string, new_value string")
    null_row = m_small.limit(1).withColumn("canvas_ssn", F.lit(None).cast("string"))
    table = m_small.unionByName(null_row)
    assert SV.unmatched_keys(keyed, table).count() == 3
    assert SV.merge_by_key(table, keyed).count() == 0
    assert tuple(SV.key_counts(table, keyed).first()) == (3, 3, 0)


BAD = [(1, "dec_name", "HACK", "unknown_field"), (2, "jib", "abc", "bad_value"), (3, "jib", "1.7", "bad_value"),
       (4, "jib", None, "bad_value")]


def _edits(spark, rid):
    rows = [(q, rid, f, v, TS) for q, f, v, _ in BAD] + [(5, -1, "memo", "lost", TS), (6, rid, "jib", " 1 ", TS), (7, rid, "memo", None, TS)]
    return spark.createDataFrame(rows, SCHEMA)


def test_save_refuses_bad_edits(spark, m_small):
    t = ReviewTable.create(spark, _root(), m_small)
    rid = m_small.agg(F.min("id")).first()[0]
    before = m_small.filter(F.col("id") == rid).first()
    assert t.save(_edits(spark, rid), "s", dt.datetime(2024, 3, 1))["affected"] == 1
    row = t.snapshot().filter(F.col("id") == rid).first()
    assert (row.dec_name, row.jib, row.memo) == (before.dec_name, 1, None)
    assert {(r.field_name, r.new_value) for r in t.audit().collect()} == {("jib", "1"), ("memo", None)}
    refused = {(r.seq, r.status, r.new_value) for r in t.rejects().collect()}
    assert refused == {(q, s, v) for q, _, v, s in BAD} | {(5, "unknown_id", "lost")}


def test_recent_reads_the_newest_days_only(spark):
    log = IN.audit_log(spark, SF_MID)
    plan = recent(log, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(updated_date" in plan and "Join" not in plan
    assert recent(log.filter("false"), 10).count() == 0
    assert recent(log, 10 ** 6).count() == log.count()


# ---- edit feed --------------------------------------------------------------

def _feed(spark, base, *batches):
    """A feed that has taken each batch of edit rows in a run of its own."""
    root = _root()
    feed = EditFeed(spark, root, base)
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        EditFeed(spark, root, base).start(f"{root}/in")  # a new run goes on from the checkpoint
    return feed


def test_stream_equals_batch_overlay(spark, m_small):
    root = _root()
    ed = IN.edits(spark, SF_SMALL)
    ed.repartition(3, F.col("seq") % 3).write.parquet(f"{root}/in")
    feed = EditFeed(spark, root, m_small)
    feed.start(f"{root}/in", files_per_batch=1)
    assert _same(feed.current(), E.overlay(m_small, E.last_values(ed, ["id", "field"])))
    assert feed.changes().select("batch").distinct().count() >= 2
    first = feed.changes().collect()
    feed.start(f"{root}/in")  # nothing new: nothing changes
    assert sorted(map(str, feed.changes().collect())) == sorted(map(str, first))


def test_late_edit_loses_after_restart(spark, m_small):
    rid = m_small.agg(F.min("id")).first()[0]
    feed = _feed(spark, m_small, [(20, rid, "memo", "newer", TS)],
                 [(11, rid, "memo", "older", TS), (12, rid, "address_reason", "r", TS)])
    row = feed.current().filter(F.col("id") == rid).first()
    assert (row.memo, row.address_reason) == ("newer", "r")
    assert [(r.field_name, r.new_value) for r in feed.audit().orderBy("batch").collect()] == [("memo", "newer"), ("address_reason", "r")]


def test_feed_refuses_and_logs(spark, m_small):
    rid = m_small.agg(F.min("id")).first()[0]
    base = m_small.filter(F.col("id") == rid).first()
    bad = [tuple(r) for r in _edits(spark, rid).collect()]
    feed = _feed(spark, m_small, bad, [(20, rid, "jib", "x", TS), (21, rid, "jib", "0", TS), (22, rid, "memo", "new", TS)])
    assert sorted((r.seq, r.status) for r in feed.rejects().collect()) == [(q, s) for q, _, _, s in BAD] + [(20, "bad_value")]
    assert [(r.id, r.new_value) for r in feed.unknown_rows().collect()] == [(-1, "lost")]
    got = sorted((r.batch, r.field_name, str(r.old_value), str(r.new_value)) for r in feed.audit().collect())
    assert got == sorted([(0, "jib", str(base.jib), "1"), (0, "memo", str(base.memo), "None"), (1, "jib", "1", "0"), (1, "memo", "None", "new")])
    row = feed.current().filter(F.col("id") == rid).first()
    assert (row.jib, row.memo) == (0, "new")


def test_feed_state_is_in_rocksdb(spark, m_small):
    rid = m_small.agg(F.min("id")).first()[0]
    feed = _feed(spark, m_small, [(1, rid, "memo", "a", TS)])
    assert glob.glob(f"{feed.root}/checkpoint/state/0/*/*.zip")
    assert [tuple(r) for r in feed.last_values().collect()] == [(rid, "memo", 1, "a")]


def test_feed_with_processing_time_trigger(spark, m_small):
    root = _root()
    IN.edits(spark, SF_SMALL).write.parquet(f"{root}/in")
    feed = EditFeed(spark, root, m_small)
    queries = feed.start(f"{root}/in", processing_time="1 second")
    try:
        for q in queries:
            q.processAllAvailable()
    finally:
        for q in queries:
            q.stop()
    assert feed.current().count() == m_small.count() and feed.changes().count() > 0


# ---- inputs, cache, ids, catalog ---------------------------------------------

def test_stored_inputs_follow_the_data(spark, tmp_path):
    for t in IN.SOURCES:
        shutil.copyfile(f"{SF_SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    first = IN.raw_matches(spark, str(tmp_path)).count()
    assert IN.raw_matches(spark, str(tmp_path)).count() == first > 0
    half = spark.read.parquet(f"{SF_SMALL}/customer.parquet").filter("c_custkey % 2 = 0").toPandas()
    half.to_parquet(tmp_path / "customer.parquet")
    assert 0 < IN.raw_matches(spark, str(tmp_path)).count() < first


def test_match_rows_are_sorted_before_they_are_wide(spark):
    plan = FX.raw_matches(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan()
    sort = next(n for n in (plan.apply(i) for i in range(30)) if n.nodeName() == "Sort")
    assert sort.output().size() <= 15 < plan.output().size()
    stored = IN.matches(spark, SF_SMALL).select("recommendation", F.input_file_name().alias("file")).collect()
    runs = sum(a != b for a, b in zip(stored, stored[1:]))
    raw_files = IN.raw_matches(spark, SF_SMALL).select(F.input_file_name()).distinct().count()
    assert runs < 7 * raw_files  # clustered: six values at most in a raw file


def test_row_ids_are_unique(m_mid):
    assert m_mid.select("id").distinct().count() == m_mid.count()


def test_cached_snapshot_changes_on_reload_only(spark, m_small):
    t = ReviewTable.create(spark, _root(), m_small)
    cached = CA.open_cached(spark, "reload_test", f"{t.root}/matches", LAYOUT)
    assert "In-memory table" in cached._jdf.queryExecution().executedPlan().toString()
    assert cached.filter("memo = 'other writer'").count() == 0
    rid = m_small.agg(F.min("id")).first()[0]
    for f in glob.glob(f"{t.root}/matches/*/*/*.parquet"):  # a writer that is not this session
        part = pq.read_table(f, partitioning=None).to_pandas()
        if rid in set(part["id"]):
            part.loc[part["id"] == rid, "memo"] = "other writer"
            pq.write_table(pa.Table.from_pandas(part, schema=pq.read_schema(f), preserve_index=False), f.replace("part-", "part-again-"))
            os.remove(f)
    assert CA.open_cached(spark, "reload_test", f"{t.root}/matches", LAYOUT).filter("memo = 'other writer'").count() == 0
    again = CA.reload(spark, "reload_test")
    assert again.filter("memo = 'other writer'").count() == 1
    assert "In-memory table" in again._jdf.queryExecution().executedPlan().toString()
    CA.close(spark, "reload_test")


def test_ids_do_not_depend_on_partitions_or_repeats(spark):
    rows = [("b", 1), ("a", 1), (None, 2), ("a", 1), ("c", 5), ("a", 7)]
    table = spark.createDataFrame(rows, "k string, v int")
    maps = []
    for n in (1, 5):
        path = _root() + "/ids"
        first = {(r.k, r.v, r.id) for r in import_ids(table.repartition(n), path, ["k"]).collect()}
        more = table.unionByName(spark.createDataFrame([("a", 9), ("0", 1)], "k string, v int"))
        import_ids(more.repartition(3), path, ["k"]).count()
        later = {r.id for r in spark.read.parquet(path).collect()}
        assert later == set(range(1, 9))
        maps.append(sorted(first, key=str))
    assert maps[0] == maps[1] and sorted(i for _, _, i in first) == [1, 2, 3, 4, 5, 6]


def test_normalize_wants_an_id(spark):
    with pytest.raises(ValueError, match="no column id"):
        L.normalize(spark.createDataFrame([("x",)], "canvas_id string"))


def test_catalog_table_evolves_in_place(spark):
    path = _root() + "/t"
    spark.createDataFrame([(1, "x", 5)], "id long, MEMO string, jib int").write.option("path", path).saveAsTable("evolve_test")
    files = glob.glob(f"{path}/*.parquet")
    assert L.evolve_table(spark, "evolve_test", "evolve_log") == ["rev", "vendor", "how_to_process"]
    assert glob.glob(f"{path}/*.parquet") == files
    row = spark.table("evolve_test").first()
    assert (row.jib, row.rev, row.vendor, row.how_to_process) == (5, 0, 0, "")
    assert spark.table("evolve_log").count() == 0 and "updated_date" in spark.table("evolve_log").columns
    assert L.evolve_table(spark, "evolve_test", "evolve_log") == []
    spark.sql("drop table evolve_test")
    spark.sql("drop table evolve_log")


def test_csv_rows_and_rejects(spark):
    path = _root()
    with open(f"{path}/part.csv", "w") as f:
        f.write("ID,HDRCODE,NAME_SCORE\n1,H1,40\nx,H2,1\n3,H3\n4,H4,1,more\n,H5,2\n6,H6,bad\n")
    rows, rejects = L.load_csv(spark, f"{path}/part.csv")
    assert [(r.id, r.dec_hdrcode, r.name_score) for r in rows.orderBy("id").collect()] == [(1, "H1", 40.0), (6, "H6", None)]
    assert {r.line for r in rejects.collect()} == {"x,H2,1", "3,H3", "4,H4,1,more", ",H5,2"}
