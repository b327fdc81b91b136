"""Physical-plan properties that matter at scale."""

import itertools

import pytest

from matchdesk.operators import view as V
from matchdesk.plans import catalog as C
from matchdesk.sources import inputs as IN
from tests.conftest import SF_MID


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def snapshot_joined_by_sort(df) -> list[str]:
    """Sort-merge joins of the final plan that have the stored snapshot below them."""
    lines = plan(df).split("== Initial Plan ==")[0].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    out = []
    for k, line in enumerate(lines):
        if "SortMergeJoin" in line:
            below = itertools.takewhile(lambda x: depth(x) > depth(line), lines[k + 1:])
            out += [line for x in below if "FileScan" in x and "/matches]" in x]
    return out


def test_page_is_top_k_with_pushed_filters(spark):
    p = plan(C.review_page(spark, SF_MID))
    assert "TakeOrderedAndProject" in p
    assert "PushedFilters" in p and "In(recommendation" in p and "GreaterThanOrEqual(name_score" in p


def test_score_filters_reach_the_scan(spark):
    p = plan(C.score_range(spark, SF_MID))
    assert "GreaterThanOrEqual(name_score,40.0)" in p and "LessThanOrEqual(address_score,90.0)" in p


def test_scan_prunes_columns(spark):
    p = plan(C.stats_summary(spark, SF_MID))
    scan = [line for line in p.splitlines() if "FileScan parquet" in line][0]
    assert "ReadSchema: struct<ssn_match:double,name_score:double,address_score:double>" in scan


def test_bucket_join_is_broadcast_equi_join(spark):
    p = plan(C.bucket_view(spark, SF_MID))
    assert "BroadcastHashJoin" in p
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_offset_all_has_no_global_limit(spark):
    p = plan(C.page_from_offset_all(spark, SF_MID))
    assert "GlobalLimit" not in p and "CollectLimit" not in p and "SinglePartition" not in p


def test_no_single_partition_numbering(spark):
    p = plan(C.find_match_numbers(spark, SF_MID))
    # the only single-partition step is the per-partition offset table
    assert p.count("SinglePartition") <= 1


def test_search_stays_in_codegen(spark):
    p = plan(V.view(IN.matches(spark, SF_MID), V.ViewFilter(search="a")))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


SNAPSHOT_QUERIES = (C.save_by_key, C.overlay_matches, C.save_by_id, C.pending_changes, C.validate_edits, C.import_flag, C.bulk_rejects,
                    C.bulk_counts, C.record_lookup, C.export_selected, C.form_save_edits, C.audit_recent, C.audit_rows, C.unmatched_keys,
                    C.save_key_counts, C.undo_applied, C.set_process_on_cells, C.toggle_flag_range)


@pytest.fixture
def no_automatic_broadcast(spark):
    """Only broadcasts whose size the library measured."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("q", SNAPSHOT_QUERIES, ids=lambda q: q.__name__)
def test_merges_do_not_shuffle_the_snapshot(spark, no_automatic_broadcast, q):
    df = q(spark, SF_MID)
    df.collect()  # final adaptive plan
    assert snapshot_joined_by_sort(df) == [], plan(df)


def test_feed_and_saved_tables_join_by_broadcast(spark, no_automatic_broadcast):
    feed = C.edit_feed_apply(spark, SF_MID)
    feed.collect()
    p = plan(feed)
    assert "checkpoint/state]" in p and "SortMergeJoin" not in p
    for q in (C.save_rejects, C.save_snapshot_by_id, C.audit_readback, C.save_snapshot_by_key):
        assert "Join" not in plan(q(spark, SF_MID))  # what was saved is read, not computed again


def test_numbering_shuffles_once(spark):
    for q in (C.find_match_numbers, C.find_next):
        df = q(spark, SF_MID)
        p = plan(df)
        assert "Exchange" not in p.replace("BroadcastExchange", "") and "Window" not in p and "SortMergeJoin" not in p, p
