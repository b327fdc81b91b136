"""Relations the reference's own tests assert, checked on the sf0.01 fixture."""

from pyspark.sql import functions as F

from matchdesk.operators import edits as E
from matchdesk.operators import search as SR
from matchdesk.operators import stats as ST
from matchdesk.operators import view as V
from matchdesk.sources import inputs as IN
from tests.conftest import SF_MID


def _n(df):
    return df.count()


def test_filtered_le_total(m_mid):
    f = V.ViewFilter(recommendations="NEEDS REVIEW", ssn="partial", min_addr=20)
    r = ST.view_counts(m_mid, V.view_predicate(m_mid, f)).first()
    assert r.records_filtered <= r.records_total == _n(m_mid)
    assert r.records_filtered == _n(V.view(m_mid, f))


def test_combined_le_single(m_mid):
    rec = _n(V.view(m_mid, V.ViewFilter(recommendations="NEEDS REVIEW")))
    ssn = _n(V.view(m_mid, V.ViewFilter(ssn="yes")))
    both = _n(V.view(m_mid, V.ViewFilter(recommendations="NEEDS REVIEW", ssn="yes")))
    assert both <= min(rec, ssn)


def test_scores_in_range(m_mid):
    f = V.ViewFilter(min_name=40, max_name=80, min_addr=50, max_addr=90)
    r = V.view(m_mid, f).agg(F.min("name_score"), F.max("name_score"),
                             F.min("address_score"), F.max("address_score"),
                             F.count_if(F.col("name_score").isNull())).first()
    assert 40 <= r[0] and r[1] <= 80 and 50 <= r[2] and r[3] <= 90 and r[4] == 0


def test_ssn_known_counts(m_mid):
    s = ST.summary(m_mid).first()
    assert (s.ssn_perfect_matches, s.ssn_no_match, s.ssn_partial_matches) == (8440, 16879, 15898)


def test_page_counts_and_lengths(m_mid):
    """Any start and length of a view with its counts against the view itself."""
    f, sort = V.ViewFilter(recommendations="NEEDS REVIEW", min_name=90), ("canvas_name", "asc")
    v = V.view(m_mid, f)
    want = [r.id for r in v.orderBy(*V.sort_keys(*sort)).collect()]
    counts = (_n(m_mid), len(want))
    for start, length in ((0, 25), (30, 7), (0, -1), (len(want) - 3, 25), (5, -1), (len(want) + 5, -1), (len(want) + 5, 10)):
        got = V.page_with_counts(m_mid, f, start, length, sort).collect()
        assert [r.id for r in got] == (want[start:] if length < 0 else want[start:start + length])
        assert {(r.records_total, r.records_filtered) for r in got} <= {counts}
        assert [r.id for r in V.page(v, start, length, sort).collect()] == [r.id for r in got]


def test_recommendation_counts_match_stats(m_mid):
    rc = {r.recommendation: r.n for r in ST.recommendation_counts(m_mid).collect()}
    assert rc == {"EXISTING BA ADD NEW ADDRESS": 6608, "EXISTING BA AND EXISTING ADDRESS": 6630,
                  "NEEDS REVIEW": 12956, "NEW BA AND NEW ADDRESS": 6545, "PROCESSED": 6548}
    nulls = m_mid.filter(F.col("recommendation").isNull()).count()
    assert sum(rc.values()) + nulls == _n(m_mid)


def test_case_sensitive_le_insensitive(m_mid):
    ci = SR.find_counts(m_mid, "a.b").first()
    cs = SR.find_counts(m_mid, "a.b", case_sensitive=True).first()
    assert cs.matches <= ci.matches and cs.rows <= ci.rows
    assert cs.matches > 0


def test_one_column_le_all(m_mid):
    one = SR.find_counts(m_mid, "st", column="canvas_address").first()
    allc = SR.find_counts(m_mid, "st").first()
    assert one.matches <= allc.matches and one.rows <= allc.rows


def test_find_rejects_unknown_column(m_mid):
    import pytest
    with pytest.raises(ValueError):
        SR.find_counts(m_mid, "x", column="dec_name")


def test_literal_needle_is_not_a_regex(m_mid):
    hits = SR.matching_cells(m_mid, "a.b").filter(F.lower("value").contains("axb")
                                                  & ~F.lower("value").contains("a.b")).count()
    assert hits == 0


def test_find_next_wraps(m_mid):
    nxt = SR.find_next(m_mid, "a.b")
    rows = {r.match_no: r for r in nxt.collect()}
    n = len(rows)
    assert rows[n].next_no == 1
    assert all(rows[i].next_no == i + 1 for i in range(1, n))


def test_find_next_follows_the_order(m_mid):
    nums = {r.match_no: (r.id, r.field) for r in SR.find_match_numbers(m_mid, "a.b").collect()}
    assert nums == {r.match_no: (r.id, r.field) for r in SR.find_next(m_mid, "a.b").collect()}
    assert all((r.next_id, r.next_field) == nums[r.next_no] for r in SR.find_next(m_mid, "a.b").collect())


def test_find_next_of_one_and_none(m_mid):
    one = SR.find_next(m_mid.limit(1).withColumn("memo", F.lit("needle!")), "needle!").collect()
    assert [(r.match_no, r.n_matches, r.next_no) for r in one] == [(1, 1, 1)]
    assert SR.find_next(m_mid, "no such text").count() == 0


def test_match_numbers_dense_and_ordered(m_mid):
    nums = SR.find_match_numbers(m_mid, "st").orderBy("match_no").collect()
    assert [r.match_no for r in nums] == list(range(1, len(nums) + 1))
    keys = [(r.id, r.col_pos) for r in nums]
    assert keys == sorted(keys)


def test_replace_all_then_find_nothing(spark, m_mid):
    ed = SR.replace_edits(m_mid, "a.b", "$1")
    after = E.overlay(m_mid, E.last_values(ed.withColumn("seq", F.lit(1)), ["id", "field"]))
    assert SR.find_counts(after, "a.b").first().matches == 0
    assert after.filter(F.col("memo").startswith("call $1 ")).count() > 0  # "$1" stayed literal


def test_edit_then_read_back(spark, m_mid):
    some = m_mid.select("id").orderBy("id").limit(3)
    ed = some.select("id", F.lit("memo").alias("field"), F.lit("checked").alias("new_value"),
                     F.lit(1).cast("long").alias("seq"))
    after = E.overlay(m_mid, ed)
    got = after.join(some, "id").select("memo").distinct().collect()
    assert [r.memo for r in got] == ["checked"]
    assert after.count() == m_mid.count()


def test_null_new_value_survives_overlay(spark, m_mid):
    one = m_mid.select("id").orderBy("id").limit(1)
    ed = one.select("id", F.lit("memo").alias("field"), F.lit(None).cast("string").alias("new_value"))
    after = E.overlay(m_mid, ed).join(one, "id").first()
    assert after.memo is None


def test_pending_is_first_old_last_new(spark):
    m = IN.matches(spark, SF_MID)
    ed = IN.edits(spark, SF_MID)
    p = E.compact(ed, m)
    assert p.count() == 5833  # (row, field) pairs
    assert E.pending_count(p).first().pending_count == 1500
    dup = ed.groupBy("id", "field").count().filter("count > 1").first()
    last = ed.filter((F.col("id") == dup.id) & (F.col("field") == dup.field)).orderBy(F.desc("seq")).first()
    row = p.filter((F.col("id") == dup.id) & (F.col("field") == dup.field)).first()
    assert row.new_value == last.new_value


def test_import_counts_consistent(spark, m_mid):
    from matchdesk.sources.load import parse_id_list
    ids = parse_id_list(IN.id_file(spark, SF_MID))
    c = E.import_counts(m_mid, ids).first()
    assert c.updated + c.already_set == c.matched
    assert c.updated == E.import_flag(m_mid, ids).count()


def test_bucket_view_partition(spark, m_mid):
    from matchdesk.sources.load import bucket_ranges
    ranges = bucket_ranges(IN.bucket_config(spark))
    inside = V.bucket_rows(m_mid, ranges, True).count()
    outside = V.bucket_rows(m_mid, ranges, False).count()
    buckets = m_mid.filter(F.col("recommendation").isin(
        "NEW BA AND NEW ADDRESS", "EXISTING BA ADD NEW ADDRESS", "EXISTING BA AND EXISTING ADDRESS")).count()
    assert inside + outside == buckets


def test_deep_offset_paths_agree(m_mid):
    for sort in [("canvas_name", "asc"), ("name_score", "desc"), ("id", "asc")]:
        a = V.from_offset(m_mid, 1000, sort)
        b = V.from_offset(m_mid, 1000, sort, topk_limit=10)  # forces global numbering
        assert a.count() == b.count() == m_mid.count() - 1000
        assert a.exceptAll(b).count() == 0
        assert [r.id for r in a.limit(5).collect()] == [r.id for r in b.limit(5).collect()]


def test_deep_page_paths_agree(m_mid):
    for sort in [("name_score", "desc"), ("canvas_name", "asc")]:
        a = [r.id for r in V.page(m_mid, 1234, 25, sort).collect()]
        b = [r.id for r in V.page(m_mid, 1234, 25, sort, topk_limit=10).collect()]
        assert a == b and len(a) == 25
