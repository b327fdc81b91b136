"""Broadcasts of measured size."""

from pyspark.sql import functions as F

from matchdesk.operators import joins as J


def test_bytes_follow_the_texts(spark):
    df = spark.createDataFrame([(1, "x" * 100, {"a": "b" * 50}), (2, None, None)], "id long, t string, m map<string,string>")
    n = J.bytes_of(df)
    assert 150 < n < 300 and J.bytes_of(df.withColumn("t", F.repeat("t", 100))) > 10_000
    assert J.bytes_of(df.limit(0)) == 0


def test_broadcast_only_under_the_limit(spark):
    big, small = spark.range(10_000), spark.range(100).withColumn("text", F.repeat(F.lit("y"), 50))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(big.join(J.small_side(small), "id"))
    assert "strategy=broadcast" not in plan(big.join(J.small_side(small, limit=1000), "id"))
    assert "strategy=broadcast" in plan(big.join(J.small_side(small, source=small.select("id").limit(1), limit=1000), "id"))


def test_rows_are_the_same_either_way(spark, monkeypatch):
    table = spark.range(100).withColumn("v", F.col("id") % 7)
    keys = spark.createDataFrame([(3,), (3,), (50,), (500,)], "id long")
    results = []
    for limit in (J.BROADCAST_BYTES, -1):
        monkeypatch.setattr(J.small_side, "__defaults__", (None, limit))
        results.append((sorted(r.id for r in J.semi_join(table, keys, "id").collect()),
                        sorted(r.id for r in J.known_keys(keys, table, "id").collect())))
    assert results[0] == results[1] == ([3, 50], [3, 50])


def test_filter_keeps_every_match_and_few_others(spark):
    table = spark.range(100_000).selectExpr("id", "case when id % 3 = 0 then null else cast(id as string) end as t")
    keys = spark.createDataFrame([(5, "5"), (5, "5"), (3, None), (99_998, "99998"), (-1, "x"), (None, None)], "id long, t string")
    for on, want in (("id", {3, 5, 99_998}), ("t", {5, 99_998}), (["id", "t"], {5, 99_998})):
        near = {r.id for r in J.may_match(table, keys, on).collect()}
        far = {r.id for r in J.cannot_match(table, keys, on).collect()}
        assert want <= near and len(near) < 50_000 and len(far) + len(near) == 100_000 and not near & far
    plan = J.may_match(table, keys, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    assert len(J.may_match(table, keys.selectExpr("cast(id as int) as id"), "id").collect()) == 100_000  # hashes would differ


def test_long_lists_shuffle_only_rows_that_may_match(spark, monkeypatch):
    """A list above the limit: the big table is narrowed first; rows stay the same, repeats and nulls too."""
    from matchdesk import schema as S
    from matchdesk.operators import edits as E
    from matchdesk.operators import save as SV
    fields = [f"cast(id as {'int' if f in S.FLAG_FIELDS else 'string'}) as {f}" for f in S.EDITABLE_FIELDS]
    table = spark.range(2000).selectExpr("nullif(id % 1500, 7) as id", "cast(id as string) as canvas_id", "'s' as canvas_ssn", *fields)
    edits = spark.createDataFrame([(1, 3, "memo", "a"), (2, 3, "memo", "b"), (3, 1600, "memo", "no row"), (4, None, "memo", "x"),
                                   (5, 9, "jib", None)], "seq long, id long, field string, new_value string")
    got = []
    for limit in (J.BROADCAST_BYTES, -1):
        monkeypatch.setattr(J, "BROADCAST_BYTES", limit)
        last = E.last_values(edits, ["id", "field"])
        out = [E.overlay(table, last, edits), SV.save_by_id(table, last, edits), E.compact(edits, table), E.rows_of(edits, table),
               SV.save_by_key(table, edits)]
        got.append([sorted(map(str, df.collect())) for df in out])
        plan = out[0]._jdf.queryExecution().optimizedPlan().toString()
    assert got[0] == got[1] and len(got[0][0]) == 2000
    assert "LeftSemi" in plan and "LeftAnti" in plan


def test_key_merge_above_the_limit_does_not_shuffle_the_table(spark, monkeypatch):
    """Change maps too large for a broadcast: joined by groups of buckets and stored. The same rows as by one
    broadcast, with a hot key, null keys, repeated rows, and keys of no row; no changes give no rows."""
    from matchdesk import schema as S
    from matchdesk.operators import save as SV
    fields = [f"cast(id as {'int' if f in S.FLAG_FIELDS else 'string'}) as {f}" for f in S.EDITABLE_FIELDS]
    table = spark.range(3000).selectExpr("id % 2500 as id", "if(id % 3 = 0, 'hot', nullif(cast(id % 400 as string), '7')) as canvas_id",
                                         "if(id % 3 = 0, 'hot', nullif(cast(id % 400 as string), '8')) as canvas_ssn", *fields)
    changes = spark.createDataFrame(
        [("hot", "hot", "memo", "h"), ("hot", "hot", "jib", "1"), (None, "7", "memo", "x"), ("8", None, "memo", "x"), ("no", "row", "memo", "x"),
         *[(str(k), str(k), "memo", None if k == 20 else f"m{k}") for k in range(10, 60)]],
        "canvas_id string, canvas_ssn string, field string, new_value string")
    want = SV.merge_by_key(table, changes)
    assert "Join" in want._jdf.queryExecution().optimizedPlan().toString() and want.filter("memo = 'h'").count() == 1000
    for limit in (2000, 300):  # some buckets a group, or buckets larger than it
        monkeypatch.setattr(J, "BROADCAST_BYTES", limit)
        got = SV.merge_by_key(table, changes)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    monkeypatch.setattr(J, "BROADCAST_BYTES", -1)
    assert SV.merge_by_key(table, changes.limit(0)).collect() == []
