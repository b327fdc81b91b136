"""Loading and normalizing (S2-S9) on small hand-made inputs."""

from matchdesk.sources import load as L


def test_flag_coercion_probe(spark):
    df = spark.createDataFrame([(1, v) for v in ["1", " 7 ", "abc", None, "1.7", ""]], "ID long, JIB string")
    out = L.normalize(df).orderBy("id").collect()
    assert [r.jib for r in L.normalize(df).collect()] == [1, 7, 0, 0, 1, 0]
    assert set(out[0].asDict()) >= {"id", "jib", "rev", "vendor", "how_to_process", "memo"}


def test_scores_bad_text_and_nan_to_null(spark):
    df = spark.createDataFrame([(1, "n/a"), (2, "NaN"), (3, "42"), (4, None)], "id long, name_score string")
    got = [r.name_score for r in L.normalize(df).orderBy("id").collect()]
    assert got == [None, None, 42.0, None]


def test_master_layout(spark):
    df = spark.createDataFrame([(7, "H7", "123", "ACME")], "id long, hdrcode string, ssn string, hdrname string")
    r = L.normalize(df).first().asDict()
    assert r["dec_hdrcode"] == "H7" and r["canvas_ssn"] == "123" and r["dec_name"] == "ACME"
    assert r["canvas_id"] == "" and r["ssn_match"] == 0.0 and r["recommendation"] == ""


def test_no_layout_change_when_canvas_id_present(spark):
    df = spark.createDataFrame([(1, "H", "C")], "id long, hdrcode string, canvas_id string")
    assert "hdrcode" in L.normalize(df).columns


def test_id_list_parse(spark):
    lines = spark.createDataFrame([(" 12 ",), ("13,14,,",), ("\t15\r",), ("",)], "value string")
    assert [r.canvas_id for r in L.parse_id_list(lines).collect()] == ["12", "13", "14", "15"]


def test_evolve_schema_adds_only_missing(spark):
    df = spark.createDataFrame([(1, "x")], "id long, memo string")
    out = L.evolve_schema(df)
    assert out.columns == ["id", "memo", "jib", "rev", "vendor", "how_to_process"]
    assert out.first().memo == "x"


def test_bucket_ranges_blank_bound_is_open(spark):
    from matchdesk.sources.fixtures import bucket_config
    rows = {r.recommendation: r for r in L.bucket_ranges(bucket_config(spark)).collect()}
    assert len(rows) == 3
    assert rows["EXISTING BA ADD NEW ADDRESS"].max_name is None
    assert rows["NEW BA AND NEW ADDRESS"].max_name == 60.0


def test_load_from_csv_with_upper_case_headers(spark):
    """Any Spark source; upper-case names and text ids normalize the same."""
    import tempfile

    from pyspark.sql import functions as F

    from matchdesk.sources import inputs as IN
    from tests.conftest import SF_SMALL
    raw = IN.raw_matches(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="matchdesk-csv-", dir="/tmp") + "/matches_csv"
    raw.toDF(*[c.upper() for c in raw.columns]).write.option("header", True).csv(path)
    got = L.load_matches(spark, path, fmt="csv", header="true")
    want = L.normalize(raw)
    assert sorted(got.columns) == sorted(want.columns)
    assert dict(got.dtypes) == dict(want.dtypes)
    # CSV cannot tell '' from NULL in text columns; compare with blanks folded
    fold = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(want.columns)]
    assert got.select(*fold).exceptAll(want.select(*fold)).count() == 0
    assert got.count() == want.count()
