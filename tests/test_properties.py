"""Property tests: Spark expressions vs plain-Python statements of the same rules."""

import math
import re

from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchdesk.functions import exprs as X
from matchdesk.sources import load as L

FLAG_TEXT = st.one_of(
    st.none(),
    st.sampled_from(["1", "0", " 7 ", "abc", "1.7", "", "-2.9", "1e2", "NaN", "true"]),
    st.integers(-1000, 1000).map(str),
    st.floats(-1e6, 1e6, allow_nan=False).map(lambda f: f"{f:.3f}"),
)


def py_flag(x):
    """pandas-style: numeric text -> truncated int, anything else -> 0."""
    if x is None:
        return 0
    try:
        v = float(x.strip())
    except ValueError:
        return 0
    if math.isnan(v) or math.isinf(v):
        return 0
    return int(v)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(FLAG_TEXT, min_size=30, max_size=60))
def test_flag_coercion(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    got = [r.f for r in df.select("i", X.to_flag("x").alias("f")).orderBy("i").collect()]
    assert got == [py_flag(v) for v in values]


def py_number_text(v):
    if v is None:
        return None
    return str(int(v)) if v == math.floor(v) and abs(v) < 1e15 else None


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(-10**6, 10**6).map(float),
                          st.floats(-1e6, 1e6, allow_nan=False)), min_size=30, max_size=60))
def test_number_text(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [r.t for r in df.select("i", X.number_text("x").alias("t")).orderBy("i").collect()]
    for v, t in zip(values, got):
        want = py_number_text(v)
        if want is not None or v is None:
            assert t == want
        else:
            assert float(t) == v  # fractional values keep their digits


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=" \t\r,0123456789", max_size=12), min_size=10, max_size=40))
def test_id_list_parse(spark, lines):
    df = spark.createDataFrame([(ln,) for ln in lines], "value string")
    got = [r.canvas_id for r in L.parse_id_list(df).collect()]
    want = [s.strip() for ln in lines for s in re.split(r"[\r\n,]+", ln) if s.strip()]
    assert sorted(got) == sorted(want)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text(alphabet="aAbB.$x\\1 ", max_size=10),
                          st.booleans()), min_size=20, max_size=40))
def test_literal_replace(spark, cells):
    from matchdesk.operators.search import replaced
    needle, repl = "a.B", "$1\\x"
    rows = [(i, t, cs) for i, (t, cs) in enumerate(cells)]
    df = spark.createDataFrame(rows, "i int, t string, cs boolean")
    ci = [r.v for r in df.select("i", replaced(F.col("t"), needle, repl, False).alias("v")).orderBy("i").collect()]
    cs = [r.v for r in df.select("i", replaced(F.col("t"), needle, repl, True).alias("v")).orderBy("i").collect()]
    for (t, _), a, b in zip(cells, ci, cs):
        assert a == re.sub(re.escape(needle), lambda _: repl, t, flags=re.IGNORECASE)
        assert b == t.replace(needle, repl)
