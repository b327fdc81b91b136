import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def key(row):
    return tuple((x is None, str(x)) for x in row)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=key)


def made_up():
    """Null, empty, blank, very long, tied and repeated rows, copies, near copies, passages."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghéñ") for _ in range(rnd.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(1, None), (2, ""), (3, "   \t\n"), (4, "one"), (5, "one two three"), (5, "one two three"), (6, "123 !!"),
            (None, "no id " + text(40)), (None, None), (7, "a" * 700), (8, "ab" * 400), (9, "\x1c x y　 z\x85w  \r\n ")]
    long = text(30000)
    passage = text(60)
    rows += [(20, long), (21, long.upper()), (22, long[:9000] + " new words here " + long[9000:])]
    base = text(200)
    n = 30
    for k in range(60):
        w = base.split(" ")
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = word()
        rows.append((n, " ".join(w)))
        n += 1
    for k in range(30):
        rows.append((n, text(rnd.randint(5, 60)) + "\n" + passage + "\n" + text(rnd.randint(5, 60)) + f"\nPage {k} of 30 in the long report today"))
        n += 1
    rows += [(n + k, rows[30][1]) for k in range(5)]
    rows += [(n + 10, rows[30][1].replace(" ", " \t")), (n + 11, passage)]
    return rows


@pytest.fixture(scope="session")
def odd_rows():
    return made_up()


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The made-up rows with extra columns whose names clash with inner ones."""
    df = spark.createDataFrame(odd_rows, "doc_id long, text string").withColumn("lang", F.lit("en")).repartition(5)
    for c in ("id", "key", "rid", "n", "words", "digest", "run", "source", "ids", "start", "rank"):
        df = df.withColumn(c, F.lit(c))
    return df


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small_docs):
    return [tuple(r) for r in small_docs.orderBy("doc_id").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
