"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, BPE encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All stages but the last
return the columns of ``documents``.

The stages that hand texts to Python set ``spark.sql.execution.arrow.maxBytesPerBatch``
for their session. They can't put it back, since their rows are computed by who reads
them; ``run`` does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchdesk.llm import bpe, decontaminate, language_id, line_dedup, minhash_dedup
from matchdesk.llm.common import scratch, sized, stored
from matchdesk.llm.queries import token_digests
from matchdesk.sources.tables import read_table

BLOCK_CHARS = 1 << 20  # text of an encoding block: executors still hold what earlier stages left
BATCH_BYTES = 2 << 20    # of an Arrow batch, in place of Spark's 64 MB, for the same reason
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
MIN_SCORE = 0.4  # of the predicted language; below it a document counts as rejected


def _keep(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """Documents whose id is not among ``bad`` (doc_id); null ids stay."""
    return docs.join(sized(stored(bad.select("doc_id").distinct(), "dropped")), "doc_id", "left_anti")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told (no letters, or no clear winner)."""
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    names = [f"c{k}" for k in range(len(docs.columns))]  # whatever the columns are called
    found = language_id.predict(docs.toDF(*names), language_id.train(docs), text_col=names[docs.columns.index("text")], carry=names)
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_SCORE)).select(*names).toDF(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring lines; every document stays, ``n_chars`` follows its text."""
    out = line_dedup.line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_n_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies."""
    return _keep(docs, minhash_dedup.near_dedup(docs).where("NOT kept"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window."""
    found = decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return _keep(docs, found.where("contaminated"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of their decoding."""
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    decoded = bpe.decode(bpe.encode(docs, block_chars=BLOCK_CHARS))
    return token_digests(decoded)


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("minhash_near_dedup", near_stage),
          ("benchmark_decontamination", benchmark_stage), ("byte_bpe", encode_stage)]

# Language ID and BPE merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    batch = spark.conf.get(BATCH_SETTING)
    try:
        for name, stage in STAGES:
            path = scratch(spark, f"stage-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, batch)
    return docs
