"""Flat token files: documents' token ids, one end identifier after each document,
unsigned 16-bit little-endian, no index.

Counting tokens scans the files for separators. Files are cut into blocks of fixed
size; each block is read by one task, which finds the end identifiers with one
vectorised comparison and reports, besides the documents that lie inside it, how
many tokens stand before its first and after its last separator. A prefix scan over
those block summaries carries open tokens and document numbers across block borders.

Files live under the shared folder of ``spark.checkpoint.dir`` and are opened through
``pyarrow.fs`` by their URI, so any store that it knows will do. A file is written
under a temporary name and moved into place when complete, and its name depends on
the partition only, so a repeated or speculative task replaces it by the same bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import encoding, vocabulary_path
from .common import scratch, stored
from .files import open_store, put

END = 50256              # free in the 50,256-entry vocabularies
DTYPE = "<u2"
BLOCK_TOKENS = 4 << 20   # tokens of one scanned block (8 MB)


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      vocabulary: str | None = None, folder: str | None = None) -> tuple[str, DataFrame]:
    """Encode each text and write one flat file per partition. Returns the folder and
    the row order (file, ordinal, id), which the files themselves do not hold."""
    spark = docs.sparkSession
    path, folder = vocabulary or vocabulary_path(), folder or scratch(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, name = encoding(path), f"{TaskContext.get().partitionId():08d}.u16"
        ids: list = []

        def chunks() -> Iterator[bytes]:
            for batch in batches:
                key, text = batch.columns
                ids.append(key)
                for t in text:
                    yield np.array(enc.encode_ordinary(t.as_py() or "") + [END], DTYPE).tobytes()

        put(f"{folder}/{name}", chunks())
        at = 0
        for key in ids:
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(key), pa.string()), pa.array(np.arange(at, at + len(key)), pa.int64()), key],
                ["file", "ordinal", "id"])
            at += len(key)

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return folder, stored(src.mapInArrow(write, "file string, ordinal long, id long"), "token-order")


def list_blocks(spark: SparkSession, folder: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, start, stop) in tokens, from the files' lengths alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.u16").load(folder).select("path", "length")
    width = np.dtype(DTYPE).itemsize
    cut = files.where(F.col("length") >= width).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("length") / width).cast("long").alias("n"))
    n_blocks = F.ceil(F.col("n") / block_tokens)
    rows = cut.select("path", "file", "n", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("block"))
    return rows.select("path", "file", "block", (F.col("block") * block_tokens).alias("start"),
                       F.least("n", (F.col("block") + 1) * block_tokens).alias("stop"))


def _scanner(end: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(DTYPE).itemsize
        for batch in batches:
            for r in batch.to_pylist():
                store, path = open_store(r["path"])
                with store.open_input_file(path) as f:
                    raw = f.read_at((r["stop"] - r["start"]) * width, r["start"] * width)
                at = np.flatnonzero(np.frombuffer(raw, DTYPE) == end) + r["start"]
                head = int(at[0]) - r["start"] if len(at) else r["stop"] - r["start"]
                tail = r["stop"] - int(at[-1]) - 1 if len(at) else head
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["file"]]), pa.array([r["block"]], pa.int64()), pa.array([len(at)], pa.int64()),
                     pa.array([head], pa.int64()), pa.array([tail], pa.int64()),
                     pa.array([at.tolist()], pa.list_(pa.int64())), pa.array([r["stop"]], pa.int64())],
                    ["file", "block", "n_ends", "head", "tail", "ends", "stop"])
    return scan


def token_counts(spark: SparkSession, folder: str, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document in the flat files.

    Tokens behind a file's last separator form one more, unfinished document
    (``complete`` false). Two separators in a row are an empty document. Empty files
    and an empty folder give no rows."""
    blocks = list_blocks(spark, folder, block_tokens)
    schema = "file string, block long, n_ends long, head long, tail long, ends array<long>, stop long"
    found = stored(blocks.repartition(F.col("file"), F.col("block")).mapInArrow(_scanner(end), schema), "separators")
    # the prefix scan runs over one small row per block of a file
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    summary = found.select("file", "block", "n_ends", "stop", F.when(F.col("n_ends") > 0, F.get("ends", F.col("n_ends").cast("int") - 1)).alias("last_end"))
    carried = summary.select(
        "file", "block", F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("first"),
        (F.coalesce(F.max("last_end").over(before), F.lit(-1)) + 1).alias("open_at"))
    # each separator with the one before it, paired up before they become rows
    before_it = F.concat(F.array(F.col("open_at") - 1), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    pairs = F.arrays_zip(before_it.alias("a"), F.col("ends").alias("b"))
    rows = found.where("n_ends > 0").join(carried, ["file", "block"]).select(
        "file", "first", F.posexplode(pairs).alias("k", "pair")).select("file", "first", "k", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"))
    whole = rows.select("file", (F.col("first") + F.col("k")).alias("ordinal"), (F.col("a") + 1).alias("start"),
                        (F.col("b") - F.col("a") - 1).alias("n_tokens"), F.lit(True).alias("complete"))
    tail = (summary.groupBy("file").agg(F.sum("n_ends").alias("ordinal"), F.max("stop").alias("stop"),
                                        (F.coalesce(F.max("last_end"), F.lit(-1)) + 1).alias("start"))
            .where("stop > start").select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"),
                                          F.lit(False).alias("complete")))
    return whole.unionByName(tail)


def count_document_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          vocabulary: str | None = None) -> DataFrame:
    """Write the flat files of ``docs``, scan them, and name the documents:
    (id, file, ordinal, start, n_tokens). Null and empty texts have no tokens. Null and
    repeated ids keep their rows. Other columns are not read."""
    folder, order = write_token_files(docs, id_col, text_col, vocabulary)
    counts = token_counts(docs.sparkSession, folder)
    return order.join(counts.drop("complete"), ["file", "ordinal"]).select(
        F.col("id").alias(id_col), "file", "ordinal", "start", "n_tokens")
