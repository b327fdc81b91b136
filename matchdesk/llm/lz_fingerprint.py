"""Lempel-Ziv phrase fingerprints: compression-like similarity of documents.

A text is parsed into dictionary phrases: the shortest piece that is not yet in the
dictionary is the next phrase and enters it. Every 2**20 code points the dictionary is
cleared, as compressors do, so memory does not grow with the text; the phrase set of a
text is the union over its blocks. Phrases are hashed, and the ``SIZE`` smallest hashes
are the text's fingerprint (a bottom-k minimum-hash signature; of a union of sets it is
the smallest of both). The likeness of two fingerprints is the share of common hashes
among the ``SIZE`` smallest of both together, the estimate of the Jaccard similarity of
the phrase sets, and exactly that while both sets fit.

``with_next`` pairs every document with the next one by falling id. Documents are dealt
once into id ranges, whose bounds come from quantiles; the first document of each range is
also sent to the range before it, and each range is then read through in order. Nothing
but the bounds (one id per range) passes the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 128                # hashes in a fingerprint
BLOCK = 1 << 20           # code points after which the dictionary is cleared
RANGE_BYTES = 32 << 20    # text of one id range


def grow(phrases: dict, pending: str, text: str) -> str:
    """Parse on through ``text`` from the unfinished phrase ``pending``; returns the new one."""
    for c in text:
        pending += c
        if pending not in phrases:
            phrases[pending] = None
            pending = ""
    return pending


def _hashes(phrases: list[str]) -> np.ndarray:
    if not phrases:
        return np.zeros(0, np.uint32)
    return (pd.util.hash_array(np.array(phrases, dtype=object), categorize=False) >> np.uint64(32)).astype(np.uint32)


def _smallest(*parts: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate(parts))[:SIZE]


def signature(text: str, block: int = BLOCK) -> np.ndarray:
    """The smallest phrase hashes of a text, ascending."""
    out = np.zeros(0, np.uint32)
    for at in range(0, len(text), block):
        phrases: dict = {}
        grow(phrases, "", text[at:at + block])
        out = _smallest(out, _hashes(list(phrases)))
    return out


def signatures(head: str, tail: str, other: str, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of ``head + tail`` and ``head + other``; the parse of ``head`` is shared."""
    if len(head) + max(len(tail), len(other)) > block:
        return signature(head + tail, block), signature(head + other, block)
    phrases: dict = {}
    pending = grow(phrases, "", head)
    again, n = phrases.copy(), len(phrases)
    shared = _hashes(list(phrases))
    out = []
    for d, rest in ((phrases, tail), (again, other)):
        grow(d, pending, rest)
        out.append(_smallest(shared, _hashes(list(d)[n:])))
    return out[0], out[1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the phrase sets; two empty sets are alike."""
    both = np.union1d(a, b)
    if len(a) == SIZE or len(b) == SIZE:
        both = both[:SIZE]
    if not len(both):
        return 1.0
    return float(np.isin(both, a).dot(np.isin(both, b).astype(np.int64))) / len(both)


def as_text(sig: np.ndarray) -> str:
    """Eight hex digits per hash, ascending; empty for a text without phrases."""
    return sig.astype(">u4").tobytes().hex()


def likeness_of(a: Column, b: Column) -> Column:
    """``likeness`` of two fingerprint columns, without Python."""
    cut = lambda c: F.regexp_extract_all(c, F.lit("(.{8})"), F.lit(1))
    both = F.array_sort(F.array_union(cut(a), cut(b)))
    full = (F.length(a) == 8 * SIZE) | (F.length(b) == 8 * SIZE)
    both = F.when(full, F.slice(both, 1, SIZE)).otherwise(both)
    common = F.size(F.array_intersect(F.array_intersect(both, cut(a)), cut(b)))
    return F.when((a == "") & (b == ""), F.lit(1.0)).otherwise(common / F.size(both))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, n_chars, fingerprint) of every row, where it lies: no shuffle. Null texts
    count as empty and have the empty fingerprint; repeated and null ids keep their rows;
    other columns are not read; an empty table gives no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([as_text(signature(t, block)) for t in texts], pa.string())],
                [id_col, "n_chars", "fingerprint"])

    return (docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
            .mapInArrow(run, f"`{id_col}` long, n_chars long, fingerprint string"))


def _ranged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, copy: one id range per partition, falling ids (nulls last; ties by hash,
    then text), and behind a range's own rows those that the next range begins with."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src = src.withColumn("tie", F.xxhash64("text"))
    total = src.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n = max(1, -(-total // RANGE_BYTES))
    cuts = []
    if n > 1:
        cuts = src.agg(F.percentile_approx("id", [k / n for k in range(1, n)], max(10_000, 100 * n))).first()[0] or []
    cuts = sorted({float(c) for c in cuts})
    # range 0 holds null ids, 1 the smallest ones
    if cuts:
        splits = [float("-inf"), *cuts, float("inf")]
        src = Bucketizer(splits=splits, inputCol="at", outputCol="cut", handleInvalid="keep").transform(src.withColumn("at", F.col("id").cast("double")))
        src = src.select("id", "text", "tie", F.when(F.col("id").isNull(), 0).otherwise(F.col("cut").cast("int") + 1).alias("range"))
    else:
        src = src.withColumn("range", F.when(F.col("id").isNull(), 0).otherwise(1))
    # one row per range: its first document and the range in front that reads on into it
    firsts = sorted(src.groupBy("range").agg(F.max(F.struct("id", "tie")).alias("first")).collect(), key=lambda r: -r["range"])
    front = [(r["range"], r["first"]["id"], r["first"]["tie"], firsts[k - 1]["range"]) for k, r in enumerate(firsts)]
    fronts = src.sparkSession.createDataFrame(front, "range int, first_id long, first_tie long, front int")
    begins = (F.col("tie") == F.col("first_tie")) & F.col("id").eqNullSafe(F.col("first_id"))
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("copy"))
    sent = F.struct(F.col("front").alias("range"), F.lit(True).alias("copy"))
    return (src.join(F.broadcast(fronts), "range")
            .withColumn("to", F.explode(F.when(begins, F.array(own, sent)).otherwise(F.array(own))))
            .select(F.col("to.range").alias("range"), F.col("to.copy").alias("copy"), "id", "text", "tie")
            .repartitionById(n + 1, F.col("range"))
            .sortWithinPartitions("range", "copy", F.col("id").desc_nulls_last(), F.col("tie").desc(), "text")
            .select("range", "copy", "id", "text"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Every document, its edited text and the next document by falling id, compared: id,
    n_chars, next_id, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by
    the first as many (or all) of the next document's; after the last document the first one
    follows, and a single document follows itself. Null texts count as empty. Null ids
    come last; rows that repeat an id follow each other by a hash of the text, then the
    text. Other columns are not read; an empty table gives no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None     # (range, id, text) of the row whose next one is awaited
        todo = None     # that row's results but for near_next, which the next row's own fingerprint gives
        own = None      # signature of the held row's text
        out: list[tuple] = []

        def finish(next_id, text: str) -> None:
            """The held row, now that the text behind it is known."""
            nonlocal todo, own
            _, id_, t = held
            keep = len(t) - len(t) // 2
            other = text[:len(t) // 2]
            own, edited = signatures(t[:keep], t[keep:], other, block)
            if todo is not None:  # the row before compares with this one
                out.append((*todo[0], likeness(todo[1], own)))
            sha = hashlib.sha256((t[:keep] + other).encode("utf-8", "surrogatepass")).hexdigest()
            todo = ((id_, len(t), next_id, sha, as_text(own), as_text(edited), likeness(own, edited)), own)

        def close(text: str) -> None:
            nonlocal todo
            out.append((*todo[0], likeness(todo[1], signature(text, block))))
            todo = None

        for batch in batches:
            for rng, copy, id_, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None and held[0] != rng:
                    held = None
                if copy:
                    if held is not None:  # the first of the copies ends the range
                        finish(id_, text)
                        close(text)
                        held = None
                    continue
                if held is not None:
                    finish(id_, text)
                held = (rng, id_, text)
            if out:
                yield _batch(out)
                out = []

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    names = [id_col, "n_chars", "next_id", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = (f"`{id_col}` long, n_chars long, next_id long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    return _ranged(docs, id_col, text_col).mapInArrow(run, schema)
