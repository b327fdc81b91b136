"""Training-order materialisation of token sequences as fixed-stride binary shards.

Every sequence gets an index (a prefix sum over the documents in id order) and a
slot: the index under a keyed Feistel permutation of the smallest even number of
bits that holds all indices, walked along its cycles until it falls into the range.
The permutation needs no table, so slots of any range can be computed or inverted
anywhere. Sequences are range-partitioned by slot and every shard file is written by
one task as records of one fixed length: record r of shard s is slot
``s * RECORDS + r``, so a reader seeks straight to any slot and can resume there.

The query's ids are the 16-bit BPE ids of op7's vocabulary (:func:`write_token_order`):
documents are encoded once, stand one behind the other with ``TOKEN_END`` behind each,
and the stream is cut into sequences, so only the last sequence is padded.
:func:`write_training_order` writes byte ids, with sequences of one document each:
a token is a byte of the text's UTF-8 form, ``END`` and ``PAD`` are two byte values
that UTF-8 never uses. :func:`materialise` takes any id type by its ``dtype``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import encoding, vocabulary_path
from .common import scratch, sized, stored
from .files import open_store, put
from .text_hash import mix
from .token_files import DTYPE
from .token_files import END as TOKEN_END

LENGTH = 2048        # tokens of a sequence
RECORDS = 8192       # sequences of a shard (16 MB of byte ids)
END, PAD = 0xFF, 0xFE
TOKEN_PAD = TOKEN_END + 1  # free in the 50,256-entry vocabularies as well
PACK_LEVEL = 6       # zstd level of stored and shuffled ids
DICT_DOCS, DICT_CHARS, DICT_BYTES = 500, 8192, 16 << 10  # bounds of the sample that the packing dictionary learns from
KEY = 20240607
ROUNDS = 6


class Permutation:
    """Keyed bijection of range(n), vectorised over numpy arrays."""

    def __init__(self, n: int, key: int = KEY):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = mix(np.uint64(key) + np.arange(1, ROUNDS + 1, dtype=np.uint64))
        self.mask = np.uint64((1 << self.half) - 1)

    def _round(self, x: np.ndarray, k: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(x * np.uint64(0x9E3779B97F4A7C15) + k) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        h = np.uint64(self.half)
        left, right = x >> h, x & self.mask
        for k in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ self._round(left, k), left
            else:
                left, right = right, left ^ self._round(right, k)
        return (left << h) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), back)
        while (off := out >= np.uint64(self.n)).any():
            out[off] = self._once(out[off], back)
        return out.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def byte_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text to byte ids with the end identifier behind."""
    for batch in batches:
        key, first, text = batch.columns
        yield pa.RecordBatch.from_arrays(
            [key, first, pa.array([(t.as_py() or "").encode("utf-8") + bytes([END]) for t in text], pa.binary())],
            ["id", "first", "ids"])


def _packer(words: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=PACK_LEVEL, dict_data=zstandard.ZstdCompressionDict(words) if words else None)


def _unpacker(words: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)


def dictionary(docs: DataFrame, path: str) -> bytes:
    """A zstd dictionary of the ids of a few texts. Bodies and pieces are short, so most of what
    they have in common is lost without one. Which texts it learns from changes sizes only."""
    head = docs.where("text IS NOT NULL").limit(DICT_DOCS).select(F.substring("text", 1, DICT_CHARS)).collect()
    enc = encoding(path)
    samples = [np.array(enc.encode_ordinary(r[0]) + [TOKEN_END], DTYPE).tobytes() for r in head]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few texts
        return b""


def _token_ids(path: str, words: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Text to packed 16-bit ids with the end identifier behind, and their number."""
        enc, pack = encoding(path), _packer(words)
        for batch in batches:
            key, tie, text = batch.columns
            n, body = [], []
            for t in text:
                ids = np.array(enc.encode_ordinary(t.as_py() or "") + [TOKEN_END], DTYPE)
                n.append(len(ids)), body.append(pack.compress(ids.tobytes()))
            yield pa.RecordBatch.from_arrays([key, tie, pa.array(n, pa.int64()), pa.array(body, pa.binary())], ["id", "tie", "n", "body"])
    return run


def _unpacked(words: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _unpacker(words)
        for batch in batches:
            key, first, body = batch.columns
            for k in range(0, len(key), 256):  # ids of a few documents at once
                yield pa.RecordBatch.from_arrays(
                    [key[k:k + 256], first[k:k + 256], pa.array([unpack.decompress(b.as_py()) for b in body[k:k + 256]], pa.binary())],
                    ["id", "first", "ids"])
    return run


def number_documents(sizes: DataFrame) -> tuple[DataFrame, int]:
    """``sizes`` (id, tie, n, ...) with the sum of n before each document (its first
    sequence or token), and the total. Documents stand in order of (id, tie); one total per range
    partition passes through the driver."""
    ranged = stored(sizes.repartitionByRange("id", "tie").withColumn("part", F.spark_partition_id()), "ranged")
    totals = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    base, at = [], 0
    for p in sorted(totals):
        base.append((p, at))
        at += totals[p]
    offsets = sizes.sparkSession.createDataFrame(base, "part int, base long")
    run = W.partitionBy("part").orderBy("id", "tie").rowsBetween(W.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(run), F.lit(0)) + F.col("base")
    return stored(ranged.join(F.broadcast(offsets), "part").withColumn("first", first).drop("part", "base"), "numbered"), at


def _cutter(total: int, length: int, dtype: str, key: int, packed: bool, words: bytes):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perm, width = Permutation(total, key), np.dtype(dtype).itemsize
        pack = _packer(words)
        for batch in batches:
            owner, index, at, n, body = [], [], [], [], []
            for k, first, ids in zip(*(c.to_pylist() for c in batch.columns)):
                place = first if packed else first * length  # of the document's first token
                have, done = len(ids) // width, 0
                while done < have:
                    j, a = divmod(place + done, length)
                    m = min(length - a, have - done)
                    owner.append(k), index.append(j), at.append(a), n.append(m)
                    body.append(pack.compress(ids[done * width:(done + m) * width]))
                    done += m
            slot = perm.slot(np.array(index, np.uint64)) if index else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot, pa.int64()), pa.array(index, pa.int64()), pa.array(at, pa.int32()), pa.array(owner, pa.int64()),
                 pa.array(n, pa.int32()), pa.array(body, pa.binary())], ["slot", "seq", "at", "id", "n_tokens", "body"])
    return cut


def _shard_writer(folder: str, length: int, records: int, dtype: str, pad: int, words: bytes):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by slot and place, and whole shards at a time."""
        width = np.dtype(dtype).itemsize
        fill = np.full(length, pad, dtype).tobytes()
        unpack = _unpacker(words)
        shard, rows = None, []

        def chunks() -> Iterator[bytes]:
            for k, r in enumerate(rows):
                yield unpack.decompress(r["body"])
                if k + 1 == len(rows) or rows[k + 1]["slot"] != r["slot"]:  # the record's last piece
                    yield fill[(r["at"] + r["n_tokens"]) * width:]

        def flush() -> pa.RecordBatch:
            name = f"{folder}/{shard:08d}.bin"
            put(name, chunks())
            out = {k: [r[k] for r in rows] for k in ("slot", "seq", "id", "n_tokens")}
            at = [((r["slot"] - shard * records) * length + r["at"]) * width for r in rows]
            return pa.RecordBatch.from_arrays(
                [pa.array(out["slot"], pa.int64()), pa.array(out["seq"], pa.int64()), pa.array(out["id"], pa.int64()),
                 pa.array(out["n_tokens"], pa.int32()), pa.array([f"{shard:08d}.bin"] * len(rows)), pa.array(at, pa.int64())],
                ["slot", "seq", "id", "n_tokens", "shard", "offset"])

        for batch in batches:
            for r in batch.to_pylist():
                s = r["slot"] // records
                if shard is not None and s != shard:
                    yield flush()
                    rows = []
                shard = s
                rows.append(r)
        if rows:
            yield flush()
    return write


def materialise(ids: DataFrame, total: int, folder: str, length: int = LENGTH, records: int = RECORDS,
                dtype: str = "u1", pad: int = PAD, key: int = KEY, packed: bool = False, words: bytes = b"") -> DataFrame:
    """Cut (id, first, ids binary) into sequences, place them and write the shards.

    ``first`` is the index of a document's first sequence or, if ``packed``, the number
    of tokens before it. Returns one row per piece of a document in a sequence: slot, seq
    (the sequence's index), id, n_tokens, shard, offset (bytes). Every slot of 0..total-1
    occurs; a record is padded behind its last piece. Pieces are packed with the dictionary ``words``."""
    rows = ids.mapInArrow(_cutter(total, length, dtype, key, packed, words),
                          "slot long, seq long, at int, id long, n_tokens int, body binary")
    n_shards = max(1, -(-total // records))
    # slots are dense, so shards are the range partitioning by slot; no sampling needed
    placed = rows.repartition(n_shards, F.floor(F.col("slot") / records))
    return placed.sortWithinPartitions("slot", "at").mapInArrow(
        _shard_writer(folder, length, records, dtype, pad, words),
        "slot long, seq long, id long, n_tokens int, shard string, offset long")


def _placed(src: DataFrame, first: DataFrame, body: str) -> DataFrame:
    """(id, first, ``body``) of every row of ``src`` (id, tie, ``body``)."""
    rows = src.join(sized(first), src["id"].eqNullSafe(first["id"]) & (src["tie"] == first["tie"])).select(
        src["id"], src["tie"], src[body], first["first"], first["n"], first["copies"])
    # rows that repeat id and text are numbered one behind the other
    one = rows.where("copies = 1").select("id", "first", body)
    many = rows.where("copies > 1").dropDuplicates(["id", "tie"]).select(
        "id", F.explode(F.expr("transform(sequence(0L, copies - 1), c -> first + c * (n div copies))")).alias("first"), body)
    return one.unionByName(many)


def write_training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None,
                         length: int = LENGTH, records: int = RECORDS, key: int = KEY) -> tuple[str, DataFrame]:
    """Byte-id shards of all texts; returns the folder and the manifest.

    Null and empty texts give one sequence that holds the end identifier alone.
    Null ids come first in the order; rows that repeat id and text get sequences of
    their own with equal content. Other columns are not read; an empty table gives no shard."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "shards")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    n = F.ceil((F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / length).cast("long")
    sizes = src.groupBy("id", "tie").agg(F.sum(n).alias("n"), F.count("*").alias("copies"))
    first, total = number_documents(stored(sizes, "doc-sizes"))
    ids = _placed(src, first, "text").mapInArrow(byte_ids, "id long, first long, ids binary")
    return folder, materialise(ids, max(1, total), folder, length, records, key=key)


def write_token_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None,
                      length: int = LENGTH, records: int = RECORDS, key: int = KEY,
                      vocabulary: str | None = None) -> tuple[str, DataFrame]:
    """Shards of the 16-bit BPE ids of all texts, packed back to back; returns the folder
    and the manifest, one row per piece of a document in a sequence.

    Null and empty texts give the end identifier alone. Null ids come first in the order;
    rows that repeat id and text get ids of their own. Other columns are not read; an
    empty table gives no shard."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "shards")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    vocabulary = vocabulary or vocabulary_path()
    words = dictionary(src, vocabulary)
    coded = stored(src.mapInArrow(_token_ids(vocabulary, words), "id long, tie long, n long, body binary"), "token-ids")
    sizes = coded.groupBy("id", "tie").agg(F.sum("n").alias("n"), F.count("*").alias("copies"))
    first, total = number_documents(stored(sizes, "doc-sizes"))
    ids = _placed(coded.drop("n"), first, "body").mapInArrow(_unpacked(words), "id long, first long, ids binary")
    return folder, materialise(ids, max(1, -(-total // length)), folder, length, records, DTYPE, TOKEN_PAD, key, True, words)


def read_slots(folder: str, start: int, stop: int, length: int = LENGTH, records: int = RECORDS, dtype: str = "u1") -> np.ndarray:
    """Records of a range of slots, by seeking: the resumable sequential reader."""
    stride, out = length * np.dtype(dtype).itemsize, []
    while start < stop:
        s, r = divmod(start, records)
        n = min(stop - start, records - r)
        store, path = open_store(f"{folder}/{s:08d}.bin")
        with store.open_input_file(path) as f:
            out.append(np.frombuffer(f.read_at(n * stride, r * stride), dtype).reshape(-1, length))
        start += n
    return np.concatenate(out) if out else np.zeros((0, length), dtype)
