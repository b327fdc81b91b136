"""Byte-level BPE encoding and decoding over a global shuffle of distinct words.

Texts are packed into blocks. In a block every word occurrence becomes a position
that refers to the block's list of distinct words, and the distinct words go, with
the block's name, to hash buckets. A bucket sees each of its words once per block,
encodes each distinct word once, and returns the ids to the blocks that asked; a
block puts them back by position. Word lists travel as packed columns (one row per
block and bucket, not one per occurrence); a block's positions wait in a file of the
shared folder (``spark.checkpoint.dir``), so they are not shuffled at all.

A *word* here is a run of white space with the run of other characters behind it.
No match of the tokenizer's pattern reaches over the edge between a non-space and a
following space, so encoding words apart and joining the ids equals encoding the
whole text; inside a word the tokenizer's own pattern and merges do the work.

Decoding joins ids with the table of token bytes, whose size the vocabulary fixes.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored
from .files import get, put

BLOCK_CHARS = 8 << 20       # text of one block (a longer text is a block of its own)
BUCKET_BYTES = 16 << 20     # text per word bucket

# White space as the tokenizer's pattern sees it (Unicode White_Space).
WORDS = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: the bytes of each id."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for b, i in ranks.items():
        table[i] = b
    return table


def _zip(a: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(a)


def _unzip(a: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(a)


def _planes(a: np.ndarray) -> bytes:
    """Unsigned 32-bit integers by byte planes: small ones compress well."""
    return _zip(np.ascontiguousarray(a, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unzip(b), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _join(parts: list[bytes]) -> bytes:
    lens = np.fromiter(map(len, parts), np.uint32, len(parts))
    return _zip(np.uint32(len(parts)).tobytes() + lens.tobytes() + b"".join(parts))


def _split(blob: bytes) -> tuple[np.ndarray, bytes]:
    raw = _unzip(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    return np.frombuffer(raw, np.uint32, n, 4).astype(np.int64), raw[4 + 4 * n:]


SCHEMA = "block string, bucket int, n_words long, body binary"


def _block(rows: list[tuple], n_buckets: int, folder: str) -> pa.RecordBatch:
    """One row per bucket with the words that the block wants from it. The rows' ids
    and word positions go to the block's file; a task that runs again writes new
    blocks, and only the rows of the attempt that is kept refer to them."""
    block = uuid.uuid4().hex
    words: list[str] = []
    per_doc = np.zeros(len(rows), np.uint32)
    for k, (_, text) in enumerate(rows):
        w = WORDS.findall(text)
        per_doc[k] = len(w)
        words += w
    codes, distinct = pd.factorize(np.array(words, dtype=object)) if words else (np.zeros(0, np.int64), np.zeros(0, object))
    del words
    # words that recur are numbered by falling frequency, then those that occur once by
    # place; of the latter the positions only say "the next one" (0)
    n = np.bincount(codes, minlength=len(distinct))
    often = np.flatnonzero(n > 1)
    often = often[np.argsort(-n[often], kind="stable")]
    order = np.concatenate([often, np.flatnonzero(n == 1)])
    rank = np.zeros(len(order), np.int64)
    rank[often] = np.arange(1, len(often) + 1)
    symbols = rank[codes]
    raw = [distinct[i].encode("utf-8", "surrogatepass") for i in order]
    bucket = (pd.util.hash_array(np.array(raw, dtype=object), categorize=False) % np.uint64(n_buckets)).astype("<u4") if raw else np.zeros(0, "<u4")
    ids = pa.array([i for i, _ in rows], pa.int64())
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", pa.int64()), ("n", pa.uint32())])) as w:
        w.write_batch(pa.RecordBatch.from_arrays([ids, pa.array(per_doc)], ["id", "n"]))
    put(f"{folder}/{block}", [_join([sink.getvalue().to_pybytes(), _planes(bucket), _planes(symbols), str(len(often)).encode()])])
    by = np.argsort(bucket, kind="stable")
    out = [(int(b), len(m), _join([raw[i] for i in m])) for b, m in zip(*_runs(bucket[by], by))]
    out = out or [(-1, 0, None)]  # a block without words still has its rows
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * len(out)), pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()),
         pa.array([o[2] for o in out], pa.binary())], ["block", "bucket", "n_words", "body"])


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    if not len(keys):
        return keys, []
    cut = np.flatnonzero(np.diff(keys)) + 1
    return keys[np.r_[0, cut]], np.split(values, cut)


def _packer(n_buckets: int, folder: str, block_chars: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for i, t in zip(*batch.columns):
                text = t.as_py() or ""
                if rows and size + len(text) > block_chars:
                    yield _block(rows, n_buckets, folder)
                    rows, size = [], 0
                rows.append((i.as_py(), text))
                size += len(text)
        if rows:
            yield _block(rows, n_buckets, folder)
    return pack


def _encoder(path: str):
    def encode(table: pa.Table) -> pa.Table:
        """One bucket: each distinct word is encoded once."""
        enc, known = encoding(path), {}
        out = []
        for body in table.column("body"):
            lens, raw = _split(body.as_py())
            ends = np.cumsum(lens)
            n, flat = np.zeros(len(lens), np.uint32), []
            for k, (s, e) in enumerate(zip((ends - lens).tolist(), ends.tolist())):
                w = raw[s:e]
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = np.array(enc.encode_ordinary(w.decode("utf-8", "surrogatepass")), "<u4").tobytes()
                n[k] = len(ids) // 4
                flat.append(ids)
            out.append(_join([_planes(n), _planes(np.frombuffer(b"".join(flat), "<u4"))]))
        return pa.Table.from_arrays(
            [table.column("block"), table.column("bucket"), table.column("n_words"), pa.array(out, pa.binary())],
            ["block", "bucket", "n_words", "body"])
    return encode


def _assembler(folder: str):
    def run(table: pa.Table) -> pa.Table:
        return _assemble(table, folder)
    return run


def _assemble(table: pa.Table, folder: str) -> pa.Table:
    """One block: the ids of its words, put back by position."""
    bodies = dict(zip(table.column("bucket").to_pylist(), table.column("body")))
    lens, raw = _split(get(f"{folder}/{table.column('block')[0].as_py()}"))
    cut = np.cumsum(lens)
    with pa.ipc.open_stream(raw[:cut[0]]) as r:
        docs = r.read_all()
    bucket, symbols = _unplanes(raw[cut[0]:cut[1]]), _unplanes(raw[cut[1]:cut[2]])
    positions = symbols.astype(np.int64) - 1
    once = np.flatnonzero(symbols == 0)
    positions[once] = int(raw[cut[2]:]) + np.arange(len(once))
    by = np.argsort(bucket, kind="stable")
    n_ids, flat, at = np.zeros(len(bucket), np.int64), [], []
    for b, members in zip(*_runs(bucket[by], by)):
        l, r = _split(bodies[int(b)].as_py())
        n_ids[members] = _unplanes(r[:l[0]])
        flat.append(_unplanes(r[l[0]:]))
        at.append(members)
    ids = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
    where = np.concatenate(at) if at else np.zeros(0, np.int64)
    start = np.zeros(len(bucket), np.int64)
    start[where] = np.cumsum(n_ids[where]) - n_ids[where]
    n_words = docs.column("n").to_numpy().astype(np.int64)
    edges = np.r_[0, np.cumsum(n_words)]
    out, total = [], np.zeros(len(n_words), np.int64)
    lo = 0
    while lo < len(n_words):  # gather a quarter of a million words at a time
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + (1 << 18), "right")) - 1)
        p = positions[edges[lo]:edges[hi]]
        n = n_ids[p]
        ends = np.cumsum(n)
        idx = np.repeat(start[p] - (ends - n), n) + np.arange(int(n.sum()))
        out.append(ids[idx])
        e = np.r_[0, ends][edges[lo:hi + 1] - edges[lo]]
        total[lo:hi] = np.diff(e)
        lo = hi
    values = np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)
    offsets = np.r_[0, np.cumsum(total)].astype(np.int32)
    return pa.Table.from_arrays(
        [docs.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["id", "ids"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
           block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, ids array<int>) per input row, as the tokenizer's library would encode
    its text without special tokens. Null and empty texts have no ids. Rows that
    repeat an id, and null ids, each keep their own row. Other columns are not
    read; an empty table gives no rows. Smaller blocks need less memory and send more words."""
    path = vocabulary or vocabulary_path()
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = src.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n_buckets = max(1, -(-size // BUCKET_BYTES))
    folder = scratch(docs.sparkSession, "bpe-positions")
    # the word lists are written once: block names stay fixed if tasks are run again
    blocks = stored(src.mapInArrow(_packer(n_buckets, folder, block_chars), SCHEMA), "bpe-words")
    words = blocks.where("bucket >= 0").groupBy("bucket").applyInArrow(_encoder(path), SCHEMA)
    both = words.unionByName(blocks.where("bucket < 0"))
    return both.groupBy("block").applyInArrow(_assembler(folder), "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """(id, ids, bytes): ids joined with the token-byte table. Null ids give empty bytes."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            key, ids = batch.columns
            raw = [b"".join(map(table.__getitem__, ids[k].values.tolist())) if ids[k].is_valid else b"" for k in range(len(ids))]
            yield pa.RecordBatch.from_arrays([key, ids, pa.array(raw, pa.binary())], [id_col, "ids", "bytes"])

    return encoded.select(F.col(id_col), "ids").mapInArrow(run, f"`{id_col}` long, ids array<int>, bytes binary")
