"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Documents are taken in batches. Both tokenizers cut the same bytes, so tokens have byte
ranges on one common axis. ``pandas.merge_asof``, keyed by document, finds for each start of
an A token the B token that covers it, and for each start of a B token the covering A
token; the union of both directions is every overlapping pair (a *link*), since of two
overlapping ranges the later one starts inside the other. Offsets where tokens of both sides
end cut the text into groups.

The document count of an id pair, and the highest one of each A id, hold for the whole
corpus. A batch reports each of its distinct pairs once, with the number of its documents
that hold it; Spark adds these up, takes the highest per A id, and joins the result back
to the batches by pair. What a batch knows of its documents (their distinct pairs, by
number, and how often each occurs) waits meanwhile in a file of the shared folder.

A batch holds about ``BATCH_CHARS`` of text; a longer text is a batch of its own, since a
tokenizer needs it whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _join, _planes, _split, _unplanes
from .common import scratch, stored
from .files import get, put

BATCH_CHARS = 3 << 20
PAIR = 32  # a pair is (A id << PAIR) + B id


def byte_level_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for
    themselves, the others for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Side A: a byte-level BPE vocabulary file. Ids rise in the order of its merges, so they are
    merge ranks too, and the faster library that wants ranks gives the same ids."""

    def __init__(self, path: str):
        import tiktoken
        import public_tokenizers
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        special = {"<|endoftext|>"}
        chars = byte_of_char()
        ranks = {bytes(chars[c] for c in entry): i for entry, i in model["vocab"].items() if entry not in special}
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if model["vocab"][a + b] != 256 + k:
                raise ValueError(f"ids of {path} are not in the order of its merges")
        self.table = [b""] * (max(model["vocab"].values()) + 1)
        for b, i in ranks.items():
            self.table[i] = b
        self.coder = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.coder.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """Side B: a sentence-piece model, which puts the space in front itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.coder.id_to_piece(i) for i in range(self.coder.get_piece_size())]
        self.table = [bytes([int(p[3:5], 16)]) if self.coder.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str):
    """Both coders, the byte lengths of their tokens, and the texts of ids with each separator."""
    a, b = ByteLevel(path_a), Pieces(path_b)
    lengths = [np.array([len(x) for x in s.table], np.int64) for s in (a, b)]
    parts = [f"{i}{c}" for s, ends in ((a, ",|"), (b, ",;")) for c in ends for i in range(len(s.table))]
    return a, b, lengths[0], lengths[1], parts


def covering(at: np.ndarray, doc: np.ndarray, start: np.ndarray, start_doc: np.ndarray) -> np.ndarray:
    """For each offset ``at`` the number of the token of the other side that covers it."""
    left = pd.DataFrame({"at": at, "doc": doc})
    right = pd.DataFrame({"at": start, "doc": start_doc, "token": np.arange(len(start))})
    return pd.merge_asof(left, right, on="at", by="doc")["token"].to_numpy(np.int64)


def align(texts: list[str], path_a: str, path_b: str) -> dict:
    """Tokens, groups and links of some texts: flat arrays over all their tokens. ``doc`` arrays
    number the texts; a text whose bytes the sides disagree on has no tokens."""
    a, b, len_a, len_b, _ = sides(path_a, path_b)
    ids_a, ids_b = a.encode(texts), b.encode(texts)
    for k, t in enumerate(texts):
        raw = (" " + t).encode("utf-8", "surrogatepass")
        if not t or b"".join(map(a.table.__getitem__, ids_a[k])) != raw or b"".join(map(b.table.__getitem__, ids_b[k])) != raw:
            ids_a[k] = ids_b[k] = ()
    out = {}
    for side, ids, lens in (("a", ids_a, len_a), ("b", ids_b, len_b)):
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(n.sum()))
        end = np.cumsum(lens[flat])
        out |= {side: flat, f"n_{side}": n, f"end_{side}": end, f"start_{side}": end - lens[flat], f"doc_{side}": np.repeat(np.arange(len(ids)), n)}
    # a token ends a group where the other side ends too
    for x, y in ("ab", "ba"):
        at = np.searchsorted(out[f"end_{y}"], out[f"end_{x}"])
        out[f"closes_{x}"] = out[f"end_{y}"][np.minimum(at, max(len(out[y]) - 1, 0))] == out[f"end_{x}"] if len(out[y]) else np.zeros(0, bool)
    out["n_groups"] = np.bincount(out["doc_a"][out["closes_a"]], minlength=len(texts))
    over_b = covering(out["start_a"], out["doc_a"], out["start_b"], out["doc_b"])
    over_a = covering(out["start_b"], out["doc_b"], out["start_a"], out["doc_a"])
    # pairs that start together are found both ways and kept once
    late = out["start_a"][over_a] < out["start_b"] if len(over_a) else np.zeros(0, bool)
    out["link_a"] = np.concatenate([np.arange(len(over_b)), over_a[late]])
    out["link_b"] = np.concatenate([over_b, np.flatnonzero(late)])
    return out


def group_texts(al: dict, parts: list[str], n_a: int, n_b: int) -> list[str]:
    """Per text its groups as ``a1,a2|b1;a3|b2,b3``."""
    number = {s: np.cumsum(al[f"closes_{s}"]) - al[f"closes_{s}"] for s in "ab"}
    key = np.concatenate([2 * number["a"], 2 * number["b"] + 1])
    part = np.concatenate([al["a"] + n_a * al["closes_a"], 2 * n_a + al["b"] + n_b * al["closes_b"]])
    part = part[np.argsort(key, kind="stable")].tolist()
    ends = np.cumsum(al["n_a"] + al["n_b"]).tolist()
    return ["".join(map(parts.__getitem__, part[s:e]))[:-1] for s, e in zip([0, *ends], ends)]


META = ["n_a", "n_b", "n_groups", "n_links"]


def _batch(rows: list[tuple], folder: str, path_a: str, path_b: str) -> pa.RecordBatch:
    """One row with the batch's distinct pairs; the rest goes to the batch's file. A task that
    runs again writes files of its own, and only those of the attempt that is kept are read."""
    _, _, len_a, len_b, parts = sides(path_a, path_b)
    al = align([t for _, t in rows], path_a, path_b)
    pair = (al["a"][al["link_a"]] << PAIR) + al["b"][al["link_b"]]
    doc = al["doc_a"][al["link_a"]]
    local, pairs = pd.factorize(pair)
    held, times = np.unique(doc * max(len(pairs), 1) + local, return_counts=True)
    n_docs = np.bincount(held % max(len(pairs), 1), minlength=len(pairs)) if len(pairs) else np.zeros(0, np.int64)
    # pairs are numbered by falling count, so that what most documents hold has small numbers
    order = np.argsort(-n_docs, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    held_doc, held = np.divmod(held, max(len(pairs), 1))
    by = np.lexsort((rank[held], held_doc)) if len(held) else np.zeros(0, np.int64)
    number, held_doc, times = rank[held][by] if len(held) else by, held_doc[by], times[by]
    step = np.diff(number, prepend=0)
    first = np.diff(held_doc, prepend=-1) > 0
    step[first] = number[first]
    meta = {"id": pa.array([i for i, _ in rows], pa.int64())}
    counts = {"n_a": al["n_a"], "n_b": al["n_b"], "n_groups": al["n_groups"], "n_links": np.bincount(doc, minlength=len(rows))}
    meta |= {k: pa.array(counts[k], pa.int64()) for k in META}
    texts = group_texts(al, parts, len(len_a), len(len_b))
    meta["sha"] = pa.array([hashlib.sha256(g.encode()).hexdigest() if n else "" for g, n in zip(texts, al["n_a"].tolist())], pa.string())
    meta["n_pairs"] = pa.array(np.bincount(held_doc, minlength=len(rows)), pa.int64())
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pydict(meta)
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    block = uuid.uuid4()
    put(f"{folder}/{block.int >> 65}", [_join([sink.getvalue().to_pybytes(), _planes(step), _planes(times)])])
    pairs = np.asarray(pairs, np.int64)[order]
    return pa.RecordBatch.from_arrays(
        [pa.array([block.int >> 65], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(pairs)),
         pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(n_docs[order].astype(np.int32)))], ["block", "pairs", "n_docs"])


def _reporter(folder: str, path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        rows, size = [], 0
        for batch in batches:
            for i, t in zip(*batch.columns):
                text = t.as_py() or ""
                if rows and size + len(text) > BATCH_CHARS:
                    yield _batch(rows, folder, path_a, path_b)
                    rows, size = [], 0
                rows.append((i.as_py(), text))
                size += len(text)
        if rows:
            yield _batch(rows, folder, path_a, path_b)
    return run


def _settle(block: int, n: np.ndarray, best: np.ndarray, folder: str) -> pa.RecordBatch:
    """One batch: its documents' results, now that the count of each of its pairs is known."""
    lens, raw = _split(get(f"{folder}/{block}"))
    cut = np.cumsum(lens)
    with pa.ipc.open_stream(raw[:cut[0]]) as r:
        docs = r.read_all()
    step, times = _unplanes(raw[cut[0]:cut[1]]).view("<i4").astype(np.int64), _unplanes(raw[cut[1]:cut[2]]).astype(np.int64)
    n_pairs = docs.column("n_pairs").to_numpy()
    ends = np.cumsum(n_pairs)
    number = np.cumsum(step)
    begin = ends - n_pairs
    some = n_pairs > 0
    # numbers are differences inside a document: take off what the ones before it add up to
    before = np.zeros(len(n_pairs), np.int64)
    before[some] = number[begin[some]] - step[begin[some]]
    number -= np.repeat(before, n_pairs)
    held = np.r_[0, np.cumsum(times * best[number])], np.r_[0, np.cumsum(times * n[number])]
    n_best, count_sum = (h[ends] - h[begin] for h in held)
    return pa.RecordBatch.from_arrays(
        [docs.column("id").combine_chunks(), *(docs.column(k).combine_chunks() for k in META), pa.array(n_best, pa.int64()),
         pa.array(count_sum, pa.int64()), docs.column("sha").combine_chunks()],
        ["id", *META, "n_best", "count_sum", "groups_sha256"])


def _settler(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ns, bests = None, [], []
        for batch in batches:
            blocks, n, best = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for s, e in zip(cuts, cuts[1:]):
                if e > s:
                    if block is not None and blocks[s] != block:
                        yield _settle(block, np.concatenate(ns), np.concatenate(bests), folder)
                        ns, bests = [], []
                    block = int(blocks[s])
                    keep = n[s:e] > 0  # a batch without pairs comes with one empty row
                    ns.append(n[s:e][keep].astype(np.int64))
                    bests.append(best[s:e][keep].astype(np.int64))
        if block is not None:
            yield _settle(block, np.concatenate(ns), np.concatenate(bests), folder)
    return run


def pair_counts(reports: DataFrame) -> DataFrame:
    """(pair, n, best): how many documents hold an id pair, and whether that is the most of its A id."""
    from pyspark.sql import Window
    n = (reports.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("r")).groupBy(F.col("r.pairs").alias("pair"))
         .agg(F.sum("r.n_docs").alias("n")))
    # at most one row per B id in a window
    top = F.max("n").over(Window.partitionBy(F.shiftright("pair", PAIR)))
    return n.select("pair", "n", (F.col("n") == top).cast("int").alias("best"))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """The links themselves: (id, a_pos, b_pos, a_id, b_id), one row per pair of token occurrences
    whose bytes overlap, positions from 0. Rows as in ``alignment``."""
    path_a, path_b = path_a or byte_level_path(), path_b or pieces_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(*batch.columns):
                al = align([t.as_py() or ""], path_a, path_b)
                x, y = al["link_a"], al["link_b"]
                by = np.lexsort((y, x))
                cols = [pa.array(c[by], pa.int64()) for c in (x, y, al["a"][x], al["b"][y])]
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(x), pa.int64()), *cols], [id_col, "a_pos", "b_pos", "a_id", "b_id"])

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"`{id_col}` long, a_pos long, b_pos long, a_id long, b_id long"))


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    A null or empty text, or one whose bytes a side does not give back, has no tokens: zeros and
    an empty digest. Rows that repeat an id, and null ids, are documents of their own (each
    counts). Other columns are not read; an empty table gives no rows."""
    path_a, path_b = path_a or byte_level_path(), path_b or pieces_path()
    spark = docs.sparkSession
    folder = scratch(spark, "alignment")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    reports = stored(src.mapInArrow(_reporter(folder, path_a, path_b), "block long, pairs array<long>, n_docs array<int>"), "pairs")
    counts = pair_counts(reports)
    wanted = reports.select("block", F.posexplode("pairs").alias("pos", "pair"))
    known = wanted.join(counts, "pair").select("block", "pos", "n", "best")
    none = reports.where(F.size("pairs") == 0).select("block", F.lit(0).alias("pos"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("best"))
    schema = f"id long, {', '.join(f'{k} long' for k in META)}, n_best long, count_sum long, groups_sha256 string"
    return (known.unionByName(none).repartition("block").sortWithinPartitions("block", "pos").select("block", "n", "best")
            .mapInArrow(_settler(folder), schema).withColumnRenamed("id", id_col))
