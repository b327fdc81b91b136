"""Repeated byte strings by sampled, induced suffix sorting.

Wanted are the bytes covered by a ``LENGTH``-byte string that also starts earlier.
Sorting all suffixes would carry one tuple per byte of the corpus; here, as in induced
sorting, only a locally determined sample of suffixes is sorted and the others are
induced from it:

1. *Sample.* Of every window of ``LENGTH`` bytes the start of its least ``GRAM``-byte
   substring (by hash, leftmost of equals) is a sample position. Equal windows have equal
   samples at equal distance, so a window's fate can be read off its sample. There is one
   sample per about 31 bytes.
2. *Names.* A sample suffix becomes the tuple (name of its gram, name of the bytes of all
   windows it governs, document, position, number of windows).
3. *External sort.* Tuples are dealt by gram name and sorted on disk (Spark's external
   sorter: spilled runs under a merging priority queue). In one pass over the sorted
   stream neighbours with equal names share a common prefix that covers all their
   windows: all but the first are repeats, and every window is induced at once.
4. *Recursion.* Samples whose grams agree but whose surroundings differ share only a part
   of their windows. The first of each surrounding goes down one level, where windows
   themselves are named and sorted in the same way.

Names are pairs of 64-bit hashes of the bytes. Before each sort a task already settles
repeats among its own documents, so a string that fills a third of the corpus sends one
tuple per task and chunk, not one per copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, stored
from .text_hash import mix, prefix, slices

LENGTH = 100
GRAM = 40
CHUNK = 2 << 20      # bytes handled at once in a task
SEGMENT = 4 << 20    # bytes of one document handled at once
_POS = np.uint64((1 << 28) - 1)

TUPLES = "name long, rest long, key long, start int, n int"
RANGES = "key long, start int, n int, name long, open boolean"


def _samples(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(sample, first window, windows) runs over all windows of a byte array; the
    arrays also come with the prefix hashes."""
    h = prefix(data)
    n = len(data) - GRAM + 1
    at = np.arange(n)
    gram = slices(h, at, at + GRAM)
    low = (gram & ~_POS) | at.astype(np.uint64)
    span, have = length - GRAM + 1, 1
    while have * 2 <= span:  # minima over windows of 2, 4, 8, ... grams
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if span > have:
        low = np.minimum(low[:len(low) - (span - have)], low[span - have:])
    return h, gram, (low & _POS).astype(np.int64)


def _first_of(cols: list[np.ndarray], order: list[np.ndarray]) -> np.ndarray:
    """Whether each row is the first of its ``cols`` in ``order``."""
    by = np.lexsort(tuple(reversed(cols + order)))
    new = np.ones(len(by), bool)
    if len(by):
        new[1:] = np.any([c[by][1:] != c[by][:-1] for c in cols], axis=0)
    first = np.empty(len(by), bool)
    first[by] = new
    return first


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Lists of (row values..., text bytes) of about CHUNK bytes."""
    rows, size = [], 0
    for batch in batches:
        for r in zip(*batch.columns):
            t = r[1].as_py()
            raw = t if isinstance(t, bytes) else (t or "").encode("utf-8")
            rows.append((r, raw))
            size += len(raw)
            if size >= CHUNK:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _tuples(length: int):
    """Level one: the sample suffixes of each chunk of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches):
            rows = [(r[0].as_py(), raw) for r, raw in rows if len(raw) >= length]
            parts = []
            for base, keys, starts, data in _segments(rows, length):
                h, gram, sample = _samples(data, length)
                # documents stand one behind the other: windows over an edge do not count
                edge = np.r_[starts, len(data)]
                doc = np.repeat(np.arange(len(starts)), np.diff(edge))[:len(sample)]
                ok = np.flatnonzero(np.arange(len(sample)) + length <= edge[1:][doc])
                if not len(ok):
                    continue
                s = sample[ok]
                cut = np.r_[0, np.flatnonzero((np.diff(s) != 0) | (np.diff(ok) != 1)) + 1]
                a, n = ok[cut], np.diff(np.r_[cut, len(ok)])
                q = s[cut]
                with np.errstate(over="ignore"):
                    rest = mix(slices(h, a, a + n + length - 1) + (q - a).astype(np.uint64))
                parts.append((gram[q].view(np.int64), rest.view(np.int64), keys[doc[a]], a - starts[doc[a]] + base[doc[a]], n))
            if parts:
                yield _settle([np.concatenate(x) for x in zip(*parts)])
    return run


def _segments(rows: list[tuple], length: int):
    """(offset of each part in its document, keys, starts, bytes): whole documents
    together, an oversized one in pieces that hold every window start exactly once."""
    small = [(k, raw) for k, raw in rows if len(raw) <= SEGMENT]
    if small:
        sizes = np.array([len(raw) for _, raw in small])
        yield (np.zeros(len(small), np.int64), np.array([k for k, _ in small], np.int64), np.cumsum(sizes) - sizes,
               np.frombuffer(b"".join(raw for _, raw in small), np.uint8))
    for k, raw in rows:
        if len(raw) > SEGMENT:
            for at in range(0, len(raw) - length + 1, SEGMENT - length + 1):
                part = np.frombuffer(raw, np.uint8, min(SEGMENT, len(raw) - at), at)
                if len(part) >= length:
                    yield np.array([at]), np.array([k], np.int64), np.zeros(1, np.int64), part


def _settle(cols: list[np.ndarray]) -> pa.RecordBatch:
    """Repeats inside one chunk are settled here: their tuples get a negative count
    and a name of their own, and pass through the sort."""
    name, rest, key, start, n = cols
    first = _first_of([name, rest], [key, start])
    alone = mix(key.view(np.uint64) * np.uint64(31) + start.astype(np.uint64)).view(np.int64)
    name = np.where(first, name, alone)
    n = np.where(first, n, -n)
    return pa.RecordBatch.from_arrays(
        [pa.array(name), pa.array(rest), pa.array(key), pa.array(start, pa.int32()), pa.array(n, pa.int32())],
        ["name", "rest", "key", "start", "n"])


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over tuples sorted by (name, rest, key, start).

    All but the first of equal (name, rest) are repeats. The first is left open when
    another rest stands under the same name."""
    seen = None   # (name, rest) of the last unsettled tuple
    held = None   # the last first-of-its-rest, and whether it is known to be open

    def out(key, start, n, name, open_):
        return pa.RecordBatch.from_arrays(
            [pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(name, pa.int64()),
             pa.array(open_, pa.bool_())], ["key", "start", "n", "name", "open"])

    for batch in batches:
        name, rest, key, start, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        done = n < 0
        if done.any():
            yield out(key[done], start[done], -n[done], name[done], np.zeros(int(done.sum()), bool))
            live = ~done
            name, rest, key, start, n = name[live], rest[live], key[live], start[live], n[live]
        if not len(name):
            continue
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (rest[1:] != rest[:-1])
        new[0] = seen != (name[0], rest[0])
        seen = (name[-1], rest[-1])
        if not new.all():
            r = ~new
            yield out(key[r], start[r], n[r], name[r], np.zeros(int(r.sum()), bool))
        f = np.flatnonzero(new)
        if not len(f):
            continue
        names = name[f]
        same = np.zeros(len(f), bool)
        same[1:] = names[1:] == names[:-1]
        tied = held is not None and held[3] == names[0]
        if held is not None and (held[4] or tied):
            yield out([held[0]], [held[1]], [held[2]], [held[3]], [True])
        same[0] = tied
        is_open = same.copy()
        is_open[:-1] |= same[1:]
        body = f[:-1][is_open[:-1]]
        if len(body):
            yield out(key[body], start[body], n[body], name[body], np.ones(len(body), bool))
        k = f[-1]
        held = (int(key[k]), int(start[k]), int(n[k]), name[k], bool(is_open[-1]))
    if held is not None and held[4]:
        yield out([held[0]], [held[1]], [held[2]], [held[3]], [True])


def _windows(length: int):
    """Level two: every window of the open ranges, named by its bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches):
            parts = []
            for r, raw in rows:
                got = r[2].as_py()
                start = np.array([x["start"] for x in got], np.int64)
                n = np.array([x["n"] for x in got], np.int64)
                name = np.array([x["name"] for x in got], np.int64)
                p = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                name = np.repeat(name, n)
                for at in range(0, len(raw), SEGMENT):  # an oversized document in pieces
                    here = (p >= at) & (p < at + SEGMENT)
                    if here.any():
                        q = p[here]
                        h = prefix(np.frombuffer(raw, np.uint8)[at:at + SEGMENT + length])
                        parts.append((name[here], slices(h, q - at, q - at + length).view(np.int64),
                                      np.full(len(q), r[0].as_py(), np.int64), q, np.ones(len(q), np.int64)))
            yield _settle([np.concatenate(x) for x in zip(*parts)])
    return run


def _sorted_stream(tuples: DataFrame, *by: str) -> DataFrame:
    return tuples.repartition(*by).sortWithinPartitions("name", "rest", "key", "start").mapInArrow(_induce, RANGES)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, text) where the key orders documents: the id itself, or, if ids are
    null or repeated, the rank in order of id (nulls last) and text."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    odd = src.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL")
    if odd.isEmpty():
        return src.select(F.col("id").alias("key"), "id", "text")
    ranked = src.orderBy(F.col("id").asc_nulls_last(), F.xxhash64("text"))
    return stored(ranked.select(F.monotonically_increasing_id().alias("key"), "id", "text"), "ranked")


def repeated_ranges(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, start, n): ranges of window starts whose string also starts earlier."""
    one = stored(_sorted_stream(keyed.select("key", "text").mapInArrow(_tuples(length), TUPLES), "name"), "induced")
    # a document's open ranges: as many as its samples
    todo = one.where("open").groupBy("key").agg(F.collect_list(F.struct("start", "n", "name")).alias("ranges"))
    todo = stored(todo, "open-ranges")
    texts = keyed.select("key", "text").join(sized(stored(todo.select("key"), "open-keys")), "key", "left_semi")
    level = texts.join(todo, "key").select("key", "text", "ranges").mapInArrow(_windows(length), TUPLES)
    two = _sorted_stream(level, "name", "rest").where("NOT open")
    return one.where("NOT open").select("key", "start", "n").unionByName(two.select("key", "start", "n"))


def _cutter(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, text, ranges = batch.columns
            n_removed, n_spans, kept, sizes = [], [], [], []
            for t, got in zip(text, ranges):
                raw = np.frombuffer((t.as_py() or "").encode("utf-8"), np.uint8)
                edge = np.zeros(len(raw) + 1, np.int32)
                got = got.as_py()
                start = np.array([x["start"] for x in got], np.int64)
                n = np.array([x["n"] for x in got], np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + n + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                sizes.append(len(raw)), n_removed.append(int(gone.sum()))
                n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(raw[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [key, pa.array(sizes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
                 pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])
    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    Null text counts as empty. Matches stay inside documents; texts shorter than
    ``length`` bytes lose nothing. Order is by id; among null ids (which come last) and
    repeated ids, by text hash, so of rows that repeat id and text one keeps its bytes.
    Other columns are not read; an empty table gives no rows. ``length`` must exceed 40.
    """
    keyed = _keyed(docs, id_col, text_col)
    ranges = repeated_ranges(keyed, length).groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    ranges = stored(ranges, "ranges")
    keys = sized(stored(ranges.select("key"), "range-keys"))
    hit = keyed.join(keys, "key", "left_semi").join(ranges, "key").select("id", "text", "ranges")
    cut = hit.mapInArrow(_cutter(length), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    whole = keyed.join(keys, "key", "left_anti").select(
        "id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.encode("text", "utf-8").alias("kept"))
    return cut.unionByName(whole).withColumnRenamed("id", id_col)
