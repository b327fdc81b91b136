"""MinHash near-dedup: one-permutation hashing with optimal densification,
banded buckets and star-shaped candidate edges.

Signatures. A document's set of 5-word shingles is hashed once; the hash range
is cut into ``BINS`` bins and each bin keeps its smallest hash. Empty bins borrow
from a non-empty bin picked by a hash of (bin, attempt), the densification that
keeps the collision probability equal to the similarity.

Candidates. Documents with equal sets collapse into one class first. ``BANDS``
bands of ``ROWS`` bins form buckets. In a bucket only stars are formed: one
centre a round, and each member goes with one centre of another component, that of
most buckets in common, so n classes cost n edges a round, however many buckets they
share. What is linked so far is joined into
components, and buckets that lie in one component leave. Rounds with new centres
go on while at least one comparison in ``YIELD`` is a link.

Members that link with nothing would need a centre each. So the members of the
buckets that stay open go through an exact filter instead: shingles are put in
one order, the rarest first, and two sets of sizes m <= n can only be linked if
the first ``m - ceil(2tm / (1 + t)) + 1`` shingles of the smaller and the first
``n - ceil(tn) + 1`` of the larger have one in common, standing where enough
others may still follow in both (t is the similarity asked for). A set whose
rarest shingles are its own is compared with nothing. No bucket is capped and no
link between two components is skipped.

Confirmation is exact, on the full shingle sets; pairs whose set sizes alone rule
a link out are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import sized, stored
from .components import components
from .text_hash import mix

SHINGLE = 5
ROWS = 5
BANDS = 32
BINS = ROWS * BANDS
PERCENT = 85
YIELD = 10           # comparisons a link may cost before stars give way to the filter
WORDS_HELD = 1 << 20  # word hashes a task keeps at hand
TOKEN_ROWS = 1 << 18  # rows of an Arrow batch of shingles

_EDGES = np.array([(i << 64) // BINS for i in range(BINS)], dtype=np.uint64)
_CHAIN = np.uint64(0x9E3779B97F4A7C15)
_BAND_SEED = mix(np.arange(1, BINS + 1, dtype=np.uint64))


class _WordHashes(dict):
    """64-bit hash of each word, computed once per task while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _WordHashes()


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's 5-word shingles (A-Z lowered,
    words cut at ASCII white space); all words as one if there are fewer. Word
    hashes are chained through a mixer, so no structure of the text survives."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = mix(h * _CHAIN + ids[i:len(words) - k + 1 + i])
    return np.unique(h)


def _donors(attempt: np.ndarray) -> np.ndarray:
    """Bin that each bin asks at each attempt: a fixed hash of (bin, attempt)."""
    bins = np.arange(BINS, dtype=np.uint64)[:, None]
    with np.errstate(over="ignore"):
        return (mix(bins * np.uint64(1_000_003) + attempt.astype(np.uint64)[None, :] + np.uint64(77)) % np.uint64(BINS)).astype(np.int64)


_FIRST = _donors(np.arange(32))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Densified one-permutation signature of a sorted, non-empty hash set."""
    at = np.searchsorted(hashes, _EDGES)
    nxt = np.append(at[1:], len(hashes))
    full = nxt > at
    sig = np.zeros(BINS, np.uint64)
    sig[full] = hashes[at[full]]
    empty = np.flatnonzero(~full)
    table, base = _FIRST, 0
    while len(empty):
        ok = full[table[empty]]
        found = ok.any(axis=1)
        rows = empty[found]
        sig[rows] = sig[table[rows, ok[found].argmax(axis=1)]]
        empty = empty[~found]
        base += table.shape[1]
        if len(empty):
            table = _donors(np.arange(base, base + 512))
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((mix(sig + _BAND_SEED) * (_BAND_SEED | np.uint64(1))).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rid, doc, text = batch.columns
        n, lo, hi, bands = [], [], [], []
        for t in text:
            s = shingle_hashes(t.as_py())
            n.append(len(s))
            if len(s):
                with np.errstate(over="ignore"):
                    lo.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                    hi.append(int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64)))
                bands.append(band_keys(signature(s)).view(np.int64))
            else:
                lo.append(None), hi.append(None), bands.append(None)
        yield pa.RecordBatch.from_arrays(
            [rid, doc, pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()),
             pa.array(bands, pa.list_(pa.int64()))], ["rid", "doc_id", "n_shingles", "lo", "hi", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rid, text = batch.columns
        yield pa.RecordBatch.from_arrays(
            [rid, pa.array([shingle_hashes(t.as_py()).tobytes() for t in text], pa.binary())], ["rid", "set"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of intersection and sets of each pair."""
    for batch in batches:
        a, b, x, y = batch.columns
        both, na, nb = [], [], []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
            merged = np.sort(np.concatenate([p, q]), kind="stable")
            both.append(int((merged[1:] == merged[:-1]).sum()))
            na.append(len(p)), nb.append(len(q))
        yield pa.RecordBatch.from_arrays(
            [a, b, pa.array(both, pa.int64()), pa.array(na, pa.int64()), pa.array(nb, pa.int64())],
            ["a", "b", "both", "na", "nb"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shingle of each set."""
    for batch in batches:
        for rid, held in zip(*batch.columns):
            held = np.frombuffer(held.as_buffer(), np.int64)
            for at in range(0, len(held), TOKEN_ROWS):
                part = held[at:at + TOKEN_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), rid.as_py(), np.int64)), pa.array(part)], ["rid", "token"])


def _could_link(m: Column, n: Column, percent: int) -> Column:
    return 100 * F.least(m, n) >= percent * F.greatest(m, n)


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of the distinct pairs (a, b), on the full sets."""
    ids = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
    sets = sets.join(sized(stored(ids, "paired")), "rid", "left_semi")  # only the sets that are needed
    x = sets.select(F.col("rid").alias("a"), F.col("set").alias("x"))
    y = sets.select(F.col("rid").alias("b"), F.col("set").alias("y"))
    joined = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    sizes = joined.mapInArrow(_shared, "a long, b long, both long, na long, nb long")
    union = F.col("na") + F.col("nb") - F.col("both")
    return stored(sizes.where(100 * F.col("both") >= percent * union).select("a", "b"), "links")


def _star(live: DataFrame, used: DataFrame | None, percent: int) -> tuple[DataFrame, DataFrame]:
    """Centres (bucket, c) and distinct pairs (a, b): each member with one centre of its buckets,
    of another component, the one that it shares most buckets with. A bucket's centre is the
    member, not used before, that meets most rows over all its buckets (``weight``): in a group of
    edited copies that is the one closest to their common text."""
    free = live if used is None else live.join(used.withColumnRenamed("c", "rid"), ["bucket", "rid"], "left_anti")
    centres = free.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rid")).alias("o"), "rid", "size", "root")).alias("c"))
    centres = stored(centres.select("bucket", "c.rid", "c.size", "c.root").toDF("bucket", "c", "c_size", "c_root"), "centres")
    star = live.join(centres, "bucket").where(
        (F.col("root") != F.col("c_root")) & _could_link(F.col("size"), F.col("c_size"), percent))
    near = star.groupBy("rid", "c").agg(F.count("*").alias("n"))
    near = near.groupBy("rid").agg(F.max(F.struct("n", (-F.col("c")).alias("c"))).alias("m")).select("rid", (-F.col("m.c")).alias("c"))
    pairs = near.select(F.least("rid", "c").alias("a"), F.greatest("rid", "c").alias("b")).distinct()
    return centres.select("bucket", "c"), stored(pairs, "pairs")


def _filtered(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of members of different components that the order of
    shingles cannot rule out (see the module's docstring)."""
    rest = stored(live.select("rid", "size", "root").distinct(), "open")
    tokens = sets.join(sized(rest.select("rid")), "rid", "left_semi").select("rid", "set").mapInArrow(_tokens, "rid long, token long")
    tokens = stored(tokens, "tokens")
    often = stored(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "shared-tokens")
    # shingles of one set only stand first; the others are counted from the end
    back = F.row_number().over(W.partitionBy("rid").orderBy(F.desc("n"), F.desc("token")))
    n_shared = F.count("*").over(W.partitionBy("rid"))
    ranked = tokens.join(often, "token").select("rid", "token", back.alias("back"), n_shared.alias("n_shared")).join(sized(rest), "rid")
    ranked = ranked.withColumn("before", F.col("n_shared") - F.col("back"))
    ranked = ranked.withColumn("at", F.col("size") - F.col("back"))
    front = ranked.where(F.col("at") <= F.col("size") - F.ceil(F.lit(percent) * F.col("size") / 100))
    front = stored(front.select("token", "rid", "size", "root", "at", "before", "back"), "fronts")
    several = front.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    front = front.join(sized(stored(several.select("token"), "front-tokens")), "token", "left_semi")
    small = front.where(F.col("at") <= F.col("size") - F.ceil(F.lit(2 * percent) * F.col("size") / (100 + percent)))
    small = small.select("token", *(F.col(c).alias(f"{c}_s") for c in ("rid", "size", "root", "before", "back")))
    both = small.join(front, "token").where(
        (F.struct("size_s", "rid_s") < F.struct("size", "rid")) & (F.col("root_s") != F.col("root"))
        & (100 * F.col("size_s") >= percent * F.col("size")))
    # in common: at most the shared shingles before this one in both, itself, and what follows in both
    most = F.least("before_s", "before") + F.least("back_s", "back")
    both = both.where((100 + percent) * most >= percent * (F.col("size_s") + F.col("size")))
    return stored(both.select(F.least("rid_s", "rid").alias("a"), F.greatest("rid_s", "rid").alias("b")).distinct(), "pairs")


def _buckets(sig: DataFrame) -> DataFrame:
    """(bucket, rid, size) of one representative per class of equal sets, in buckets of two and more."""
    reps = sig.where("n_shingles > 0").groupBy("lo", "hi", "n_shingles").agg(F.min("rid").alias("rid"))
    keys = sig.join(reps.select("rid"), "rid", "left_semi").select("rid", "n_shingles", F.posexplode("bands").alias("band", "key"))
    keys = keys.select("rid", F.xxhash64("band", "key").alias("bucket"), F.col("n_shingles").alias("size"))
    many = keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return stored(keys.join(many, "bucket"), "buckets")


def near_components(docs: DataFrame, sig: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, root) of the classes of equal sets that are linked, as row ids."""
    first = _buckets(sig)
    wanted = stored(first.select("rid").distinct(), "candidates")
    texts = docs.select("rid", "text").join(sized(wanted), "rid", "left_semi")
    sets = stored(texts.mapInArrow(_sets, "rid long, set binary"), "shingle-sets")
    sizes = first.groupBy("bucket").agg(F.count("*").alias("n"))
    weight = first.join(sizes, "bucket").groupBy("rid").agg(F.sum("n").alias("weight"))
    first = stored(first.join(sized(stored(weight, "weights")), "rid"), "weighted")
    live, known, used = first.withColumn("root", F.col("rid")), None, None
    while True:
        centres, pairs = _star(live, used, percent)
        used = centres if used is None else used.unionByName(centres)
        links = _links(pairs, sets, percent)
        n_pairs, n_links = pairs.count(), links.count()
        if known is None or n_links:
            known = _joined(known, links)
            now = first.join(known.withColumnRenamed("node", "rid"), "rid", "left")
            now = now.withColumn("root", F.coalesce("root", "rid"))
            busy = now.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
            live = stored(now.join(busy.select("bucket"), "bucket", "left_semi"), "live")
        if live.isEmpty():
            return known
        if n_links * YIELD < n_pairs:
            break
    links = _links(_filtered(live, sets, percent), sets, percent)
    return known if links.isEmpty() else _joined(known, links)


def _joined(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of the links found, on top of those known."""
    if known is not None:
        links = links.unionByName(known.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return stored(components(links), "components")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Documents are linked when ``100 * intersection >= percent * union`` of their
    shingle sets; a component is named by its smallest id. Null, empty and
    wordless texts have no shingles, link with nothing and are kept. Rows that
    repeat an id are separate nodes; if their sets are equal they share a component
    and are both kept when theirs is the smallest id. A component whose ids are all
    null has a null name and keeps all its rows. Other columns are not read.
    """
    src = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"),
                      F.col(text_col).alias("text"))
    src = stored(src, "texts")  # fixes the row ids for both passes
    sig = stored(src.mapInArrow(_signatures, "rid long, doc_id long, n_shingles long, lo long, hi long, bands array<long>"), "signatures")
    comp = near_components(src, sig, percent)
    sets = ["lo", "hi", "n_shingles"]
    # per class of equal sets: its smallest row and id, then its component's root
    full = sig.where("n_shingles > 0")
    classes = full.groupBy(*sets).agg(F.min("rid").alias("node"), F.min("doc_id").alias("low"))
    classes = classes.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = stored(classes.join(names, "root").select(*sets, "component_id"), "classes")
    linked = full.select("doc_id", *sets).join(classes, sets).select("doc_id", "n_shingles", "component_id")
    alone = sig.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("doc_id").alias(id_col), "n_shingles", "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
