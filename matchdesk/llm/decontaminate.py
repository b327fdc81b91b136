"""Benchmark decontamination by a distributed positional inverted index.
DataFrame functions only.

The index stores one posting (row, term, position) for every token of the
training texts that is a test term, in document order, without a shuffle.
Lookups go from the rarest test terms: each test window starts from the postings
of its rarest term, is intersected with the offset-adjusted postings of its
second rarest, and the alignments that survive both are intersected with the
postings of all remaining terms. Runs of consecutive matched offsets on one
alignment that reach the window length are the exact phrase matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, sized, stored

# Words of the lower-cased text; A-Z joins the class because lower-casing maps
# it into a-z, so the words can be cut first and lower-cased one by one.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
END = ""  # pseudo-term whose position is the number of words of the row


def _words(docs: DataFrame, text_col: str, *keep) -> DataFrame:
    """(keep..., pos, word) and one closing row per text at pos = number of words."""
    words = F.coalesce(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
    cut = docs.select(*keep, words.alias("words"))
    names = cut.columns[:-1]
    rows = cut.select(*names, F.posexplode(F.concat("words", F.array(F.lit(END)))).alias("pos", "w"))
    return rows.select(*names, "pos", ascii_lower(F.col("w")).alias("word"))


@dataclass
class PositionalIndex:
    postings: DataFrame  # rid, doc_id, term, pos
    items: DataFrame     # iid, item_id, ipos, term, m (words of the item)

    @property
    def rows(self) -> DataFrame:
        """One row per indexed text: rid, doc_id, n_words."""
        return self.postings.where("term = -1").select("rid", "doc_id", F.col("pos").cast("long").alias("n_words"))


def build_index(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                item_col: str = "item_id", item_text: str = "text") -> PositionalIndex:
    it = stored(_words(items, item_text, F.monotonically_increasing_id().alias("iid"),
                       F.col(item_col).alias("item_id")), "items")
    vocab = stored(it.where(F.col("word") != END).select("word").distinct()
                   .select("word", F.monotonically_increasing_id().alias("term")), "terms")
    vocab = vocab.unionByName(vocab.sparkSession.range(1).select(
        F.lit(END).alias("word"), F.lit(-1).cast("long").alias("term")))
    tokens = _words(docs, text_col, F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"))
    postings = tokens.join(sized(vocab, "word"), "word").select(
        "rid", F.when(F.col("term") == -1, F.col("doc_id")).alias("doc_id"), "term", "pos")
    size = it.where(F.col("word") == END).select("iid", F.col("pos").alias("m"))
    terms = it.where(F.col("word") != END).withColumnRenamed("pos", "ipos").join(vocab, "word").join(size, "iid")
    return PositionalIndex(stored(postings, "postings"),
                           stored(terms.select("iid", "item_id", "ipos", "term", "m"), "item-terms"))


def _windows(index: PositionalIndex, window: int) -> DataFrame:
    """Each test window with its two rarest terms: (iid, at, term, by, term2)
    where ``at`` is the item position of the rarest term and ``by`` the distance
    to the second rarest (null for one-word windows). Windows with a term that
    no training text holds are left out: they cannot occur."""
    df = index.postings.where("term >= 0").groupBy("term").agg(F.count("*").alias("df"))
    rare = index.items.join(df, "term")
    size = F.least(F.lit(window), F.col("m"))
    first = F.greatest(F.lit(0), F.col("ipos") - size + 1)
    last = F.least(F.col("ipos"), F.col("m") - size)
    wins = rare.select("iid", "m", "ipos", "term", "df", F.explode(F.sequence(first, last)).alias("start"))
    # a window has at most `window` terms, so this list is bounded
    best = wins.groupBy("iid", "start", "m").agg(
        F.array_sort(F.collect_list(F.struct("df", "ipos", "term"))).alias("t"))
    best = best.where(F.size("t") == F.least(F.lit(window), F.col("m")))
    a, b = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    return best.select("iid", a["ipos"].alias("at"), a["term"].alias("term"),
                       (b["ipos"] - a["ipos"]).alias("by"), b["term"].alias("term2")).distinct()


def _narrow(index: PositionalIndex, rids: DataFrame) -> DataFrame:
    """Postings of the given rows: by broadcast when the ids are few, else by shuffle."""
    return index.postings.where("term >= 0").select("rid", "term", "pos").join(
        sized(stored(rids.distinct(), "rids")), "rid", "left_semi")


def alignments(index: PositionalIndex, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Distinct (rid, iid, diag): a window's two rarest terms meet at the right
    distance (within ``slop``) when the item is laid at word ``diag`` of the row."""
    wins = stored(_windows(index, window), "windows")
    post = index.postings.where("term >= 0").select("rid", "term", "pos")
    start = post.join(sized(wins), "term").select(
        "rid", "iid", (F.col("pos") - F.col("at")).alias("diag"), "term2", (F.col("pos") + F.col("by")).alias("pos2"))
    alone = start.where("term2 IS NULL").select("rid", "iid", "diag")
    pairs = start.where("term2 IS NOT NULL")
    if slop:
        pairs = pairs.withColumn("pos2", F.explode(F.sequence(F.col("pos2") - slop, F.col("pos2") + slop)))
    second = post.join(sized(wins.where("term2 IS NOT NULL").select(F.col("term2").alias("term")).distinct()),
                       "term", "left_semi").select("rid", F.col("term").alias("term2"), F.col("pos").alias("pos2"))
    both = pairs.join(second, ["rid", "term2", "pos2"]).select("rid", "iid", "diag")
    return stored(both.unionByName(alone).distinct(), "alignments")


def phrase_matches(index: PositionalIndex, window: int = WINDOW) -> DataFrame:
    """Maximal exact matches: (rid, iid, start, n_words) with n_words at least the
    window, or the whole item if that is shorter."""
    found = alignments(index, window)
    expected = found.join(sized(index.items.select("iid", "ipos", "term", "m")), "iid").select(
        "rid", "iid", "diag", "ipos", "m", "term", (F.col("diag") + F.col("ipos")).alias("pos"))
    hit = expected.join(_narrow(index, found.select("rid")), ["rid", "term", "pos"])
    run = hit.withColumn("run", F.col("ipos") - F.row_number().over(
        W.partitionBy("rid", "iid", "diag").orderBy("ipos")))
    runs = run.groupBy("rid", "iid", "diag", "run", "m").agg(
        F.min("pos").alias("start"), F.count("*").alias("n_words"))
    return runs.where(F.col("n_words") >= F.least(F.lit(window), F.col("m"))).select("rid", "iid", "start", "n_words")


def proximity_matches(index: PositionalIndex, window: int = WINDOW, slop: int = 2) -> DataFrame:
    """(rid, iid, start, at): windows of an item whose every word lies within
    ``slop`` words of its place when the window is laid at ``at`` of the row.
    ``slop=0`` gives the exact phrase windows."""
    found = alignments(index, window, slop)
    size = F.least(F.lit(window), F.col("m"))
    near = found.join(sized(index.items.select("iid", "ipos", "term", "m")), "iid").select(
        "rid", "iid", "diag", "ipos", "m", "term",
        F.explode(F.sequence(F.col("diag") + F.col("ipos") - slop, F.col("diag") + F.col("ipos") + slop)).alias("pos"))
    hit = near.join(_narrow(index, found.select("rid")), ["rid", "term", "pos"]).select(
        "rid", "iid", "diag", "ipos", "m").distinct()
    wins = hit.select("rid", "iid", "diag", "m", F.explode(F.sequence(
        F.greatest(F.lit(0), F.col("ipos") - size + 1), F.least(F.col("ipos"), F.col("m") - size))).alias("start"))
    return (wins.groupBy("rid", "iid", "diag", "start", "m").count()
            .where(F.col("count") == size)
            .select("rid", "iid", "start", (F.col("diag") + F.col("start")).alias("at")))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and wordless texts have no words and no hits; null or empty items match
    nothing. Repeated rows are judged one by one; items that repeat an id count
    as one, items without an id hit words but are not counted. Other columns are
    not read. Empty tables give no rows, or no hits.
    """
    index = build_index(docs, items, id_col, text_col, item_col, item_text)
    spans = stored(phrase_matches(index, window), "phrase-matches")
    words = (spans.select("rid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n_words").cast("int") - 1)).alias("pos"))
             .distinct().groupBy("rid").agg(F.count("*").alias("n_hit")))
    ids = index.items.select("iid", F.col("item_id").cast("string").alias("item")).distinct()
    which = (spans.select("rid", "iid").distinct().join(ids, "iid").groupBy("rid")
             .agg(F.array_sort(F.collect_set("item")).alias("items")))
    out = index.rows.join(words.join(which, "rid"), "rid", "left")
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("doc_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items_found).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_found, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
il AS (SELECT item_id, w, least(10, len(w)) AS k FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM il)),
ks AS (SELECT DISTINCT k FROM win),
grams AS (SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, s, grams.k, item_id FROM grams JOIN win ON grams.g = win.g AND grams.k = win.k),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
