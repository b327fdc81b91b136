"""Language identification by word-first backoff.

A known word scores its log frequency in each language. An unseen word falls back
to its character n-grams (with word-edge marks): the longest n-grams that the
model knows, each position trying n = 5, 4, ... 1 in turn, and the mean over its
positions. The language with the largest sum over the words of the whole text plus
the log share of labelled documents wins; the score is its posterior probability
with the evidence tempered by the square root of the number of words, so that it
does not saturate on long texts.

Training counts labelled rows only. Shares of languages come from all of them; word and
n-gram counts from a bounded sample, about ``DOCS_PER_LANGUAGE`` documents of each
language picked by a hash of the row, and the model keeps the most frequent
``WORDS_PER_LANGUAGE`` words and ``GRAMS_PER_LANGUAGE`` n-grams, so its size is
bounded whatever the corpus. Prediction reads every text whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DOCS_PER_LANGUAGE = 2_000
WORDS_PER_LANGUAGE = 20_000
GRAMS_PER_LANGUAGE = 20_000
MAX_LANGUAGES = 200
MAX_GRAM = 5
MAX_WORD = 64          # letters of a word; longer runs count as several, in training and scoring alike
CACHE_WORDS = 50_000   # unseen words whose scores a task remembers
FLUSH = 50_000         # counts a task holds before it hands them to Spark
UNDETERMINED = "und"
CANDIDATE = re.compile(rf"[^\W\d_]{{1,{MAX_WORD}}}")  # letters, and a few numeric signs removed below


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters, long ones in consecutive pieces of MAX_WORD letters."""
    found = CANDIDATE.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    out = []
    for w in found:
        if w.isalpha():
            out.append(w)
        else:
            out += "".join(c if c.isalpha() else " " for c in w).split()
    return out


def grams_of(word: str) -> Iterator[list[str]]:
    """Per position of the marked word: its n-grams from the longest to the shortest."""
    w = f" {word} "
    for i in range(len(w) - 1):
        yield [w[i:i + n] for n in range(min(MAX_GRAM, len(w) - i), 0, -1)]


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    words: dict[str, int]      # row of a known word in `word_scores`
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray

    def backoff(self, word: str) -> np.ndarray:
        """Scores of an unseen word: mean of the longest known n-gram of each position."""
        at = []
        for options in grams_of(word):
            for g in options:
                k = self.grams.get(g)
                if k is not None:
                    at.append(k)
                    break
        return self.gram_scores[at].mean(axis=0) if at else np.zeros(len(self.languages))


def _table(rows: list, languages: list[str], totals: dict[str, int]) -> tuple[dict[str, int], np.ndarray]:
    """Rows of the keys and their log shares in each language; half a count stands for unseen."""
    at = {x: i for i, x in enumerate(languages)}
    keys: dict[str, int] = {}
    for key, _, _ in rows:
        keys.setdefault(key, len(keys))
    counts = np.full((len(keys), len(languages)), 0.5)
    for key, lang, n in rows:
        counts[keys[key], at[lang]] += n
    return keys, np.log(counts / np.array([totals.get(x, 0) + 1.0 for x in languages]))


def word_counts(text: str) -> Counter:
    """The words of a text with how often each occurs, in order of first occurrence."""
    found = Counter(CANDIDATE.findall(text.lower()))
    return found if all(map(str.isalpha, found)) else Counter(words_of(text))


def _counts(got: dict[tuple, int], name: str) -> pa.RecordBatch:
    k = list(got)
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in k], pa.string()), pa.array([x[1] for x in k], pa.string()),
                                       pa.array(list(got.values()), pa.int64())], [name, "lang", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Model of the rows that are not held out and have text and a language."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("id")))
    shares = rows.groupBy("lang").agg(F.count("*").alias("n"))
    top = {r["lang"]: r["n"] for r in shares.orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    languages = sorted(top)
    if not languages:
        return Model([], np.zeros(0), {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    keep = F.lit(0.0)
    for lang, n in top.items():
        keep = F.when(F.col("lang") == lang, min(1.0, docs_per_language / n)).otherwise(keep)
    # the hash of id and text picks the same rows at every run and any partitioning
    drawn = F.pmod(F.xxhash64("id", "text", F.lit(17)), F.lit(1 << 20)) < keep * (1 << 20)
    sample = rows.where(drawn).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[tuple, int] = {}
        for batch in batches:  # partial counts, summed up by Spark
            for t, lang in zip(*batch.columns):
                lang = lang.as_py()
                for w in words_of(t.as_py()):
                    got[w, lang] = got.get((w, lang), 0) + 1
                if len(got) > FLUSH:
                    yield _counts(got, "word")
                    got = {}
        yield _counts(got, "word")

    words = sample.mapInArrow(count, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[tuple, int] = {}
        for batch in batches:
            for w, lang, n in zip(*(c.to_pylist() for c in batch.columns)):
                for options in grams_of(w):
                    for g in options:
                        got[g, lang] = got.get((g, lang), 0) + n
                if len(got) > FLUSH:
                    yield _counts(got, "key")
                    got = {}
        yield _counts(got, "key")

    words = words.persist()
    try:
        grams = words.mapInArrow(cut, "key string, lang string, n long").groupBy("key", "lang").agg(F.sum("n").alias("n"))

        def best(df: DataFrame, key: str, most: int) -> list:
            rank = W.partitionBy("lang").orderBy(F.desc("n"), key)
            # bounded by most * MAX_LANGUAGES rows
            return df.where("n > 1").withColumn("r", F.row_number().over(rank)).where(F.col("r") <= most).select(key, "lang", "n").collect()

        word_total = {r[0]: r[1] for r in words.groupBy("lang").agg(F.sum("n")).collect()}
        word_rows, gram_rows = best(words, "word", WORDS_PER_LANGUAGE), best(grams, "key", GRAMS_PER_LANGUAGE)
    finally:
        words.unpersist()
    gram_total = {x: word_total.get(x, 0) * 4 for x in languages}
    total = sum(top.values())
    return Model(languages, np.array([math.log(top[x] / total) for x in languages]),
                 *_table(word_rows, languages, word_total), *_table(gram_rows, languages, gram_total))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(id, lang_pred, score) of every row; see :func:`identify`. With ``carry`` the named
    columns come first instead of the id, so that rows can be chosen where they are; a text
    among them goes to Python once."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the model's parameters
    carried = [F.col(id_col).cast("long").alias(id_col)] if carry is None else [F.col(c) for c in carry]
    scored = len(carried) if carry is None or text_col not in carry else carry.index(text_col)
    src = docs.select(*carried, *([F.col(text_col).alias("_scored")] if scored == len(carried) else []))
    kept = src.schema.fields[:len(carried)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        known = len(m.words)
        seen = dict(m.words)  # known words first, then remembered unseen ones
        scores = np.concatenate([m.word_scores, np.zeros((CACHE_WORDS, len(m.languages)))])
        for batch in batches:
            lang, score = [], []
            for t in batch.column(scored):
                words = word_counts(t.as_py() or "")
                if not words or not m.languages:
                    lang.append(UNDETERMINED), score.append(0.0)
                    continue
                at = list(map(seen.get, words))
                if None in at:
                    new = []
                    for k, w in enumerate(words):
                        if at[k] is None:
                            at[k] = seen[w] = len(seen)
                            new.append(m.backoff(w))
                    if len(seen) > len(scores):  # the buffer doubles, so that adding rows stays cheap
                        scores = np.concatenate([scores, np.zeros((len(seen), scores.shape[1]))])
                    scores[len(seen) - len(new):len(seen)] = new
                n = np.fromiter(words.values(), np.float64, len(words))
                s = n @ scores[at] + m.prior
                best = int(s.argmax())
                p = np.exp((s - s[best]) / math.sqrt(n.sum()))
                lang.append(m.languages[best]), score.append(float(1.0 / p.sum()))
                if len(seen) - known > CACHE_WORDS:
                    seen = dict(m.words)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             [*(f.name for f in kept), "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string", "score double"])
    return src.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score.

    ``und`` with score 0 where the text is null or has no letter, and everywhere if
    no labelled row exists. Equal scores go to the alphabetically first language.
    A null id is not held out. Repeated rows are predicted alike. Columns besides id,
    text and language are not read; an empty table gives no rows.
    """
    out = predict(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
