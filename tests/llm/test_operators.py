"""Each operator against its brute-force version: the smallest given tables and made-up odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchdesk.llm import bpe, decontaminate, exact_dedup, html_text, language_id, line_dedup, minhash_dedup
from matchdesk.llm import suffix_dedup, token_files, training_order
from matchdesk.llm.components import components
from matchdesk.llm.queries import ORACLE, QUERIES, token_digests
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.conftest import key, rows_of
from tools.oracle_check import compare


@pytest.fixture(params=["small", "odd"])
def both(request, small_docs, small_rows, odd_docs, odd_rows):
    return (small_docs, small_rows) if request.param == "small" else (odd_docs, odd_rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck_small, name):
    r = compare(spark, SF_SMALL, name, QUERIES[name], ORACLE[name], duck_small)
    assert r["values"], r


def test_exact(both):
    got = rows_of(exact_dedup.exact_dedup(both[0], fan_in=2), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(brute.exact(both[1]), key=key)


def test_decontaminate(spark, both):
    docs, rows = both
    some = [t for _, t in rows if t and len(t.split()) > 40]
    items = [(1, " ".join(some[0].split()[5:30])), (2, " ".join(some[1].split()[3:9])), (2, "ONE two"), (3, None), (4, ""),
             (None, " ".join(some[2].split()[10:22])), (10, "one"), (5, "never seen words " * 6)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("rid", F.lit(0))
    got = rows_of(decontaminate.decontaminate(docs, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(brute.leaks(rows, items), key=key)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b x c d e f"), (2, "a b c d e"), (3, "e d c b a"), (4, "a b q q q q c d e")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "A B C D E")], "item_id long, text string")
    index = decontaminate.build_index(docs, items)
    rid = {r["rid"]: r["doc_id"] for r in index.rows.collect()}
    near = {rid[r["rid"]] for r in decontaminate.proximity_matches(index, slop=2).collect()}
    exact = {rid[r["rid"]] for r in decontaminate.proximity_matches(index, slop=0).collect()}
    assert exact == {2} == {rid[r["rid"]] for r in decontaminate.phrase_matches(index).collect()}
    assert near == {1, 2}


def test_near(both):
    got = rows_of(minhash_dedup.near_dedup(both[0]), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.near(both[1]), key=key)


def test_near_chain(spark):
    """Members that link only through others, whatever the centres."""
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[k * 12:k * 12 + 200])) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = rows_of(minhash_dedup.near_dedup(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.near(rows), key=key)


def test_near_lengths(spark):
    """Prefixes of a text, at and around the length ratio where a link just holds."""
    rows = [(n * 1000 + k, " ".join(f"t{n}w{i}" for i in range(k + 4))) for n in (20, 100, 340)
            for k in {n, n * 85 // 100, n * 85 // 100 - 1, n * 85 // 100 + 1, n * 7225 // 10000}]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(minhash_dedup.near_dedup(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.near(rows), key=key)


def test_near_links_between_linked_members(spark, monkeypatch):
    """One bucket of seven: 6 and 7 are linked to centres of different components in the
    second round, and only their own link joins those."""
    words = [f"w{k}" for k in range(200)]
    at = {2: 0, 6: 8, 7: 16, 3: 24}  # windows of 100 shingles: a shift of 8 links, of 16 does not
    rows = [(i, " ".join(words[at[i]:at[i] + 104] if i in at else [f"u{i}x{k}" for k in range(104)])) for i in range(1, 8)]
    bucket = spark.createDataFrame([(1, i, 100) for i, _ in rows], "bucket long, rid long, size long")
    monkeypatch.setattr(minhash_dedup, "_buckets", lambda sig: bucket)
    got = minhash_dedup.near_components(spark.createDataFrame(rows, "rid long, text string"), None)
    assert {r["node"]: r["root"] for r in got.collect()} == {2: 2, 3: 2, 6: 2, 7: 2}


@pytest.mark.parametrize("cost", [0, 10**9])
def test_near_filter_and_stars_agree(spark, monkeypatch, cost):
    """Edited copies around the threshold: by the filter after one star round, and by stars alone."""
    rnd = random.Random(11)
    rows = []
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(rnd.choice([30, 120, 260]))]
        for _ in range(25):
            w = list(base[:len(base) - rnd.randint(0, 8)])
            for _ in range(rnd.randint(0, 1 + len(base) // 50)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(40)}"
            rows.append((len(rows), " ".join(w)))
    monkeypatch.setattr(minhash_dedup, "YIELD", cost)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = rows_of(minhash_dedup.near_dedup(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.near(rows), key=key)


def test_shingle_hashes_tell_doubled_words_apart():
    """Words built by doubling with a swap, which polynomial hashes modulo 2^64 confuse."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    assert minhash_dedup.shingle_hashes(a) != minhash_dedup.shingle_hashes(b)
    assert len(minhash_dedup.shingle_hashes(" ".join(["x", a, b] * 4))) == 3
    assert minhash_dedup.shingle_hashes("A b c").tolist() == minhash_dedup.shingle_hashes("a\tB  c").tolist()


def test_components(spark):
    """A path, a cycle, a star, a pair and a two-way repeated edge."""
    edges = [(i, i + 1) for i in range(10, 60)] + [(100, 104), (104, 102), (102, 100)] + [(200, 200 + i) for i in range(1, 9)]
    edges += [(301, 300), (300, 301), (400, 400)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 10 for i in range(10, 61)} | {i: 100 for i in (100, 102, 104)} | {200 + i: 200 for i in range(9)} | {300: 300, 301: 300}
    assert got == want


def test_signature_estimates_similarity():
    rnd = np.random.default_rng(1)
    for size in (1, 3, 20, 400):
        a = np.unique(rnd.integers(0, 1 << 63, size).astype(np.uint64) * 2)
        b = np.unique(np.concatenate([a[: max(1, int(len(a) * 0.9))], rnd.integers(0, 1 << 63, max(1, size // 10)).astype(np.uint64) * 2]))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        same = (minhash_dedup.signature(a) == minhash_dedup.signature(b)).mean()
        assert abs(same - j) < 0.35 if size < 20 else abs(same - j) < 0.15


def test_repeats(both):
    docs, rows = both
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    got = rows_of(suffix_dedup.suffix_dedup(docs).withColumn("h", F.sha2("kept", 256)), "doc_id", "n_bytes", "n_removed", "n_spans", "h")
    assert got == sorted(brute.repeats(order), key=key)


def test_repeats_across_chunks(spark, small_docs, small_rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 5000)
    parts = [b for b in suffix_dedup._segments([(1, small_rows[0][1].encode() * 9)], 100)]
    assert len(parts) > 1  # an oversized document is cut into overlapping pieces
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(17000))
    whole = next(suffix_dedup._tuples(100)(iter([_batch([(1, text)])])))
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1 << 20)
    one = next(suffix_dedup._tuples(100)(iter([_batch([(1, text)])])))
    covered = lambda b: {s + k for s, n in zip(b.column("start").to_pylist(), b.column("n").to_pylist()) for k in range(abs(n))}
    assert covered(whole) == covered(one) == set(range(17000 - 99))


def test_repeats_in_pieces(spark, monkeypatch):
    """Documents cut into pieces: no byte goes that stands nowhere else."""
    from pyspark import cloudpickle
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 5000)
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    once = text(17000)
    rows = [(1, once), (2, text(12000)), (3, text(4900) + once[4800:5100] + text(9000) + once[9700:15200]), (4, "ab" * 6000), (5, text(5000)), (6, text(5001))]
    cloudpickle.register_pickle_by_value(suffix_dedup)  # workers get the small SEGMENT
    try:
        out = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
        got = rows_of(out.withColumn("h", F.sha2("kept", 256)), "doc_id", "n_bytes", "n_removed", "n_spans", "h")
    finally:
        cloudpickle.unregister_pickle_by_value(suffix_dedup)
    assert got == sorted(brute.repeats(rows), key=key)


def _batch(rows):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], ["key", "text"])


def test_bpe(both, monkeypatch):
    docs, rows = both
    monkeypatch.setattr(bpe, "BUCKET_BYTES", 100_000)
    enc = bpe.encode(docs)
    got = rows_of(token_digests(bpe.decode(enc)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(brute.bpe(rows), key=key)


def test_token_counts(spark, both):
    docs, rows = both
    want = sorted(((i, n) for i, n, *_ in brute.bpe(rows)), key=key)
    folder, order = token_files.write_token_files(docs)
    for block in (7, 1 << 20):  # borders inside documents and right beside separators
        counts = token_files.token_counts(spark, folder, block_tokens=block)
        got = order.join(counts, ["file", "ordinal"])
        assert rows_of(got, "id", "n_tokens") == want
        assert counts.where("NOT complete").count() == 0
    assert rows_of(token_files.count_document_tokens(docs), "doc_id", "n_tokens") == want


def test_unfinished_tail(spark, tmp_path):
    end = token_files.END
    token_files.put(f"{tmp_path}/a.u16", [np.array([5, 6, end, end, 7, 8, 9], "<u2").tobytes()])
    for block in (1, 2, 3, 100):
        got = rows_of(token_files.token_counts(spark, str(tmp_path), block_tokens=block), "ordinal", "start", "n_tokens", "complete")
        assert got == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 3, False)]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 65537])
def test_permutation(n):
    p = training_order.Permutation(n, 3)
    slots = p.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (p.index(slots) == np.arange(n)).all()


def test_training_order(spark, both):
    docs, rows = both
    length, records = 64, 50
    folder, manifest = training_order.write_training_order(docs, length=length, records=records)
    got = sorted((tuple(r) for r in manifest.select("slot", "seq", "id", "n_tokens").collect()))
    total = sum(-(-(len((t or "").encode()) + 1) // length) for _, t in rows)
    assert [g[0] for g in got] == list(range(total)) and sorted(g[1] for g in got) == list(range(total))
    data = training_order.read_slots(folder, 0, total, length, records)
    assert data.shape == (total, length)
    by_seq = sorted((seq, i, bytes(data[slot][:n])) for slot, seq, i, n in got)
    assert all((data[s][n:] == training_order.PAD).all() for s, _, _, n in got)
    texts, open_ = [], b""
    for _, i, body in by_seq:
        open_ += body
        if body.endswith(bytes([training_order.END])):
            texts.append((i, open_[:-1].decode()))
            open_ = b""
    assert sorted(texts, key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    assert (training_order.read_slots(folder, 30, 70, length, records) == data[30:70]).all()


def test_token_order(spark, both):
    """The shards hold the tokenizer's ids of every text, back to back in order of id."""
    docs, rows = both
    length, records = 64, 50
    folder, manifest = training_order.write_token_order(docs, length=length, records=records)
    enc = brute.encoder()
    want = sorted(((i, [*enc.encode_ordinary(t or ""), training_order.TOKEN_END]) for i, t in rows), key=lambda r: key((r[0],)))
    tokens = sum(len(ids) for _, ids in want)
    total = -(-tokens // length)
    got = [tuple(r) for r in manifest.select("seq", "offset", "slot", "id", "n_tokens", "shard").collect()]
    data = training_order.read_slots(folder, 0, total, length, records, "<u2")
    assert {g[2] for g in got} == set(range(total)) and sum(g[4] for g in got) == tokens
    seqs = {seq: slot for seq, _, slot, _, _, _ in got}
    assert sorted(seqs) == list(range(total))
    stream = np.concatenate([data[seqs[s]] for s in range(total)])
    assert (stream[tokens:] == training_order.TOKEN_PAD).all()
    texts, open_ = [], []
    for seq, offset, slot, i, n, shard in sorted(got, key=lambda g: g[:2]):
        assert shard == f"{slot // records:08d}.bin"
        at = offset // 2 - slot % records * length
        open_ += data[slot][at:at + n].tolist()
        if open_[-1] == training_order.TOKEN_END:
            texts.append((i, open_))
            open_ = []
    assert open_ == [] and sorted(texts, key=str) == sorted(want, key=str)
    assert stream[:tokens].tolist() == [x for _, ids in texts for x in ids]


def test_training_order_query_writes_vocabulary_ids(spark, small_rows):
    enc = brute.encoder()
    got = QUERIES["op5_training_order"](spark, SF_SMALL).groupBy("doc_id").agg(F.sum("n_tokens")).collect()
    assert sorted(map(tuple, got)) == sorted((i, len(enc.encode_ordinary(t or "")) + 1) for i, t in small_rows)


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_language_odd(spark, odd_docs, odd_rows, no_docs):
    got = rows_of(language_id.identify(odd_docs), "doc_id", "lang_pred")
    want = sorted(((i, "en" if any(c.isalpha() for c in t or "") else "und") for i, t in odd_rows), key=key)
    assert got == want
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r[0] for r in language_id.identify(unlabelled).select("lang_pred").distinct().collect()} == {"und"}


def test_language_reads_long_runs_whole(spark):
    """Text without spaces: the letters behind the 64th decide as well."""
    assert language_id.words_of("Ab" * 70 + " c") == ["ab" * 32, "ab" * 32, "ab" * 6, "c"]
    rnd = random.Random(4)
    text = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    letters = {"xx": "abcdefgh", "yy": "mnopqrst"}
    rows = [(k, text(letters[x], 300), x) for k in range(60) for x in letters]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mixed = [(1, text(letters["xx"], 64) + text(letters["yy"], 600)), (2, text(letters["yy"], 64) + text(letters["xx"], 600))]
    got = language_id.predict(spark.createDataFrame(mixed, "doc_id long, text string"), language_id.train(docs))
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {1: "yy", 2: "xx"}


def test_language_ignores_its_label(spark, small_docs):
    other = small_docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a = rows_of(language_id.identify(small_docs), "doc_id", "lang_pred", "score")
    assert a == rows_of(language_id.identify(other), "doc_id", "lang_pred", "score")


def test_lines(spark, odd_docs, odd_rows):
    out = line_dedup.line_dedup(odd_docs)
    assert set(odd_docs.columns) < set(out.columns) and out.count() == len(odd_rows)
    got = {r["doc_id"]: r for r in out.collect()}
    for i, t in odd_rows:
        if t and "\nPage " in t:  # the shared passage and the numbered line go, the rest stays
            lines = t.split("\n")
            assert got[i]["text"] == "\n".join([lines[0], lines[2]]) and got[i]["_n_dropped"] == 2
        elif i is not None and 30 <= i < 90:
            assert got[i]["_n_dropped"] == 0  # copies of one text are not recurring lines
    assert got[1]["text"] is None and got[2]["text"] == ""


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><a href=/>Home page</a> Site name, since 1999.</header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies, as all do. Accept, please.</div><div class="ad">Buy now, it is cheap, very cheap.</div>
<article><header><h1>Title &amp; more</h1></header><p>First&nbsp;paragraph, with <b>bold</b>
 text.<p>Short.<br>After break</p><form>Name, please: <input></form><ul><li>Item one<li>Item two</ul></article>
<aside>Related, read this too.</aside><section id="comments"><p>I disagree, said a reader, at length, and again.</p></section>
<footer>&copy; Site, all rights.</footer></body></html>"""


def test_html_page():
    assert html_text.main_text(PAGE) == "Title & more\nFirst paragraph, with bold text.\nShort.\nAfter break\nItem one\nItem two"
    plain = PAGE.replace("<article>", "<div id=x>").replace("</article>", "</div>").replace("<header><h1>", "<h1>").replace("</h1></header>", "</h1>")
    assert "First paragraph, with bold text." in html_text.main_text(plain)
    assert "disagree" not in html_text.main_text(plain) and "cheap" not in html_text.main_text(plain)


def test_html_lead_and_parts():
    """Heading and lead in main before the article, a short second part, a nested article."""
    long = [f"This is paragraph {k}, it is long, and it says much about the matter; more follows, as one would expect here." for k in range(9)]
    paras = "".join(f"<p>{x}</p>" for x in long)
    lead = "A lead of one sentence, which says what follows, and why."
    part = "The second part, shorter, has one paragraph, which is as dense as the first, and belongs to it."
    inner = "A nested article, which has a paragraph of its own, as dense as the others are, and no more."
    main = f"<main><h1>The heading</h1><p>{lead}</p><article>{paras}</article></main>"
    links = "<ul>" + "".join(f"<li><a href=/{k}>Another page of this site</a></li>" for k in range(9)) + "</ul>"
    for page in (main, main.replace("</main>", links + "</main>"), main + links):
        assert html_text.main_text(f"<html><body><nav><a href=/>Home</a></nav>{page}</body></html>").split("\n") == ["The heading", lead, *long]
    for page, more in ((f"<article>{paras}</article><article class='part two'><p>{part}</p></article>", part),
                       (f"<article>{paras}<article class=inner><p>{inner}</p></article></article>", inner)):
        assert html_text.main_text(f"<html><body>{page}<footer>The site, since 1999.</footer></body></html>").split("\n") == [*long, more]
    teasers = "".join(f"<article class=teaser><h3><a href=/{k}>Another article of this site</a></h3></article>" for k in range(5))
    comment = "<article class=comment><p>I disagree.</p></article>"
    assert html_text.main_text(f"<html><body><article>{paras}</article>{teasers}{comment}</body></html>").split("\n") == long


def test_html_text_outside_the_article_passes_by_its_ratio():
    """Text as dense as the article's is kept wherever it stands, sparse text is not."""
    long = [f"This is paragraph {k}, it is long, and it says much about the matter; more follows, as one would expect here." for k in range(9)]
    paras = "".join(f"<p>{x}</p>" for x in long)
    got = html_text.main_text(f"<html><body><div class=top>12 May</div><article>{paras}</article><div class=more>{paras}</div><div class=end>Up</div></body></html>")
    assert got.split("\n") == long + long


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<html", "&amp", "<p", "</p></p>", "<script>x", "<!-- x"])
def test_html_broken(html):
    assert isinstance(html_text.main_text(html), str)


def test_html_operator(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", ""), (3, "w", "<p>" + "Word, word. " * 40000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = rows_of(html_text.extract(pages), "page_id", "url", "n_chars")
    want = [(1, "u", len(html_text.main_text(PAGE)))] * 2 + [(2, "v", 0), (3, "w", 479999), (None, None, 0)]
    assert got == want


def test_html_given_pages(spark):
    """The given pages keep every block of their article element, and nothing else."""
    import html
    import re
    for r in html_text.extract(spark.read.parquet(f"{SF_SMALL}/pages.parquet")).join(
            spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = r["html"].split("<article>")[1].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", body)]
        assert r["text"] == "\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


def test_empty_tables(spark, no_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert decontaminate.decontaminate(no_docs, bench).count() == 0
    assert line_dedup.line_dedup(no_docs).count() == 0
    assert bpe.decode(bpe.encode(no_docs)).count() == 0
    assert minhash_dedup.near_dedup(no_docs).count() == 0
    assert suffix_dedup.suffix_dedup(no_docs).count() == 0
    assert language_id.identify(no_docs).count() == 0
    assert token_files.count_document_tokens(no_docs).count() == 0
    assert training_order.write_training_order(no_docs)[1].count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
