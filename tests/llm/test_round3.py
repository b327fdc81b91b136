"""Phrase fingerprints, conversation repair and token alignment against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchdesk.llm import conversation_repair as cr
from matchdesk.llm import lz_fingerprint as lz
from matchdesk.llm import token_alignment as ta
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.conftest import key, rows_of


@pytest.fixture(params=["small", "odd"])
def both(request, small_docs, small_rows, odd_docs, odd_rows):
    return (small_docs, small_rows) if request.param == "small" else (odd_docs, odd_rows)


# ---- phrase fingerprints ----------------------------------------------------

PAIR_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def lz_expected(spark, rows, block):
    texts = sorted({t or "" for _, t in rows})
    tie = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = brute.falling(rows, tie)
    sketch = {}

    def mark(t):
        if t not in sketch:
            sketch[t] = np.unique(lz._hashes(sorted(brute.lz_phrases(t, block))))[:lz.SIZE]
        return sketch[t]

    out = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        e = brute.edited(t, following)
        out.append((i, len(t), brute.sha(e), lz.as_text(mark(t)), lz.as_text(mark(e)),
                    lz.likeness(mark(t), mark(e)), lz.likeness(mark(t), mark(following))))
    return out


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_fingerprints_of_neighbours(spark, both, monkeypatch, block):
    docs, rows = both
    monkeypatch.setattr(lz, "RANGE_BYTES", 60_000)
    want = sorted(lz_expected(spark, rows, block), key=key)
    assert rows_of(lz.with_next(docs, block=block), *PAIR_COLUMNS) == want


def test_likeness_is_the_jaccard_of_small_sets():
    rnd = random.Random(3)
    for _ in range(50):
        a, b = ("".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 90))) for _ in range(2))
        x, y = brute.lz_phrases(a, lz.BLOCK), brute.lz_phrases(b, lz.BLOCK)
        want = len(x & y) / len(x | y) if x | y else 1.0
        assert lz.likeness(lz.signature(a), lz.signature(b)) == pytest.approx(want)


def test_likeness_estimates_large_sets():
    rnd = random.Random(4)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(20000))
    for cut in (2000, 8000, 15000):
        other = base[:cut] + "".join(rnd.choice("ijklmnop ") for _ in range(20000 - cut))
        x, y = brute.lz_phrases(base, lz.BLOCK), brute.lz_phrases(other, lz.BLOCK)
        assert abs(lz.likeness(lz.signature(base), lz.signature(other)) - len(x & y) / len(x | y)) < 0.15


def test_likeness_in_sql(spark, small_docs):
    pairs = lz.with_next(small_docs).withColumn("sql", lz.likeness_of(F.col("fingerprint"), F.col("edited_fingerprint")))
    assert all(r.sql == pytest.approx(r.near_edited) for r in pairs.collect())
    empty = spark.createDataFrame([("", ""), ("", "00000001")], "a string, b string")
    assert sorted(r[0] for r in empty.select(lz.likeness_of(F.col("a"), F.col("b"))).collect()) == [0.0, 1.0]


def test_equal_texts_and_single_rows(spark, no_docs):
    assert lz.with_next(no_docs).count() == 0
    one = lz.with_next(spark.createDataFrame([(5, "hello hello")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.next_id, r.near_next) for r in one] == [(5, 5, 1.0)]
    nothing = lz.with_next(spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")).collect()
    assert [(r.n_chars, r.fingerprint, r.near_edited) for r in nothing] == [(0, "", 1.0)] * 3
    plain = {(r.n_chars, r.fingerprint) for r in lz.fingerprints(spark.createDataFrame([(1, "aXbXa"), (2, "aXbXa")], "doc_id long, text string")).collect()}
    assert len(plain) == 1


# ---- conversation repair ----------------------------------------------------

REPAIR_COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def made_up_conversations():
    rnd = random.Random(11)
    rows = []
    for conv in range(400):
        n = rnd.randint(1, 14)
        for turn in range(n):
            role = rnd.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "superuser"])
            text = rnd.choice(["Hi.", "Well!", "Yes?", "cut", "", " \t", None, "a\nb. ", f"line {turn}.", "x.\u00a0", "Hi."])
            rows.append((conv if conv else None, rnd.choice([turn, turn, turn, turn + 2, None]), role, text))
    rows += [(1000, t, rnd.choice(["user", "assistant", "system"]), f"turn {t // 2}" + rnd.choice([".", ""])) for t in range(3000)]
    return rows


def test_repair(spark):
    rows = made_up_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    for c in ("present", "blank", "copy", "last"):
        df = df.withColumn(c, F.lit(c))
    got = rows_of(cr.repair(cr.damage(df), present="present"), *REPAIR_COLUMNS)
    assert got == sorted(brute.repaired(rows), key=key)


def test_repair_of_the_given_table(spark):
    df = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = rows_of(cr.repair(cr.damage(df), present="present"), *REPAIR_COLUMNS)
    assert got == sorted(brute.repaired(rows), key=key)


def test_repaired_turns_have_the_digest(spark):
    rows = made_up_conversations()
    df = cr.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns = cr.repaired_turns(df, present="present").collect()
    digest = {r.conv_id: r.repaired_sha256 for r in cr.repair(df, present="present").collect()}
    by = {}
    for r in sorted(turns, key=lambda r: r.pos):
        by.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(digest[c] == brute.sha("\n".join(by.get(c, []))) for c in digest)


def audits(roles, most):
    """All audits of some clean turns, with their cost, if they give legal roles."""
    out = []
    for n_inserts in range(most + 1):
        for letters in itertools.product("KRD", repeat=len(roles)):
            for where in itertools.combinations_with_replacement(range(len(roles) + 1), n_inserts):
                state, cost, text, ok = "", 0, "", True
                for k in range(len(roles) + 1):
                    for step in ["I"] * where.count(k) + ([letters[k]] if k < len(roles) else []):
                        text += step
                        cost += {"I": 2, "K": 0, "R": 2, "D": 3}[step]
                        if step == "D":
                            continue
                        c = roles[k][0] if step == "K" else {"": "u", "s": "u", "u": "a", "a": "u"}[state]
                        ok &= (state, c) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
                        state = c
                if ok and state in ("", "a"):
                    out.append((cost, text))
    return min(out)


def test_audit_is_the_least_of_all():
    for n in range(5):
        for roles in itertools.product(["user", "assistant", "system"], repeat=n):
            one = cr.Repair(lambda *a: None)
            for k, role in enumerate(roles):
                one.add(k, role, f"{k}.", False, False)
            *_, cost, audit = one.end()
            assert (cost, audit) == audits(roles, 3), roles


def test_settling_changes_nothing(monkeypatch):
    rnd = random.Random(2)
    for _ in range(60):
        rows = [(k, rnd.choice(["user", "assistant", "system", "x"]), f"{k}.", rnd.random() < .1, rnd.random() < .3) for k in range(rnd.randint(1, 80))]
        results = []
        for settle in (1, 3, 10 ** 6):
            monkeypatch.setattr(cr, "SETTLE", settle)
            out = []
            one = cr.Repair(lambda *a: out.append(a))
            for r in rows:
                one.add(*r)
            results.append((one.end(), out))
        assert results[0] == results[1] == results[2]


def test_hash_collisions_are_verified(monkeypatch):
    """With a hash that always collides the letters decide."""
    monkeypatch.setattr(cr, "PRIME", 1)
    test_audit_is_the_least_of_all()


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair(empty).count() == 0 and cr.repaired_turns(empty).count() == 0
    one = spark.createDataFrame([("c", 3, None, None)], "conv_id string, turn int, role string, text string")
    assert [tuple(r) for r in cr.repair(one).collect()] == [("c", 0, 1, 0, 0, 0, 3, "D", brute.sha(""))]


# ---- token alignment --------------------------------------------------------

ALIGN_COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("chars", [ta.BATCH_CHARS, 3000])
def test_alignment(both, monkeypatch, chars):
    docs, rows = both
    monkeypatch.setattr(ta, "BATCH_CHARS", chars)
    assert rows_of(ta.alignment(docs), *ALIGN_COLUMNS) == sorted(brute.aligned(rows), key=key)


SCRIPTS = ["<|endoftext|> and <s> </s> <unk>", "▁low", "中文字符 和 かな", "emoji 👩‍👩‍👧 \U0001f600", "tab\tline\r\nend  two   spaces ", " lead",
           "ﬁ ligature ½", "e\u0301 é", "\x00nul", "\u00a0nbsp\u3000wide", "don't we'll I'm", "१२३ ١٢٣ 123456", "a" * 3000, "<0x41>", "\x1c\x85"]


def test_alignment_of_scripts(spark):
    rows = [(k, t) for k, t in enumerate(SCRIPTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(ta.alignment(docs), *ALIGN_COLUMNS) == sorted(brute.aligned(rows), key=key)


def test_links_overlap(spark):
    docs = spark.createDataFrame([(1, "the unbelievable"), (2, None)], "doc_id long, text string")
    got = [tuple(r) for r in ta.links(docs).collect()]
    n = ta.alignment(docs).where("doc_id = 1").first().n_links
    assert len(got) == len(set(got)) == n and {r[0] for r in got} == {1}


def test_alignment_of_nothing(spark, no_docs):
    assert ta.alignment(no_docs).count() == 0
    only = spark.createDataFrame([(1, None), (1, ""), (None, "")], "doc_id long, text string")
    assert rows_of(ta.alignment(only), *ALIGN_COLUMNS[1:]) == [(0, 0, 0, 0, 0, 0, "")] * 3


# ---- page extraction: marks and broken markup ---------------------------------

from matchdesk.llm import html_text  # noqa: E402

PARAGRAPHS = "".join(f"<p>Sentence number {k} of the story, with words, and more of them. It ends here.</p>" for k in range(6))
TEXT = "\n".join(f"Sentence number {k} of the story, with words, and more of them. It ends here." for k in range(6))


@pytest.mark.parametrize("names", ["page has-sidebar", "container no-sidebar", "navy", "search-results-page search", "with-banner", "page"])
def test_marks_on_the_whole_page_say_nothing(names):
    assert html_text.main_text(f'<body><div class="{names}">{PARAGRAPHS}</div></body>') == TEXT
    assert html_text.main_text(f'<body><div class="{names}"><nav><a href="/">Home</a></nav><article>{PARAGRAPHS}</article></div></body>') == TEXT


@pytest.mark.parametrize("names", ["entry-header", "side-by-side", "post-header", "article-header", "header"])
def test_parts_of_the_article_stay(names):
    page = f'<article><div class="{names}"><h1>The headline of it</h1><p>A lead that says what follows, in short.</p></div>{PARAGRAPHS}</article>'
    assert html_text.main_text(page) == "The headline of it\nA lead that says what follows, in short.\n" + TEXT


@pytest.mark.parametrize("names", ["sidebar", "site-header", "cookie-notice", "comments", "ad ads-top", "side-column", "newsletter_signup", "nav", "related posts"])
def test_side_matter_goes(names):
    page = f'<body><div class="{names}"><p>Buy this now, and that too. It is a bargain, really.</p></div><div class="story">{PARAGRAPHS}</div></body>'
    assert html_text.main_text(page) == TEXT
    page = f'<body><div class="story"><article>{PARAGRAPHS}<div class="{names}"><p>Buy this now, and that too.</p></div></article></div></body>'
    assert names == "site-header" or html_text.main_text(page) == TEXT


def test_long_reader_comments_go():
    comments = "".join(f"<p>Reader {k} says: I do not agree with this at all, and here is why, at length. Bye.</p>" for k in range(200))
    assert html_text.main_text(f'<body><article>{PARAGRAPHS}</article><div class="comments">{comments}</div></body>') == TEXT


def test_any_markup_is_read():
    for bad in ("<![foo[x]]>", "<![ x", "<![CDATA[x]]>", "<!", "<!-", "<?x", "</", "<a b='", "<!doctype", "&#xffffffff;", "<![if !IE]>"):
        html_text.main_text(bad)
        assert html_text.main_text(f"{PARAGRAPHS}{bad}").startswith(TEXT[:60])
        assert "Sentence number 5" in html_text.main_text(f"<article>{bad}>{PARAGRAPHS}</article>")
    rnd = random.Random(8)
    bits = ["<div", ">", "</div>", "<p>", "text, and more.", "<![", "<!--", "-->", "]]>", "<", "&", "&amp;", "<script>", "</script>", "'", '"', "=", "<li>", "<td>",
            "</p>", "<article>", "</main>", "<main>", " class='nav x'", "\x00", "é", "<?", "<!DOCTYPE ", "[", "</", "<br/>", "<a href=x>", "</a>", "<title>", "<b>"]
    for _ in range(5000):
        html_text.main_text("".join(rnd.choice(bits) for _ in range(rnd.randint(1, 40))))


def test_depth_costs_nothing():
    import time
    took = []
    for n in (10_000, 50_000):
        page = "".join(f"<div class='c{k % 7}'>word {k}, and" for k in range(n)) + "</section>" * n
        t = time.time()
        html_text.main_text(page)
        html_text.main_text("<main><article>x, y." * n)
        took.append(time.time() - t)
    assert took[1] < 15 * took[0] + 1


# ---- pipeline -----------------------------------------------------------------

def test_language_stage_drops_rows_not_ids(spark, small_docs):
    import corpus_pipeline
    bad = [(0, None), (0, "123 456"), (None, "   "), (1, "")]
    extra = spark.createDataFrame(bad, "doc_id long, text string").select(
        "doc_id", "text", F.lit("en").alias("lang"), F.lit("x").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    docs = small_docs.unionByName(extra).withColumn("score", F.lit("theirs")).withColumn("lang_pred", F.lit(7))
    out = corpus_pipeline.language_stage(spark, docs, SF_SMALL)
    assert out.columns == docs.columns
    kept = sorted((r.doc_id, r.text) for r in out.collect())
    assert 0.9 * small_docs.count() < len(kept) <= small_docs.count()
    assert (0, small_docs.where("doc_id = 0").first().text) in kept  # another row with its id was dropped
    assert {r.score for r in out.collect()} == {"theirs"} and {r.lang_pred for r in out.collect()} == {7}
    assert corpus_pipeline.language_stage(spark, docs.limit(0), SF_SMALL).count() == 0


def test_encode_stage_in_small_blocks(spark, odd_docs, odd_rows):
    import corpus_pipeline
    got = rows_of(corpus_pipeline.encode_stage(spark, odd_docs, SF_SMALL), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(brute.bpe(odd_rows), key=key)


# ---- line dedup: names and long texts ------------------------------------------

def test_line_dedup_with_clashing_columns(spark):
    from matchdesk.llm import line_dedup
    rows = [(k, f"unique line number{k} of this document is here{k}\nall rights to this page are reserved\nand another closing{k} line of it") for k in range(30)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    odd = plain
    for c in ("_drop", "_key", "__drop", "key", "_DROP_", "tokens", "line"):
        odd = odd.withColumn(c, F.lit(c))
    a, b = line_dedup.line_dedup(plain), line_dedup.line_dedup(odd)
    assert set(odd.columns) < set(b.columns) and {r["_drop"] for r in b.collect()} == {"_drop"}
    assert rows_of(a, "doc_id", "text", "_n_lines", "_n_dropped") == rows_of(b, "doc_id", "text", "_n_lines", "_n_dropped")


def test_line_dedup_of_a_very_long_text(spark):
    import time
    from matchdesk.llm import line_dedup
    shared = [f"the same boilerplate stands here {w}" for w in ("one", "two", "three")]
    rows = [(k, "\n".join(x for j in range(3) for x in (f"own{k}x{j} text{k} body{j} only{k}{j} word", shared[j]))) for k in range(40)]
    rows.append((100, "\n".join(shared[j % 3] if j % 2 else f"own long{j} text body{j} of{j}" for j in range(60_000))))
    t = time.time()
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 100").first()
    assert got["_n_dropped"] in (0, 30_000) and time.time() - t < 60


def test_short_id_runs_are_packed_with_a_dictionary(spark):
    """Bodies that share words take a tenth less room at least than when each is packed alone (op5's disk)."""
    import random

    import numpy as np
    import zstandard

    from matchdesk.llm import training_order as TO
    from matchdesk.llm.bpe import encoding, vocabulary_path
    rnd = random.Random(3)
    lexicon = ["".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    texts = [" ".join(rnd.choice(lexicon) for _ in range(150)) for _ in range(300)]
    words = TO.dictionary(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string"), vocabulary_path())
    enc = encoding(vocabulary_path())
    ids = [np.array(enc.encode_ordinary(t), TO.DTYPE).tobytes() for t in texts]
    packed = [TO._packer(words).compress(x) for x in ids]
    assert [TO._unpacker(words).decompress(x) for x in packed] == ids
    assert sum(map(len, packed)) < 0.9 * sum(len(zstandard.ZstdCompressor(level=3).compress(x)) for x in ids)
    assert TO.dictionary(spark.createDataFrame([("a",)], "text string"), vocabulary_path()) == b""


def test_language_stage_sends_a_text_to_python_once(spark):
    import corpus_pipeline
    docs = spark.createDataFrame([(k, "the cat sat on the mat " * 3, "en", "s", 5) for k in range(9)] + [(20, "123", "en", "s", 3), (21, None, None, None, None)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.language_stage(spark, docs, "")
    assert sorted(r.doc_id for r in out.collect()) == list(range(9)) and out.columns == docs.columns
    assert "_scored" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_pipeline_hands_texts_to_python_in_small_batches(spark, monkeypatch):
    """A batch of 64 MB counts several times in an executor: in Python, and in the JVM on both ways."""
    import corpus_pipeline as cp
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64()), pa.array([b.num_rows], pa.int64())], ["size", "n"])

    texts = spark.range(0, 4000, 1, 1).select(F.expr("repeat('x', 4000) || id").alias("text"))
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en", "s", 22)], "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.get(cp.BATCH_SETTING)
    try:
        for stage in (cp.language_stage, cp.encode_stage):
            spark.conf.set(cp.BATCH_SETTING, "64m")
            stage(spark, docs, SF_SMALL)
            got = texts.mapInArrow(sizes, "size long, n long").collect()  # as the stage's rows when they are written
            assert sum(r.n for r in got) == 4000 and max(r.size for r in got) < 2 * cp.BATCH_BYTES
        spark.conf.set(cp.BATCH_SETTING, "48m")
        monkeypatch.setattr(cp, "STAGES", cp.STAGES[:1])
        cp.run(spark, SF_SMALL)
        assert spark.conf.get(cp.BATCH_SETTING) == "48m"
    finally:
        spark.conf.set(cp.BATCH_SETTING, before)
