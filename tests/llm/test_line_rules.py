"""Line dedup: which lines recur across documents, on planted cases."""

import random

from matchdesk.llm import line_dedup

WORDS = [a + b + c for a in ("ka", "lo", "mi", "ne", "su", "to", "ra") for b in ("p", "rt", "n", "ld", "s") for c in ("e", "i", "o", "an")]


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def kept(spark, rows):
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r["doc_id"]: r["text"] for r in out.collect()}


def test_header_and_footer_of_short_pages(spark):
    """Pages of a header, one own line and a footer lose both, whatever the footer is."""
    rnd = random.Random(1)
    rows, own = [], {}
    for site in range(4):
        header, footer = f"{sentence(rnd, 5)} header", f"{sentence(rnd, 5)} footer"
        for k in range(60):
            own[100 * site + k] = sentence(rnd, 9)
            rows.append((100 * site + k, "\n".join([header, own[100 * site + k], footer])))
    assert kept(spark, rows) == own


def test_short_and_unspaced_lines(spark):
    """Three documents are enough for a long line, ten votes are for a short one."""
    rnd = random.Random(2)
    body = {k: [sentence(rnd, 9) for _ in range(4)] for k in range(60)}
    shared = {"All rights reserved.": range(0, 40), "Of.": range(10, 50), "Yes.": range(0, 6), "日" * 24: range(50, 54),
              "only two documents have this long line": (58, 59)}
    rows = [(k, "\n".join(lines + [s for s, ids in shared.items() if k in ids])) for k, lines in body.items()]
    stays = ("Yes.", "only two documents have this long line")
    assert kept(spark, rows) == {k: "\n".join(lines + [s for s in stays if k in shared[s]]) for k, lines in body.items()}


def test_copies_keep_their_lines(spark):
    """Exact and edited copies are one voice; a line that they share with other documents still goes."""
    rnd = random.Random(3)
    base = [sentence(rnd, 30) for _ in range(12)]
    footer = "this footer stands below many documents"
    rows = []
    for k in range(400):
        lines = list(base)
        if k % 2:  # one word of each of two lines
            for at in rnd.sample(range(12), 2):
                words = lines[at].split(" ")
                words[rnd.randrange(10, 30)] = "edited"
                lines[at] = " ".join(words)
        rows.append((k, "\n".join(lines + [footer])))
    rows += [(1000 + k, "\n".join([sentence(rnd, 9) for _ in range(5)] + [footer])) for k in range(30)]
    assert kept(spark, rows) == {k: t[:-len(footer) - 1] for k, t in rows}


def test_one_line_documents_and_repeated_rows(spark):
    """A document without other lines has no vote; rows that repeat id and text count once."""
    rnd = random.Random(4)
    page = "\n".join(["a line which recurs", sentence(rnd, 9)])
    rows = [(k, "the only line of each document") for k in range(30)] + [(50, page)] * 12 + [(60, " \n\n"), (61, ""), (62, None)]
    assert sorted(kept(spark, rows).items()) == sorted(dict(rows).items())
