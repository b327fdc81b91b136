"""Line dedup by a log-template tree. DataFrame functions only.

Every line that is not blank goes down a tree of fixed depth: first by its
number of tokens, then by its leading tokens, with tokens that hold a digit
already generalised to ``<*>``. Inside a leaf a field stays constant where its
token recurs in enough documents of that leaf and is generalised to ``<*>``
elsewhere; the resulting template must keep a stated share of constant fields.
A whole line without any variable field is a template of its own, for which
fewer documents are enough unless it is short. Text written without spaces is
one token, so its lines count by their characters. A template that recurs
across documents is dropped wherever it occurs.

*Across documents* means in unlike surroundings, since near copies share most of
their lines and are the business of document dedup: if copies counted, each of
them would lose all its text here and near-dedup would find nothing to keep. The
heads of a document's other lines (their first characters, which an edit inside
the line leaves alone) are put into eight orders, and the first head of each is
one sample of the surroundings. A document that shares more than three of its
eight samples with k documents of the template has 1/k of a vote, any other
document one vote. Copies so have about one vote together however many they are,
while pages that share a header and a footer only have one each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, sized, stored

MIN_DOCS = 10        # votes for a template with variable fields, and for a short line
MIN_SAME = 3         # votes for a whole line that is not short
SHORT_TOKENS = 4     # a line with fewer tokens than this
SHORT_CHARS = 20     # and fewer characters than this is short
DEPTH = 3            # leading tokens below the token count
MIN_CONSTANT = 0.6   # share of constant fields of a template
HEAD_CHARS = 20      # characters of a line that stand for it in surroundings
SAMPLES = 8          # orders of a document's heads
TOLERATED = 3        # samples that unlike documents may share
MIN_VOTES = 0.02     # votes per document of a template, against heavily edited copies
FIELD = "<*>"


def _mask(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(FIELD)).otherwise(token)


def _key(id_col: str, text_col: str) -> Column:
    # a function of the row itself, so every pass computes the same key
    return F.xxhash64(F.col(id_col), F.col(text_col)).alias("key")


def _ring(line: Column) -> Column:
    """Digest of a line's head, lengthened so that all its turns can be cut out."""
    digest = F.md5(F.substring(line, 1, HEAD_CHARS))
    return F.concat(digest, F.substring(digest, 1, 15))


def _turn(ring: Column, order: int) -> Column:
    return F.substring(ring, 4 * order + 1, 15)


def _turned(order: int):
    return lambda ring: _turn(ring, order)


def _number(turn: Column) -> Column:
    return F.conv(turn, 16, 10).cast("long")


def _lines(docs: DataFrame, id_col: str, text_col: str, surroundings: bool = False) -> DataFrame:
    """(key, line_no, line, tokens, same, leaf[, firsts]) of every line that is not blank;
    ``firsts`` holds the first two heads of the document in each order."""
    cut = docs.where(F.col(text_col).isNotNull()).select(
        _key(id_col, text_col), F.split(F.col(text_col), "\n", -1).alias("lines"))
    extra = []
    if surroundings:
        cut = cut.withColumn("rings", F.array_distinct(F.transform(
            F.filter("lines", lambda x: F.trim(x) != ""), _ring)))
        orders = [F.sort_array(F.transform("rings", _turned(j))).alias(f"o{j}") for j in range(SAMPLES)]
        cut = cut.select("key", "lines", *orders)
        cut = cut.select("key", "lines", F.array(*[
            F.struct(_number(F.get(f"o{j}", F.lit(0))).alias("a"), _number(F.get(f"o{j}", F.lit(1))).alias("b"))
            for j in range(SAMPLES)]).alias("firsts"))
        extra = ["firsts"]
    rows = cut.select("key", *extra, F.posexplode("lines").alias("line_no", "line")).where(F.trim("line") != "")
    rows = rows.withColumn("tokens", F.split("line", " ", -1))
    head = [_mask(F.get("tokens", F.lit(i))) for i in range(DEPTH)]
    return rows.withColumns({"same": F.xxhash64(F.lit("line"), "line"),
                             "leaf": F.xxhash64(F.lit("leaf"), F.size("tokens"), *head)})


def _templates(lines: DataFrame, min_docs: int) -> DataFrame:
    """(key, line_no, unit) of the lines with enough constant fields."""
    # constant fields: tokens that recur at one place of one leaf
    fields = lines.select("key", "line_no", "leaf", F.posexplode("tokens").alias("at", "token"))
    constant = (fields.where(F.col("token") != FIELD).select("leaf", "at", "token", "key").distinct()
                .groupBy("leaf", "at", "token").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
                .select("leaf", "at", "token", F.lit(True).alias("constant")))
    kept = fields.join(constant, ["leaf", "at", "token"], "left")
    # one list per line, as long as the line; rows that repeat id and text fall together
    template = kept.groupBy("key", "line_no", "leaf").agg(F.sort_array(F.collect_set(F.struct(
        "at", F.when(F.col("constant"), F.col("token")).otherwise(FIELD).alias("f"),
        F.col("constant").isNotNull().alias("c")))).alias("t"))
    n_constant = F.size(F.filter("t", lambda x: x["c"]))
    return template.where(n_constant >= MIN_CONSTANT * F.size("t")).select(
        "key", "line_no", F.xxhash64("leaf", F.col("t.f")).alias("unit"))


def _across(seen: DataFrame) -> DataFrame:
    """(unit) of the templates with enough votes; ``seen`` is (unit, key, need, around)."""
    samples = seen.select("unit", "key", "need", F.posexplode("around").alias("order", "head"))
    shared = (samples.where(F.col("head").isNotNull()).groupBy("unit", "order", "head")
              .agg(F.count("*").alias("n")).where(F.col("n") > 1))
    n = F.when(F.col("head").isNotNull(), F.coalesce("n", F.lit(1)))
    votes = (samples.join(sized(stored(shared, "shared-heads")), ["unit", "order", "head"], "left")
             .groupBy("unit", "key", "need")
             .agg((1 / F.get(F.sort_array(F.collect_list(n), asc=False), F.lit(TOLERATED))).alias("vote")))
    total = F.sum("vote")
    good = votes.groupBy("unit").agg((total >= F.greatest(F.min("need"), MIN_VOTES * F.count("*")) - 1e-6).alias("good"))
    return good.where("good").select("unit")


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    min_docs: int = MIN_DOCS, min_same: int = MIN_SAME) -> DataFrame:
    """(key, line_no, unit) of every line that belongs to a recurring template."""
    names = (_lines(docs, id_col, text_col)
             .select("key", F.posexplode(F.array("same", "leaf")).alias("is_leaf", "name")).distinct()
             .groupBy("is_leaf", "name").agg(F.count("*").alias("n"))
             .where(F.col("n") >= F.when(F.col("is_leaf") == 1, min_docs).otherwise(min_same)))
    names = stored(names.select("is_leaf", "name"), "names")
    same = names.where("is_leaf = 0").select(F.col("name").alias("same"), F.lit(True).alias("is_same"))
    leaf = names.where("is_leaf = 1").select(F.col("name").alias("leaf"), F.lit(True).alias("in_leaf"))
    lines = (_lines(docs, id_col, text_col, surroundings=True)
             .join(sized(same), "same", "left").join(sized(leaf), "leaf", "left").where("is_same OR in_leaf"))
    short = (F.size("tokens") < SHORT_TOKENS) & (F.char_length("line") < SHORT_CHARS)
    lines = lines.withColumn("ring", _ring(F.col("line")))
    around = [F.when(_number(_turn(F.col("ring"), j)) == F.get("firsts", F.lit(j))["a"], F.get("firsts", F.lit(j))["b"])
              .otherwise(F.get("firsts", F.lit(j))["a"]) for j in range(SAMPLES)]
    lines = stored(lines.select(
        "key", "line_no", "same", "leaf", "is_same", "in_leaf", F.transform("tokens", _mask).alias("tokens"),
        F.when(short, min_docs).otherwise(min_same).alias("need"), F.array(*around).alias("around")), "candidate-lines")

    template = stored(_templates(lines.where("in_leaf"), min_docs), "templates")
    whole = lines.where("is_same")
    around = [F.min(F.get("around", F.lit(j))).alias(f"h{j}") for j in range(SAMPLES)]
    seen = (whole.select(F.col("same").alias("unit"), "key", "need", "around")
            .unionByName(template.join(lines.where("in_leaf").select("key", "line_no", "around"), ["key", "line_no"])
                         .select("unit", "key", F.lit(min_docs).alias("need"), "around"))
            .groupBy("unit", "key").agg(F.min("need").alias("need"), *around)
            .select("unit", "key", "need", F.array(*[f"h{j}" for j in range(SAMPLES)]).alias("around")))
    units = whole.select("key", "line_no", F.col("same").alias("unit")).unionByName(template)
    return units.join(sized(stored(_across(stored(seen, "surroundings")), "recurring")), "unit")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_docs: int = MIN_DOCS, min_same: int = MIN_SAME) -> DataFrame:
    """All columns of ``docs`` with the text freed of recurring template lines,
    plus ``_n_lines`` and ``_n_dropped``.

    No row is dropped: a document made of recurring lines only stays with an
    empty text. Null text stays null with no lines. Lines are cut at ``\\n`` and
    tokens at single spaces. Rows that repeat id and text count as one document
    and get the same result. Extra columns pass through untouched, whatever their names; only
    columns called ``_n_lines`` or ``_n_dropped`` are replaced.
    """
    key, drop, cut = (free_name(docs, c) for c in ("_key", "_drop", "_cut"))
    drops = (recurring_lines(docs, id_col, text_col, min_docs, min_same).groupBy("key")
             .agg(F.collect_set("line_no").alias(drop)).withColumnRenamed("key", key))
    drops = stored(drops, "drops")
    # texts are cut below the join, so that functions over the lines read an array that is there
    lines = F.col(cut)
    out = docs.withColumns({key: _key(id_col, text_col), cut: F.split(F.col(text_col), "\n", -1)})
    out = out.drop(text_col).join(sized(drops), key, "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
    text = F.array_join(F.when(F.col(drop).isNull(), lines).otherwise(F.transform(stay, lambda k: F.get(lines, k))), "\n")
    counts = {"_n_lines": F.when(lines.isNull(), 0).otherwise(F.size(lines)).cast("long"),
              "_n_dropped": F.coalesce(F.size(drop), F.lit(0)).cast("long")}
    out = out.withColumns({**counts, text_col: text})
    have = {c.lower() for c in docs.columns}
    order = [*docs.columns, *[c for c in counts if c not in have]]
    return out.select(*[F.col("`" + c.replace("`", "``") + "`") for c in order])


ORACLE = r"""
WITH l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l1 AS (SELECT doc_id, ls, list_distinct(list_transform(list_filter(ls, lambda x: trim(x) <> ''), lambda x: md5(left(x, 20)))) AS hs FROM l0),
l2 AS (SELECT doc_id, ls, list_transform([0, 4, 8, 12, 16, 20, 24, 28], lambda o: list_sort(list_transform(hs, lambda h: substr(h, o + 1) || left(h, o)))[:2]) AS firsts FROM l1),
l3 AS (SELECT doc_id, firsts, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM l2),
l4 AS (SELECT doc_id, line_no, line, firsts, md5(left(line, 20)) AS head,
              list_transform(string_split(line, ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tk
       FROM l3 WHERE trim(line) <> ''),
l5 AS (SELECT doc_id, line_no, line, tk, CAST(len(tk) AS VARCHAR) || chr(31) || tk[1] || chr(31) || coalesce(tk[2], '') || chr(31) || coalesce(tk[3], '') AS leaf,
              list_transform([1, 2, 3, 4, 5, 6, 7, 8], lambda j: CASE WHEN firsts[j][1] = substr(head, 4 * j - 3) || left(head, 4 * j - 4) THEN firsts[j][2] ELSE firsts[j][1] END) AS ctx FROM l4),
re AS (SELECT line FROM l5 GROUP BY line HAVING count(DISTINCT doc_id) >= 3),
lf AS (SELECT leaf FROM l5 GROUP BY leaf HAVING count(DISTINCT doc_id) >= 10),
f AS (SELECT doc_id, line_no, l5.leaf, unnest(tk) AS token, unnest(range(len(tk))) AS pos FROM l5 JOIN lf ON l5.leaf = lf.leaf),
c AS (SELECT leaf, pos, token FROM f WHERE token <> '<*>' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
t AS (SELECT f.doc_id, f.line_no, f.leaf, string_agg(CASE WHEN c.leaf IS NULL THEN '<*>' ELSE f.token END, chr(30) ORDER BY f.pos) AS tpl,
             count(c.leaf) AS nc, count(*) AS n
      FROM f LEFT JOIN c ON f.leaf = c.leaf AND f.pos = c.pos AND f.token = c.token GROUP BY f.doc_id, f.line_no, f.leaf),
un AS (SELECT doc_id, line_no, 'T' || leaf || chr(29) || tpl AS unit, 10 AS need FROM t WHERE nc >= 0.6 * n
       UNION ALL SELECT doc_id, line_no, 'E' || l5.line, CASE WHEN len(tk) >= 4 OR length(l5.line) >= 20 THEN 3 ELSE 10 END FROM l5 JOIN re ON l5.line = re.line),
ux AS (SELECT un.unit, un.doc_id, un.need, unnest(ctx) AS cx, unnest(range(8)) AS j FROM un JOIN l5 ON un.doc_id = l5.doc_id AND un.line_no = l5.line_no),
cx AS (SELECT unit, doc_id, j, min(need) AS need, min(cx) AS cx FROM ux GROUP BY unit, doc_id, j),
cn AS (SELECT unit, j, cx, count(*) AS n FROM cx WHERE cx IS NOT NULL GROUP BY unit, j, cx),
vt AS (SELECT cx.unit, doc_id, min(need) AS need, 1.0::DOUBLE / list_sort(list(n), 'DESC')[4] AS vote
       FROM cx LEFT JOIN cn ON cx.unit = cn.unit AND cx.j = cn.j AND cx.cx = cn.cx GROUP BY cx.unit, doc_id),
g AS (SELECT unit FROM vt GROUP BY unit HAVING sum(vote) >= greatest(min(need), 0.02 * count(*)) - 1e-6),
x AS (SELECT doc_id, list(DISTINCT line_no) AS gone FROM un JOIN g USING (unit) GROUP BY doc_id),
k AS (SELECT documents.doc_id, text, gone, string_split(text, chr(10)) AS ls FROM documents LEFT JOIN x ON documents.doc_id = x.doc_id)
SELECT doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(len(gone), 0) AS n_dropped,
       sha256(CASE WHEN gone IS NULL THEN coalesce(text, '')
              ELSE coalesce(array_to_string([ls[i + 1] for i in range(len(ls)) if NOT list_contains(gone, i)], chr(10)), '') END) AS kept_sha256
FROM k
"""
