"""Registered queries: name -> (spark, sf_dir) -> DataFrame, with oracle SQL.

Each query reads the stored inputs of `sf_dir` (derived from the given tables
by `matchdesk.sources.inputs`) and runs over all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchdesk.operators import view as V
from matchdesk.plans import oracle as O
from matchdesk.sources import fixtures as FX
from matchdesk.sources import inputs as IN

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is its DuckDB oracle (None = rows-only check)."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# View
# ---------------------------------------------------------------------------

FLAGSHIP_FILTER = V.ViewFilter(recommendations="NEEDS REVIEW, EXISTING BA ADD NEW ADDRESS", min_name=10)


@query("review_page", O.with_ctes(["m"]) + f"""
select {O.SHIPPED_SQL} from m
where recommendation in ('NEEDS REVIEW', 'EXISTING BA ADD NEW ADDRESS') and name_score >= 10
order by name_score desc nulls last, id limit 25 offset 0""")
def review_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: filter (F1, F4), sort (O1), page (O2), project."""
    m = IN.matches(spark, sf_dir)
    return V.shipped(V.page(V.view(m, FLAGSHIP_FILTER), 0, 25, ("name_score", "desc")))


# Queries below are registered in SURVEY §7.3 order.

import datetime as _dt
import uuid

from pyspark.sql import functions as F

from matchdesk import schema as S
from matchdesk.functions import exprs as X
from matchdesk.operators import edits as E
from matchdesk.operators import save as SV
from matchdesk.operators import search as SR
from matchdesk.operators import stats as ST
from matchdesk.operators import undo as U
from matchdesk.operators.joins import semi_join
from matchdesk.session import work_root
from matchdesk.sources import cache as CA
from matchdesk.sources import load as L
from matchdesk.sources.review_table import ReviewTable, recent
from matchdesk.sources.row_ids import import_ids

q = O.sql_str


def _fresh(spark, name: str) -> str:
    """A new folder under the shared work folder."""
    return f"{work_root(spark)}/matchdesk/{name}-{uuid.uuid4().hex[:8]}"


def _m(spark, sf_dir):
    return IN.matches(spark, sf_dir)


# ---- 1. Load ---------------------------------------------------------------

@query("normalize_matches", O.with_ctes(["m"]) + "select * from m")
def normalize_matches(spark, sf_dir):
    """S2-S6 over the stored raw table."""
    return L.normalize(IN.raw_matches(spark, sf_dir))


@query("adapt_master_layout", O.with_ctes(["master"]) + """
select id, hdrcode as dec_hdrcode, ssn as canvas_ssn, hdrname as dec_name, addrcity as dec_city,
 addrstate as dec_state, '' as canvas_id, '' as canvas_name, '' as canvas_address, '' as canvas_city,
 '' as canvas_state, '' as canvas_zip, 0.0::double as ssn_match, 0.0::double as name_score,
 0.0::double as address_score, '' as recommendation, '' as address_reason,
 0 as jib, 0 as rev, 0 as vendor, '' as how_to_process, '' as memo from master""")
def adapt_master_layout(spark, sf_dir):
    """S3 (+S4-S6): a master-layout table normalized to review columns."""
    return L.normalize(IN.master(spark, sf_dir))


@query("evolve_catalog_table", O.with_ctes(["matches"]) + "select *, 0 as rev, 0 as vendor from matches")
def evolve_catalog_table(spark, sf_dir):
    """S7 on a catalog table: the stored columns altered in, old rows read their defaults, and
    the empty audit log created beside it."""
    name, path = f"matches_{uuid.uuid4().hex[:8]}", _fresh(spark, "catalog")
    raw = IN.raw_matches(spark, sf_dir)
    raw.write.option("path", path).saveAsTable(name)
    L.evolve_table(spark, name)
    return spark.table(name)


_GOOD_SQL = O.with_ctes(["master"]).replace("select s_suppkey as id", "select s_suppkey, s_suppkey as id", 1) + """, parts as (
 select s_suppkey as s, case when s_suppkey % 11 = 3 then concat('no', cast(s_suppkey as varchar)) else cast(s_suppkey as varchar) end as ident,
  concat('H', cast(s_suppkey as varchar)) as code, ssn, hdrname, concat('contact ', cast(s_suppkey as varchar)) as contact,
  concat(cast(s_suppkey % 99 as varchar), ' Main St') as address, addrcity, addrstate,
  lpad(cast((s_suppkey * 37) % 100000 as varchar), 5, '0') as zip, cast(s_suppkey % 5 as varchar) as sub,
  case when s_suppkey % 3 = 0 then 'n/a' else cast(s_suppkey % 101 as varchar) end as score from master),
lines as (select *, concat_ws(',', ident, code, ssn, hdrname, contact, address, addrcity, addrstate, zip, sub, score) as whole from parts)
"""
_BAD = "(s % 7 in (1, 2) or s % 11 = 3)"


@query("load_csv_matches", _GOOD_SQL + f"""select s as id, code as dec_hdrcode, ssn as canvas_ssn, hdrname as dec_name,
 contact as dec_contact, address as dec_address, addrcity as dec_city, addrstate as dec_state, zip as dec_zip, sub as dec_addrsubcode,
 {O.num('score')} as name_score, '' as canvas_id, '' as canvas_name, '' as canvas_address, '' as canvas_city, '' as canvas_state,
 '' as canvas_zip, 0.0::double as ssn_match, 0.0::double as address_score, '' as recommendation, '' as address_reason,
 0 as jib, 0 as rev, 0 as vendor, '' as how_to_process, '' as memo from lines where not {_BAD}""")
def load_csv_matches(spark, sf_dir):
    """A CSV master table with upper-case headers and damaged lines, normalized."""
    return L.load_csv(spark, IN.master_csv(spark, sf_dir))[0]


@query("load_rejects", _GOOD_SQL + f"""select case when s % 7 = 1 then concat(whole, ',surplus')
 when s % 7 = 2 then concat(cast(s as varchar), ',cut') else whole end as line from lines where {_BAD}""")
def load_rejects(spark, sf_dir):
    """The lines of that file that are no rows."""
    return L.load_csv(spark, IN.master_csv(spark, sf_dir))[1]


@query("import_row_ids", O.with_ctes(["m"]) + """, k as (select canvas_id, dec_hdrcode, cast(canvas_id as bigint) % 2 as late from m)
select canvas_id, dec_hdrcode, row_number() over (order by late, canvas_id, dec_hdrcode) as id from k""")
def import_row_ids(spark, sf_dir):
    """Ids for a table without any, imported twice: its even customers first, then all of
    it; known rows keep their ids, the others follow in key order."""
    path = _fresh(spark, "row-ids")
    rows = _m(spark, sf_dir).select("canvas_id", "dec_hdrcode")
    import_ids(rows.filter(F.col("canvas_id").cast("bigint") % 2 == 0), path, ["canvas_id", "dec_hdrcode"])
    return import_ids(rows, path, ["canvas_id", "dec_hdrcode"]).select("canvas_id", "dec_hdrcode", "id")


@query("evolve_schema", O.with_ctes(["matches"]) + "select *, 0 as rev, 0 as vendor from matches")
def evolve_schema(spark, sf_dir):
    """The stored table with the missing review columns added."""
    return L.evolve_schema(IN.raw_matches(spark, sf_dir))


_KEYMAP = ", ".join(f"({q(p + '_' + suf)}, {q(rec)}, {q(b)})"
                    for p, rec in S.BUCKET_PREFIXES for suf, b in S.BUCKET_BOUNDS)


@query("bucket_pivot", O.with_ctes(["m", "bucket_config"]) + f"""
, keymap as (select * from (values {_KEYMAP}) t(config_key, recommendation, bound)),
r as (select k.recommendation,
   max(case when k.bound = 'min_name' then try_cast(trim(b.config_value) as double) end) as min_name,
   max(case when k.bound = 'max_name' then try_cast(trim(b.config_value) as double) end) as max_name,
   max(case when k.bound = 'min_addr' then try_cast(trim(b.config_value) as double) end) as min_addr,
   max(case when k.bound = 'max_addr' then try_cast(trim(b.config_value) as double) end) as max_addr
  from bucket_config b join keymap k on k.config_key = b.config_key
  where b.category = 'BUCKETS' group by k.recommendation),
c as (select recommendation, count(*) as n from m group by recommendation)
select r.*, c.n from r left join c on c.recommendation = r.recommendation""")
def bucket_pivot(spark, sf_dir):
    """Bucket score ranges per recommendation with its row count (stats + config)."""
    ranges = L.bucket_ranges(IN.bucket_config(spark))
    counts = _m(spark, sf_dir).groupBy("recommendation").agg(F.count(F.lit(1)).alias("n"))
    return ranges.join(counts, "recommendation", "left")


@query("id_list_parse", O.with_ctes(["id_file"]) + O.ID_LIST)
def id_list_parse(spark, sf_dir):
    """The stored id file read as text and parsed."""
    return L.parse_id_list(IN.id_file(spark, sf_dir))


# ---- 2. View ---------------------------------------------------------------

def _view_sql(where: str) -> str:
    return O.with_ctes(["m"]) + f"select {O.SHIPPED_SQL} from m where {where}"


@query("page_from_offset_all", O.with_ctes(["m"]) +
       f"select {O.SHIPPED_SQL} from m order by canvas_name asc nulls last, id offset 100")
def page_from_offset_all(spark, sf_dir):
    """O3: page length -1 -- every row from position 100 in canvas_name order."""
    return V.shipped(V.from_offset(_m(spark, sf_dir), 100, ("canvas_name", "asc")))


PAGE_FILTER = V.ViewFilter(recommendations="NEEDS REVIEW,PROCESSED", min_addr=20)
_PAGE_SQL = O.with_ctes(["m"]) + f""", v as (select * from m where recommendation in ('NEEDS REVIEW', 'PROCESSED') and address_score >= 20)
select {O.SHIPPED_SQL}, (select count(*) from m) as records_total, (select count(*) from v) as records_filtered
from v order by name_score desc nulls last, id"""


@query("page_with_counts", _PAGE_SQL + " limit 25 offset 25")
def page_with_counts(spark, sf_dir):
    """The second page of a view with its total and filtered counts, from one job."""
    got = V.page_with_counts(_m(spark, sf_dir), PAGE_FILTER, 25, 25, ("name_score", "desc"))
    return got.select(*V.shipped(got).columns, "records_total", "records_filtered")


@query("page_all_with_counts", _PAGE_SQL + " offset 30")
def page_all_with_counts(spark, sf_dir):
    """Every row of the view from position 30 (length -1), with both counts."""
    got = V.page_with_counts(_m(spark, sf_dir), PAGE_FILTER, 30, -1, ("name_score", "desc"))
    return got.select(*V.shipped(got).columns, "records_total", "records_filtered")


@query("clear_filters", O.with_ctes(["m"]) + f"select {O.SHIPPED_SQL} from m")
def clear_filters(spark, sf_dir):
    """a view after all its filters were cleared."""
    return V.shipped(V.view(_m(spark, sf_dir), V.ViewFilter()))


@query("ssn_partial", _view_sql("ssn_match > 0 and ssn_match < 100"))
def ssn_partial(spark, sf_dir):
    """the partial-SSN preset."""
    return V.shipped(V.view(_m(spark, sf_dir), V.ViewFilter(ssn="partial")))


@query("score_range", _view_sql(
    "name_score >= 40 and name_score <= 80 and address_score >= 50 and address_score <= 90"))
def score_range(spark, sf_dir):
    """inclusive score ranges (NULL scores drop out)."""
    f = V.ViewFilter(min_name=40, max_name=80, min_addr=50, max_addr=90)
    return V.shipped(V.view(_m(spark, sf_dir), f))


SEARCH_PATTERN = r"^10\d$|trust|a\.b"


@query("global_search_regex", _view_sql(O.search_any(SEARCH_PATTERN)))
def global_search_regex(spark, sf_dir):
    """case-insensitive regex over the text form of every column."""
    return V.shipped(V.view(_m(spark, sf_dir), V.ViewFilter(search=SEARCH_PATTERN)))


QUICK_TEXT = "needs  main"


@query("quick_filter_words", _view_sql(O.quick_filter(QUICK_TEXT)))
def quick_filter_words(spark, sf_dir):
    """F8: all words contained in some visible column's display text."""
    return V.shipped(V.view(_m(spark, sf_dir), V.ViewFilter(quick=QUICK_TEXT)))


def _bucket_sql(inside: bool) -> str:
    def bound(score, b, op):
        return f"(r.{b} is null or coalesce(m.{score} {op} r.{b}, false))"
    test = " and ".join([bound("name_score", "min_name", ">="), bound("name_score", "max_name", "<="),
                         bound("address_score", "min_addr", ">="), bound("address_score", "max_addr", "<=")])
    where = test if inside else f"not ({test})"
    return O.with_ctes(["m", "bucket_config"]) + f"""
, keymap as (select * from (values {_KEYMAP}) t(config_key, recommendation, bound)),
r as (select k.recommendation,
   max(case when k.bound = 'min_name' then try_cast(trim(b.config_value) as double) end) as min_name,
   max(case when k.bound = 'max_name' then try_cast(trim(b.config_value) as double) end) as max_name,
   max(case when k.bound = 'min_addr' then try_cast(trim(b.config_value) as double) end) as min_addr,
   max(case when k.bound = 'max_addr' then try_cast(trim(b.config_value) as double) end) as max_addr
  from bucket_config b join keymap k on k.config_key = b.config_key
  where b.category = 'BUCKETS' group by k.recommendation)
select {O.qualified(O.SHIPPED_NORMALIZED, 'm')} from m join r on m.recommendation = r.recommendation
where {where}"""


@query("bucket_view", _bucket_sql(True))
def bucket_view(spark, sf_dir):
    """Rows of each bucket recommendation within its configured ranges."""
    ranges = L.bucket_ranges(IN.bucket_config(spark))
    return V.shipped(V.bucket_rows(_m(spark, sf_dir), ranges, inside=True))


@query("bucket_outliers", _bucket_sql(False))
def bucket_outliers(spark, sf_dir):
    """F11 complement: rows of a bucket recommendation its ranges hide."""
    ranges = L.bucket_ranges(IN.bucket_config(spark))
    return V.shipped(V.bucket_rows(_m(spark, sf_dir), ranges, inside=False))


@query("record_lookup", O.with_ctes(["m", "edits"]) + f"""
select id, {O.code_label('canvas_id', 'canvas_addrseq')} as canvas_id_label, canvas_ssn, canvas_name,
 canvas_address, canvas_city, canvas_state, canvas_zip, dec_name, dec_address, dec_city, dec_state, dec_zip,
 dec_contact, dec_hdrcode, ssn_match, name_score, address_score, {O.score_band('ssn_match')} as ssn_band,
 {O.score_band('name_score')} as name_band, {O.score_band('address_score')} as address_band,
 recommendation, address_reason, memo from m where id in (select id from edits)""")
def record_lookup(spark, sf_dir):
    """P20: the record form of every row someone opened for editing."""
    m = _m(spark, sf_dir)
    ed = IN.edits(spark, sf_dir)
    return V.record_form(semi_join(m, ed.select("id").distinct(), "id", ed.select("id")))


@query("domain_order", O.with_ctes(["m"]) + f"""
select {O.rec_rank()} as rank, recommendation, count(*) as n from m where recommendation is not null
group by recommendation""")
def domain_order(spark, sf_dir):
    """Recommendation counts in the preferred display order."""
    return ST.domain_order(_m(spark, sf_dir))


# ---- 3. Derived ------------------------------------------------------------

@query("display_columns", O.with_ctes(["m"]) + f"""
select id, {O.code_label('canvas_id', 'canvas_addrseq')} as canvas_id_label,
 {O.csz_label('canvas_city', 'canvas_state', 'canvas_zip')} as canvas_csz,
 {O.csz_label('dec_city', 'dec_state', 'dec_zip')} as dec_csz,
 {O.code_label('dec_hdrcode', 'dec_addrsubcode')} as dec_code_label,
 {O.effective_process()} as process from m""")
def display_columns(spark, sf_dir):
    """P4-P8."""
    return V.display_columns(_m(spark, sf_dir))


@query("score_bands", O.with_ctes(["m"]) + f"""
select id, case when ssn_match = 100 then 'Yes' else 'No' end as ssn_badge,
 {O.score_band('name_score')} as name_band, {O.score_band('address_score')} as address_band,
 case when upper(coalesce(recommendation, '')) = 'NEEDS REVIEW' then {O.score_band('nameaddrscore')}
      else 'NS' end as nameaddr_band from m""")
def score_bands(spark, sf_dir):
    """P9-P11."""
    return V.score_bands(_m(spark, sf_dir))


@query("review_flags", O.with_ctes(["m"]) + f"""
select id, {O.regex_hit('canvas_name', O.DNU_RE2)} as canvas_name_dnu,
 {O.regex_hit('canvas_address', O.DNU_RE2)} as canvas_address_dnu,
 {O.regex_hit('dec_name', O.DNU_RE2)} as dec_name_dnu,
 {O.regex_hit('dec_address', O.DNU_RE2)} as dec_address_dnu,
 coalesce(cast(is_trust as varchar) in ('1', 'true', 'True'), false) as trust,
 coalesce(name_score < 45, false) as low_name_hint,
 coalesce(address_score > 45 and contains(upper(recommendation), 'NEW ADDRESS'), false) as address_hint,
 coalesce(jib <> 0, false) as jib_on, coalesce(rev <> 0, false) as rev_on, coalesce(vendor <> 0, false) as vendor_on,
 coalesce(cast(dec_address_looked_up as varchar) = '1', false) as address_looked_up from m""")
def review_flags(spark, sf_dir):
    """P12-P16."""
    return V.review_flags(_m(spark, sf_dir))


def _export_sql(where: str, ctes: list[str]) -> str:
    labels = ", ".join(f"coalesce({O.display_value(cid)}, '') as \"{label}\""
                       for cid, label, vis in S.GRID_COLUMNS if vis)
    return O.with_ctes(ctes) + f"select {labels} from m where {where}"


@query("export_view", _export_sql("recommendation = 'NEEDS REVIEW' and ssn_match = 0", ["m"]))
def export_view(spark, sf_dir):
    """The current view's visible columns under header labels, as text."""
    f = V.ViewFilter(recommendations="NEEDS REVIEW", ssn="no")
    return V.export_columns(V.view(_m(spark, sf_dir), f))


VISIBLE = ["id", "canvas_name", "canvas_csz", "dec_hdrcode", "memo"]


@query("visible_columns", O.with_ctes(["m"]) + "select " + ", ".join(
    f"coalesce({O.display_value(cid)}, '') as \"{label}\"" for cid, label, _ in S.GRID_COLUMNS if cid in VISIBLE)
    + " from m where recommendation = 'NEEDS REVIEW'")
def visible_columns(spark, sf_dir):
    """A view with a chosen set of columns switched on and the others off."""
    return V.export_columns(V.view(_m(spark, sf_dir), V.ViewFilter(recommendations="NEEDS REVIEW")), VISIBLE)


@query("export_selected", _export_sql("id in (select id from selection)", ["m", "selection"]))
def export_selected(spark, sf_dir):
    """Export of the selected rows."""
    m = _m(spark, sf_dir)
    return V.export_columns(semi_join(m, IN.selection(spark, sf_dir), "id"))


@query("json_records", O.with_ctes(["m"]) + "select id, cast(to_json({" +
       ", ".join(f"'{c}': {c}" for c in O.SHIPPED_NORMALIZED) + "}) as varchar) as record from m")
def json_records(spark, sf_dir):
    """One JSON record per row, NULLs kept as keys."""
    from matchdesk.sources.sinks import json_records as records
    return records(_m(spark, sf_dir))


# ---- 4. Stats --------------------------------------------------------------

@query("stats_summary", O.with_ctes(["m"]) + """
select count(*) as total_records, round(avg(name_score), 1) as avg_name_score,
 round(avg(address_score), 1) as avg_address_score,
 count(*) filter (where ssn_match = 100) as ssn_perfect_matches,
 count(*) filter (where ssn_match > 0 and ssn_match < 100) as ssn_partial_matches,
 count(*) filter (where ssn_match = 0) as ssn_no_match from m""")
def stats_summary(spark, sf_dir):
    """A1/A3/A4."""
    return ST.summary(_m(spark, sf_dir))


@query("recommendation_counts", O.with_ctes(["m"]) + f"""
select recommendation, n, round(100.0::double * n / total, 1) as pct, {O.rec_rank()} as rank from
 (select recommendation, count(*) as n, sum(count(*)) over () as total from m group by recommendation)
where recommendation is not null""")
def recommendation_counts(spark, sf_dir):
    """A2/A10/P17."""
    return ST.recommendation_counts(_m(spark, sf_dir))


@query("distinct_recommendations", O.with_ctes(["m"]) +
       "select distinct recommendation from m where recommendation is not null")
def distinct_recommendations(spark, sf_dir):
    """A5."""
    return ST.distinct_recommendations(_m(spark, sf_dir))


VIEW_COUNT_FILTER = V.ViewFilter(recommendations="NEEDS REVIEW,PROCESSED", ssn="partial", min_addr=20,
                                 search=r"st\.")


@query("view_counts", O.with_ctes(["m"]) + f"""
select count(*) as records_total, count(*) filter (where recommendation in ('NEEDS REVIEW', 'PROCESSED')
 and ssn_match > 0 and ssn_match < 100 and address_score >= 20 and {O.search_any(r"st\.")}) as records_filtered
from m""")
def view_counts(spark, sf_dir):
    """Total and filtered counts of a view in one pass."""
    m = _m(spark, sf_dir)
    return ST.view_counts(m, V.view_predicate(m, VIEW_COUNT_FILTER))


# ---- 5. Search -------------------------------------------------------------

def _find_counts_sql(needle: str) -> str:
    hits = [O.ci_contains(c, needle) for c in S.FIND_COLUMNS]
    cells = " + ".join(f"(case when {h} then 1 else 0 end)" for h in hits)
    return O.with_ctes(["m"]) + (f"select cast(coalesce(sum({cells}), 0) as bigint) as matches, "
                                 f"count(*) filter (where {' or '.join(hits)}) as rows from m")


@query("find_counts", _find_counts_sql("st"))
def find_counts(spark, sf_dir):
    """Matching cells and rows for 'st' in all 9 text columns."""
    return SR.find_counts(_m(spark, sf_dir), "st")


FIND_NEEDLE = "a.b"


def _cells_sql(needle: str, cols: list[str], cs: bool = False, src: str = "m") -> str:
    pred = (lambda c: O.cs_contains(c, needle)) if cs else (lambda c: O.ci_contains(c, needle))
    return O.cells_union(pred, cols, src)


@query("find_match_numbers", O.with_ctes(["m"]) + f"""
select id, field, col_pos, row_number() over (order by id, col_pos) as match_no, count(*) over () as n_matches
from ({_cells_sql(FIND_NEEDLE, S.FIND_COLUMNS)})""")
def find_match_numbers(spark, sf_dir):
    """W1: 'match i of n' for every matching cell."""
    return SR.find_match_numbers(_m(spark, sf_dir), FIND_NEEDLE).select(
        "id", "field", "col_pos", "match_no", "n_matches")


@query("find_next", O.with_ctes(["m"]) + f"""
, c as (select id, field, row_number() over (order by id, col_pos) as match_no, count(*) over () as n_matches
 from ({_cells_sql(FIND_NEEDLE, S.FIND_COLUMNS)}))
select a.id, a.field, a.match_no, a.n_matches, b.match_no as next_no, b.id as next_id, b.field as next_field
from c a join c b on b.match_no = a.match_no % a.n_matches + 1""")
def find_next(spark, sf_dir):
    """The next match of each match, wrapping."""
    return SR.find_next(_m(spark, sf_dir), FIND_NEEDLE)


REPLACE_WITH = "$1"


@query("replace_all_edits", O.with_ctes(["m"]) + f"""
select id, field, value as old_value,
 regexp_replace(value, {q('(?i)' + O.re2_quote(FIND_NEEDLE))}, {q(O.re2_replacement(REPLACE_WITH))}, 'g') as new_value
from ({_cells_sql(FIND_NEEDLE, S.FIND_COLUMNS)})
where value <> regexp_replace(value, {q('(?i)' + O.re2_quote(FIND_NEEDLE))}, {q(O.re2_replacement(REPLACE_WITH))}, 'g')""")
def replace_all_edits(spark, sf_dir):
    """M3: case-insensitive replace of 'a.b' by '$1' (both literal) everywhere."""
    return SR.replace_edits(_m(spark, sf_dir), FIND_NEEDLE, REPLACE_WITH)


@query("replace_case_sensitive", O.with_ctes(["m"]) + f"""
select id, field, value as old_value, replace(value, 'St.', 'Street') as new_value
from ({_cells_sql('St.', ['canvas_address'], cs=True)}) where value <> replace(value, 'St.', 'Street')""")
def replace_case_sensitive(spark, sf_dir):
    """M3, case-sensitive, one column."""
    return SR.replace_edits(_m(spark, sf_dir), "St.", "Street", column="canvas_address", case_sensitive=True)


@query("replace_in_view", O.with_ctes(["m"]) + f"""
, v as (select * from m where recommendation in ('NEEDS REVIEW') and ssn_match > 0 and ssn_match < 100)
select id, field, value as old_value, regexp_replace(value, '(?i)\\Qcall\\E', 'CALL', 'g') as new_value
from ({_cells_sql('call', ['memo'], src='v')}) where value <> regexp_replace(value, '(?i)\\Qcall\\E', 'CALL', 'g')""")
def replace_in_view(spark, sf_dir):
    """Replace restricted to the rows of the current view."""
    rows = V.view(_m(spark, sf_dir), V.ViewFilter(recommendations="NEEDS REVIEW", ssn="partial"))
    return SR.replace_edits(rows, "call", "CALL", column="memo")


@query("replace_current_match", O.with_ctes(["m"]) + f"""
, c as (select * from ({_cells_sql(FIND_NEEDLE, S.FIND_COLUMNS)}) order by id, col_pos limit 1)
select id, field, value as old_value,
 regexp_replace(value, {q('(?i)' + O.re2_quote(FIND_NEEDLE))}, {q(O.re2_replacement(REPLACE_WITH))}, 'g') as new_value
from c where value <> regexp_replace(value, {q('(?i)' + O.re2_quote(FIND_NEEDLE))}, {q(O.re2_replacement(REPLACE_WITH))}, 'g')""")
def replace_current_match(spark, sf_dir):
    """M4: replace in the current match only -- match 1 of the find order."""
    return SR.replace_current(_m(spark, sf_dir), FIND_NEEDLE, REPLACE_WITH)


@query("replace_counts", O.with_ctes(["m"]) + f"""
select count(*) as replaced, count(distinct id) as rows from ({_cells_sql(FIND_NEEDLE, S.FIND_COLUMNS)})
where value <> regexp_replace(value, {q('(?i)' + O.re2_quote(FIND_NEEDLE))}, {q(O.re2_replacement(REPLACE_WITH))}, 'g')""")
def replace_counts(spark, sf_dir):
    """Replaced cells and rows."""
    return SR.replace_counts(SR.replace_edits(_m(spark, sf_dir), FIND_NEEDLE, REPLACE_WITH))


# ---- 6. Edits --------------------------------------------------------------

@query("bulk_approve", O.with_ctes(["m", "selection"]) + """
select id, 'recommendation' as field, recommendation as old_value, 'APPROVED' as new_value
from m where id in (select id from selection)""")
def bulk_approve(spark, sf_dir):
    """M2/M7: approve the selected rows."""
    return E.bulk_set(_m(spark, sf_dir), IN.selection(spark, sf_dir))


@query("bulk_rejects", O.with_ctes(["m", "selection"]) +
       "select s.id from selection s where not exists (select 1 from m where m.id = s.id)")
def bulk_rejects(spark, sf_dir):
    """Selected ids that are not in the table."""
    return E.rejects(IN.selection(spark, sf_dir), _m(spark, sf_dir))


@query("bulk_counts", O.with_ctes(["m", "selection"]) + """
select count(*) as requested, count(m.id) as updated, count(*) - count(m.id) as rejected
from selection s left join m on m.id = s.id""")
def bulk_counts(spark, sf_dir):
    """Requested, updated and rejected counts of a bulk approve (one pass)."""
    from matchdesk.operators.joins import known_keys, small_side
    sel = IN.selection(spark, sf_dir)
    known = known_keys(sel, _m(spark, sf_dir), "id").withColumn("_known", F.lit(True))
    j = sel.join(small_side(known, sel), "id", "left")
    return j.agg(F.count(F.lit(1)).alias("requested"), F.count("_known").alias("updated"),
                 (F.count(F.lit(1)) - F.count("_known")).alias("rejected"))


@query("import_flag", O.with_ctes(["m", "id_file"], [("ids", O.ID_LIST)]) + """
select id, 'jib' as field, cast(jib as varchar) as old_value, '1' as new_value from m
where regexp_replace(canvas_id, '^\\s+|\\s+$', '', 'g') in (select canvas_id from ids) and jib <> 1""")
def import_flag(spark, sf_dir):
    """JIB flags from the uploaded id file."""
    ids = L.parse_id_list(IN.id_file(spark, sf_dir))
    return E.import_flag(_m(spark, sf_dir), ids, "jib")


@query("import_counts", O.with_ctes(["m", "id_file"], [("ids", O.ID_LIST)]) + """
, hit as (select * from m where regexp_replace(canvas_id, '^\\s+|\\s+$', '', 'g') in (select canvas_id from ids))
select count(*) filter (where jib <> 1) as updated, count(*) filter (where jib = 1) as already_set,
 count(*) as matched, (select count(*) from ids) as total_in_file from hit""")
def import_counts(spark, sf_dir):
    """A9."""
    ids = L.parse_id_list(IN.id_file(spark, sf_dir))
    return E.import_counts(_m(spark, sf_dir), ids, "jib")


@query("set_process_in_view", O.with_ctes(["m"]) + """
select id, 'how_to_process' as field, how_to_process as old_value,
 'Merge BA and address' as new_value from m
where recommendation = 'EXISTING BA AND EXISTING ADDRESS' and name_score >= 50
 and coalesce(how_to_process, '') <> 'Merge BA and address'""")
def set_process_in_view(spark, sf_dir):
    """Set the process of every row in view."""
    rows = V.view(_m(spark, sf_dir), V.ViewFilter(recommendations="EXISTING BA AND EXISTING ADDRESS", min_name=50))
    return E.set_process(rows, "Merge BA and address")


@query("set_process_on_cells", O.with_ctes(["m", "edits"]) + """
select id, 'how_to_process' as field, how_to_process as old_value, 'Add address to existing BA' as new_value from m
where id in (select id from edits where field in ('memo', 'how_to_process'))
 and coalesce(how_to_process, '') <> 'Add address to existing BA'""")
def set_process_on_cells(spark, sf_dir):
    """The process of every row of a chosen cell range whose value differs."""
    cells = IN.edits(spark, sf_dir).filter(F.col("field").isin("memo", "how_to_process")).select("id")
    return E.set_process(semi_join(_m(spark, sf_dir), cells.distinct(), "id", cells), "Add address to existing BA")


def _forms(spark, sf_dir):
    """Record forms: rows with a name edit, the latest name typed, other
    fields as the form shows them (NULL -> '')."""
    ed = IN.edits(spark, sf_dir).filter(F.col("field") == "canvas_name")
    return E.last_values(ed, ["id"]).select("id", F.col("new_value").alias("canvas_name"))


_FORM_SQL = O.with_ctes(["m", "edits"]) + """
, f as (select id, arg_max(new_value, seq) as nv from edits where field = 'canvas_name' group by id),
forms as (select m.id, f.nv as canvas_name, """ + ", ".join(
    f"coalesce(m.{c}, '') as {c}" for c in E.FORM_FIELDS if c != "canvas_name") + """ from m join f on f.id = m.id),
pairs as (""" + " union all ".join(
    f"select forms.id, {q(c)} as field, m.{c} as old_value, forms.{c} as new_value from forms join m on m.id = forms.id"
    for c in E.FORM_FIELDS) + ")\n"


@query("form_save_edits", _FORM_SQL + "select * from pairs")
def form_save_edits(spark, sf_dir):
    """M8: 8 edits per record-form save, changed or not."""
    return E.form_edits(_forms(spark, sf_dir), _m(spark, sf_dir))


@query("toggle_flag_range", O.with_ctes(["m", "edits"]) + """
select id, 'rev' as field, cast(rev as varchar) as old_value, '1' as new_value from m
where id in (select id from edits where field in ('memo', 'jib'))""")
def toggle_flag_range(spark, sf_dir):
    """M9: REV set once per row over a range of selected cells."""
    cells = IN.edits(spark, sf_dir).filter(F.col("field").isin("memo", "jib")).select("id", "field")
    return E.toggle_flag(cells, _m(spark, sf_dir), "rev", 1)


_FLAGS_SQL = ", ".join(q(f) for f in S.FLAG_FIELDS)
_EDITABLE_SQL = ", ".join(q(f) for f in S.EDITABLE_FIELDS)


_CHECKED_SQL = O.with_ctes(["m", "proposed"]) + f""", checked as (
select e.seq, e.id, e.field,
 case when e.field in ({_FLAGS_SQL}) and regexp_matches(trim(e.new_value), '^[+-]?[0-9]+$')
      then cast(cast(trim(e.new_value) as integer) as varchar) else e.new_value end as new_value,
 case when e.field not in ({_EDITABLE_SQL}) then 'unknown_field'
      when k.id is null then 'unknown_id'
      when e.field in ({_FLAGS_SQL}) and not coalesce(regexp_matches(trim(e.new_value), '^[+-]?[0-9]+$'), false) then 'bad_value'
      else 'ok' end as status
from proposed e left join (select id from m) k on k.id = e.id)
"""


@query("validate_edits", _CHECKED_SQL + "select seq, id, field, new_value, status from checked")
def validate_edits(spark, sf_dir):
    """Status of every proposed edit."""
    return E.validate(FX.proposed_edits(IN.edits(spark, sf_dir)), _m(spark, sf_dir))


_SAVED: dict[tuple[str, str, str, str], ReviewTable] = {}
SAVE_TIME = _dt.datetime(2024, 3, 1, 9, 0, 0)


def _saved(spark, sf_dir, by: str = "id") -> ReviewTable:
    """A review table that took one save of the proposed edits; saved once per application
    and state of the data."""
    key = (spark.sparkContext.applicationId, sf_dir, IN.source_state(spark, sf_dir), by)
    if key not in _SAVED:
        table = ReviewTable.create(spark, _fresh(spark, f"save-{by}"), _m(spark, sf_dir))
        table.save(FX.proposed_edits(IN.edits(spark, sf_dir)), "s1", SAVE_TIME, by)
        _SAVED[key] = table
    return _SAVED[key]


@query("save_rejects", _CHECKED_SQL + "select seq, id, field, new_value, status from checked where status <> 'ok'")
def save_rejects(spark, sf_dir):
    """The edits a save refused, read back from the rejects table."""
    return _saved(spark, sf_dir).rejects().drop("save")


_ACCEPTED_SQL = _CHECKED_SQL + f""", pending as (select l.id, l.field, {O.field_text('l.field')} as old_value, l.new_value, l.seq, m.canvas_id, m.canvas_ssn
 from (select id, field, max(seq) as seq, arg_max_null(new_value, seq) as new_value from checked where status = 'ok' group by id, field) l
 join m on m.id = l.id)
"""


@query("save_snapshot_by_id", _ACCEPTED_SQL + f", p as ({O.change_pivot('pending', ['id'])})\n"
       + f"select {O.overlay_columns()} from m left join p on p.id = m.id")
def save_snapshot_by_id(spark, sf_dir):
    """The whole new version of the table, read back after the save."""
    return _saved(spark, sf_dir).snapshot()


@query("audit_readback", _ACCEPTED_SQL + """select canvas_id, canvas_ssn, field as field_name, old_value, new_value,
 timestamp '2024-03-01 09:00:00' as updated_at from pending""")
def audit_readback(spark, sf_dir):
    """The audit rows of the save, read back from the stored log."""
    return _saved(spark, sf_dir).audit().select(
        "canvas_id", "canvas_ssn", "field_name", "old_value", "new_value", "updated_at")


_KEY_PIVOT_SQL = f""", ke as (select canvas_id, canvas_ssn, field, arg_max_null(new_value, seq) as new_value
   from pending group by canvas_id, canvas_ssn, field),
p as ({O.change_pivot('ke', ['canvas_id', 'canvas_ssn'])})
"""


@query("save_snapshot_by_key", _ACCEPTED_SQL + _KEY_PIVOT_SQL +
       f"select {O.overlay_columns()} from m left join p on p.canvas_id = m.canvas_id and p.canvas_ssn = m.canvas_ssn")
def save_snapshot_by_key(spark, sf_dir):
    """The whole table after a save by business key, read back; only the buckets
    that hold an edited key were written anew."""
    return _saved(spark, sf_dir, "key").snapshot()


_KEYED_SQL = O.with_ctes(["m", "edits"]) + """, keyed as (select e.seq,
 case when e.seq % 17 = 0 then concat(m.canvas_id, 'x') else m.canvas_id end as canvas_id,
 case when e.seq % 13 = 0 then null else m.canvas_ssn end as canvas_ssn, e.field, e.new_value from edits e join m on m.id = e.id),
keys as (select distinct canvas_id, canvas_ssn from keyed),
hits as (select k.canvas_id, k.canvas_ssn, (select count(*) from m where m.canvas_id = k.canvas_id and m.canvas_ssn = k.canvas_ssn) as n from keys k)
"""


def _keyed(spark, sf_dir):
    return FX.keyed_changes(IN.edits(spark, sf_dir), _m(spark, sf_dir))


@query("save_key_counts", _KEYED_SQL + """select count(*) as edited_keys, count(*) filter (where n = 0) as unmatched_keys,
 cast(coalesce(sum(n), 0) as bigint) as rows_affected from hits""")
def save_key_counts(spark, sf_dir):
    """Keys edited, keys without a row and rows affected by a save by business key."""
    return SV.key_counts(_m(spark, sf_dir), _keyed(spark, sf_dir))


@query("unmatched_keys", _KEYED_SQL + "select canvas_id, canvas_ssn from hits where n = 0")
def unmatched_keys(spark, sf_dir):
    """Q5: pending keys that match no row; a NULL key never does."""
    return SV.unmatched_keys(_keyed(spark, sf_dir), _m(spark, sf_dir))


@query("discard_reload", _ACCEPTED_SQL + f", p as ({O.change_pivot('pending', ['id'])})\n"
       + f"select {O.overlay_columns()} from m left join p on p.id = m.id")
def discard_reload(spark, sf_dir):
    """A cached snapshot after another writer's save and a forced reload, which also
    drops the edits pending on it."""
    from matchdesk.sources.review_table import LAYOUT
    table = ReviewTable.create(spark, _fresh(spark, "reload"), _m(spark, sf_dir))
    name = f"snapshot_{uuid.uuid4().hex[:8]}"
    cached = CA.open_cached(spark, name, f"{table.root}/matches", LAYOUT)
    cached.count()
    table.save(FX.proposed_edits(IN.edits(spark, sf_dir)), "s1", SAVE_TIME)
    return CA.reload(spark, name)


_PENDING_SQL = O.with_ctes(["m", "edits"], [("l", O.LAST_EDITS)]) + f"""
, pending as (select l.id, l.field, {O.field_text('l.field')} as old_value, l.new_value, l.seq,
   m.canvas_id, m.canvas_ssn from l join m on m.id = l.id)
"""


def _pending(spark, sf_dir, with_key=False):
    return E.compact(IN.edits(spark, sf_dir), _m(spark, sf_dir), with_key=with_key)


@query("pending_changes", _PENDING_SQL + "select id, field, old_value, new_value, seq from pending")
def pending_changes(spark, sf_dir):
    """First old, last new per (row, field)."""
    return _pending(spark, sf_dir)


@query("pending_count", _PENDING_SQL + "select count(distinct id) as pending_count from pending")
def pending_count(spark, sf_dir):
    """A8."""
    return E.pending_count(_pending(spark, sf_dir))


@query("net_changes", _PENDING_SQL +
       "select id, field, old_value, new_value, seq from pending where old_value is distinct from new_value")
def net_changes(spark, sf_dir):
    """Pending changes that change something."""
    return E.net_changes(_pending(spark, sf_dir))


@query("edited_fields", _PENDING_SQL + "select distinct field from pending")
def edited_fields(spark, sf_dir):
    """A14."""
    return E.edited_fields(_pending(spark, sf_dir))


_OVERLAY_SQL = _PENDING_SQL + f", p as ({O.change_pivot('pending', ['id'])})\n"


@query("overlay_matches", _OVERLAY_SQL + f"select {O.overlay_columns()} from m left join p on p.id = m.id")
def overlay_matches(spark, sf_dir):
    """The snapshot with every pending change applied."""
    ed = IN.edits(spark, sf_dir)
    return E.overlay(_m(spark, sf_dir), E.last_values(ed, ["id", "field"]), ed)


_UNDO_SQL = "with recursive " + f"actions as ({O.ACTIONS}),\n" + """
a as (select *, row_number() over (partition by session order by seq) rn from actions),
f as (
  select session, 0::bigint rn, []::bigint[] u, []::bigint[] r, []::bigint[] d from (select distinct session from a)
  union all
  select f.session, a.rn,
    case when a.op='do' then case when len(f.u)>=50 then list_append(f.u[2:], a.action_id) else list_append(f.u, a.action_id) end
         when a.op='undo' and len(f.u)>0 then f.u[:len(f.u)-1]
         when a.op='redo' and len(f.r)>0 then list_append(f.u, f.r[len(f.r)]) else f.u end,
    case when a.op='do' then []::bigint[]
         when a.op='undo' and len(f.u)>0 then list_append(f.r, f.u[len(f.u)])
         when a.op='redo' and len(f.r)>0 then f.r[:len(f.r)-1] else f.r end,
    case when a.op='do' and len(f.u)>=50 then list_append(f.d, f.u[1]) else f.d end
  from f join a on a.session=f.session and a.rn=f.rn+1),
fin as (select session, arg_max(u, rn) u, arg_max(d, rn) d from f group by session)
"""


@query("undo_stack", _UNDO_SQL + "select session, unnest(u) as action_id from fin")
def undo_stack(spark, sf_dir):
    """Each session's undo stack after its actions."""
    return U.undo_stack(IN.actions(spark, sf_dir))


@query("undo_redo_effective", _UNDO_SQL + "select session, unnest(list_concat(d, u)) as action_id from fin")
def undo_redo_effective(spark, sf_dir):
    """Actions in effect (undo stack + pushed off by the cap)."""
    return U.effective(IN.actions(spark, sf_dir))


_TRAIL_SQL = f"""h as (select e.seq as action_id, m.id, e.field,
   case when lag(e.seq) over w is null then {O.field_text('e.field')} else lag(e.new_value) over w end as old_value, e.new_value
  from edits e join m on m.id = e.id window w as (partition by e.id, e.field order by e.seq))"""


@query("undo_applied", O.with_ctes(["m", "edits", "actions"]).replace("with ", "with recursive ", 1) + """,
a as (select *, row_number() over (partition by session order by seq) rn from actions),
f as (
  select session, 0::bigint rn, null::bigint seq, null::varchar op, null::bigint act, []::bigint[] u, []::bigint[] r
  from (select distinct session from a)
  union all
  select f.session, a.rn, a.seq, a.op,
    case when a.op='do' then a.action_id when a.op='undo' and len(f.u)>0 then f.u[len(f.u)]
         when a.op='redo' and len(f.r)>0 then f.r[len(f.r)] end,
    case when a.op='do' then case when len(f.u)>=50 then list_append(f.u[2:], a.action_id) else list_append(f.u, a.action_id) end
         when a.op='undo' and len(f.u)>0 then f.u[:len(f.u)-1]
         when a.op='redo' and len(f.r)>0 then list_append(f.u, f.r[len(f.r)]) else f.u end,
    case when a.op='do' then []::bigint[]
         when a.op='undo' and len(f.u)>0 then list_append(f.r, f.u[len(f.u)])
         when a.op='redo' and len(f.r)>0 then f.r[:len(f.r)-1] else f.r end
  from f join a on a.session=f.session and a.rn=f.rn+1),
""" + _TRAIL_SQL + f""",
w as (select f.seq, h.id, h.field, case when f.op = 'undo' then h.old_value else h.new_value end as new_value
  from f join h on h.action_id = f.act),
l as (select id, field, arg_max_null(new_value, seq) as new_value from w group by id, field),
p as ({O.change_pivot('l', ['id'])})
select {O.overlay_columns()} from m left join p on p.id = m.id""")
def undo_applied(spark, sf_dir):
    """The table after every session's edits, undos and redos: an undo writes the old
    values back, a redo the new ones again, and the last write of a cell stands."""
    log = IN.audit_log(spark, sf_dir)
    changes = log.select(F.col("id").alias("action_id"), F.col("row_id").alias("id"), F.col("field_name").alias("field"),
                         "old_value", "new_value")
    return E.overlay(_m(spark, sf_dir), U.applied(IN.actions(spark, sf_dir), changes), changes)


# ---- 7. Save ---------------------------------------------------------------

@query("save_by_id", _OVERLAY_SQL + f"select {O.overlay_columns()} from m join p on p.id = m.id")
def save_by_id(spark, sf_dir):
    """New versions of the rows with pending changes (merge on id)."""
    ed = IN.edits(spark, sf_dir)
    return SV.save_by_id(_m(spark, sf_dir), E.last_values(ed, ["id", "field"]), ed)


@query("save_by_key", O.with_ctes(["m", "edits"]) + f"""
, ke as (select m.canvas_id, m.canvas_ssn, e.field, arg_max(e.new_value, e.seq) as new_value
   from edits e join m on m.id = e.id group by m.canvas_id, m.canvas_ssn, e.field),
p as ({O.change_pivot('ke', ['canvas_id', 'canvas_ssn'])})
select {O.overlay_columns()} from m join p on p.canvas_id = m.canvas_id and p.canvas_ssn = m.canvas_ssn""")
def save_by_key(spark, sf_dir):
    """MERGE on the business key -- all rows sharing an edited key."""
    return SV.save_by_key(_m(spark, sf_dir), IN.edits(spark, sf_dir))


SAVED_AT = _dt.datetime(2024, 2, 1, 12, 0, 0)


@query("audit_rows", _PENDING_SQL + """
select canvas_id, canvas_ssn, field as field_name, old_value, new_value,
 timestamp '2024-02-01 12:00:00' as updated_at from pending""")
def audit_rows(spark, sf_dir):
    """Audit rows of saving all pending changes at one time."""
    return SV.audit_rows(_pending(spark, sf_dir, with_key=True), SAVED_AT)


def _existing_edits(spark, sf_dir, m):
    """Edits of rows that exist: the snapshot's ids are narrowed to the edited
    ones by a broadcast semi join (edit-log bound), then the log is filtered
    by that small set -- the snapshot is not shuffled."""
    from matchdesk.operators.joins import known_keys
    ed = IN.edits(spark, sf_dir)
    return semi_join(ed, known_keys(ed, m, "id"), "id", ed.select("id"))


@query("audit_recent", O.with_ctes(["m", "edits"]) + f"""
, h as (select e.seq as id, m.canvas_id, m.canvas_ssn, e.field as field_name,
   case when lag(e.seq) over w is null then {O.field_text('e.field')} else lag(e.new_value) over w end as old_value,
   e.new_value, e.edited_at as updated_at
  from edits e join m on m.id = e.id window w as (partition by e.id, e.field order by e.seq))
select * from h order by updated_at desc, id desc limit 100""")
def audit_recent(spark, sf_dir):
    """Newest 100 rows of the stored audit log; only the newest days are scanned."""
    return recent(IN.audit_log(spark, sf_dir)).select(
        "id", "canvas_id", "canvas_ssn", "field_name", "old_value", "new_value", "updated_at")


@query("audit_volume", O.with_ctes(["m", "edits"]) + """
select e.field as field_name, cast(e.edited_at as date) as day, count(*) as changes
from edits e join m on m.id = e.id group by e.field, cast(e.edited_at as date)""")
def audit_volume(spark, sf_dir):
    """Audit volume per field and day."""
    m = _m(spark, sf_dir)
    trail = _existing_edits(spark, sf_dir, m).select(
        F.col("field").alias("field_name"), F.col("edited_at").alias("updated_at"))
    return ST.audit_volume(trail)


# ---- 8. Stream -------------------------------------------------------------

@query("edit_feed_apply", _OVERLAY_SQL + f"select {O.overlay_columns()} from m left join p on p.id = m.id")
def edit_feed_apply(spark, sf_dir):
    """ST1: the edit log replayed as a stream of files, applied batch by batch.

    The log is written as files whose seq ranges interleave, a quarter of them per micro-batch,
    so later batches carry edits older than ones already applied (late edits must lose).
    The result must equal the batch overlay.
    """
    from matchdesk.streaming.edit_feed import EditFeed

    root = _fresh(spark, "feed")
    log = IN.edits(spark, sf_dir)
    files = max(4, log.rdd.getNumPartitions())
    log.repartition(files, F.col("seq")).write.parquet(f"{root}/incoming")
    feed = EditFeed(spark, root, _m(spark, sf_dir))
    feed.start(f"{root}/incoming", files_per_batch=-(-files // 4))
    return feed.current()
