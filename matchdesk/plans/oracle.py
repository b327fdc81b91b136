"""Independent SQL for every registered query, run by DuckDB on the same Parquet.

Each statement rebuilds its inputs from the base tables with the fixture
statements of FIXTURES.md (as CTEs) and computes the answer with plain SQL,
sharing no code with the Spark side beyond fixed domain values.
"""

from __future__ import annotations

from matchdesk import schema as S

MATCHES = """select cast(l_orderkey as bigint) * 8 + l_linenumber as id,
 cast(c_custkey as varchar(20)) as canvas_id,
 case when c_custkey % 3 = 0 then cast(c_custkey % 7 as varchar(20)) else '' end as canvas_addrseq,
 lpad(cast((c_custkey * 7919) % 1000000000 as varchar(20)), 9, '0') as canvas_ssn,
 case when c_custkey % 17 = 0 then concat(c_name, ' DO NOT USE') when c_custkey % 19 = 0 then concat(c_name, ' Family Trust') else c_name end as canvas_name,
 concat(cast(c_custkey % 999 as varchar(20)), ' ', lower(c_mktsegment), ' St.') as canvas_address,
 cn.n_name as canvas_city, cr.r_name as canvas_state, lpad(cast((c_custkey * 31) % 100000 as varchar(20)), 5, '0') as canvas_zip,
 cast(s_suppkey as varchar(20)) as dec_hdrcode,
 case when s_suppkey % 4 = 0 then '' else cast(s_suppkey % 5 as varchar(20)) end as dec_addrsubcode,
 case when s_suppkey % 13 = 0 then concat(s_name, ' D.N.U.') else s_name end as dec_name,
 concat(cast(s_suppkey % 99 as varchar(20)), ' Main St') as dec_address, sn.n_name as dec_city, sr.r_name as dec_state,
 lpad(cast((s_suppkey * 37) % 100000 as varchar(20)), 5, '0') as dec_zip,
 concat('contact ', cast(s_suppkey as varchar(20))) as dec_contact,
 case when (c_custkey*31+s_suppkey) % 11 = 0 then null when (c_custkey+s_suppkey) % 5 = 0 then '100' when (c_custkey+s_suppkey) % 5 in (1,2) then '0' when (c_custkey+s_suppkey) % 41 = 3 then 'n/a' else cast((c_custkey*7+s_suppkey) % 101 as varchar(20)) end as ssn_match,
 case when (c_custkey+s_suppkey) % 23 = 0 then null else cast((c_custkey*37+s_suppkey*11) % 101 as varchar(20)) end as name_score,
 case when (c_custkey+s_suppkey) % 29 = 0 then null else cast((c_custkey*53+s_suppkey*29) % 101 as varchar(20)) end as address_score,
 case (c_custkey*3+s_suppkey) % 7 when 0 then 'NEW BA AND NEW ADDRESS' when 1 then 'EXISTING BA ADD NEW ADDRESS' when 2 then 'EXISTING BA AND EXISTING ADDRESS' when 3 then 'NEEDS REVIEW' when 4 then 'NEEDS REVIEW' when 5 then 'PROCESSED' else null end as recommendation,
 case when (c_custkey+s_suppkey) % 9 = 0 then 'Manual Review - DNP' else '' end as how_to_process,
 case when (c_custkey+s_suppkey) % 6 = 0 then concat('call A.B ', lower(c_mktsegment), ' a.b axb $1') when (c_custkey+s_suppkey) % 6 = 1 then null else '' end as memo,
 cast((c_custkey*37+s_suppkey*11) % 101 + (c_custkey*53+s_suppkey*29) % 101 as varchar(20)) as nameaddrscore,
 case (c_custkey+s_suppkey) % 3 when 0 then '1' when 1 then '0' else null end as dec_address_looked_up,
 concat('run-', cast(c_custkey % 4 as varchar(20))) as run_id,
 case when (c_custkey+s_suppkey) % 8 = 0 then 'suite differs' else '' end as address_reason,
 case (c_custkey+s_suppkey) % 5 when 0 then '1' when 1 then '0' when 2 then null when 3 then 'abc' else '1.7' end as jib,
 case (c_custkey+2*s_suppkey) % 6 when 0 then '1' when 1 then 'true' when 2 then 'True' when 3 then '0' when 4 then null else 'TRUE' end as is_trust
from (select l_orderkey, l_linenumber, min(l_suppkey) as l_suppkey from lineitem group by l_orderkey, l_linenumber) l
 join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey
 join nation cn on cn.n_nationkey = c_nationkey join region cr on cr.r_regionkey = cn.n_regionkey
 join nation sn on sn.n_nationkey = s_nationkey join region sr on sr.r_regionkey = sn.n_regionkey"""

BUCKET_CONFIG = """select * from (values ('BUCKETS','NEW_BA_NEW_ADDR_MIN_NAME_SCORE','0'),
  ('BUCKETS','NEW_BA_NEW_ADDR_MAX_NAME_SCORE','60'),
  ('BUCKETS','NEW_BA_NEW_ADDR_MIN_ADDR_SCORE','0'),
  ('BUCKETS','NEW_BA_NEW_ADDR_MAX_ADDR_SCORE','60'),
  ('BUCKETS','EXISTING_BA_NEW_ADDR_MIN_NAME_SCORE','60'),
  ('BUCKETS','EXISTING_BA_NEW_ADDR_MAX_NAME_SCORE',''),
  ('BUCKETS','EXISTING_BA_NEW_ADDR_MIN_ADDR_SCORE',''),
  ('BUCKETS','EXISTING_BA_NEW_ADDR_MAX_ADDR_SCORE','60'),
  ('BUCKETS','EXISTING_BA_EXISTING_ADDR_MIN_NAME_SCORE','60'),
  ('BUCKETS','EXISTING_BA_EXISTING_ADDR_MAX_NAME_SCORE','100'),
  ('BUCKETS','EXISTING_BA_EXISTING_ADDR_MIN_ADDR_SCORE','60'),
  ('BUCKETS','EXISTING_BA_EXISTING_ADDR_MAX_ADDR_SCORE','100'),
  ('OTHER','IGNORED','1')) t(category,config_key,config_value)"""

ID_FILE = """select concat(' ', cast(c_custkey as varchar(20)), ' ') as line from customer where c_custkey % 10 = 0 union all select concat(cast(c_custkey as varchar(20)), ',', cast(c_custkey+1 as varchar(20)), ',,') from customer where c_custkey % 50 = 5 union all select ''"""

MASTER = """select s_suppkey as id, cast(s_suppkey as varchar(20)) as hdrcode, lpad(cast((s_suppkey*7919) % 1000000000 as varchar(20)),9,'0') as ssn, s_name as hdrname, n_name as addrcity, r_name as addrstate from supplier join nation on n_nationkey=s_nationkey join region on r_regionkey=n_regionkey"""

EDITS = """select e.event_id as seq, t.id,
 case e.event_type when 'click' then 'memo' when 'view' then 'canvas_name' when 'purchase' then 'recommendation' when 'signup' then 'jib' else 'how_to_process' end as field,
 case e.event_type when 'click' then concat('m', cast(e.event_id as varchar(20))) when 'view' then concat('N ', cast(e.event_id % 10 as varchar(20))) when 'purchase' then 'APPROVED' when 'signup' then cast(e.event_id % 2 as varchar(20)) else 'Merge BA and address' end as new_value,
 e.ts as edited_at
from (select ev.*, n.cnt from events ev cross join (select count(*) as cnt from customer) n) e join (select canvas_id, min(id) as id from matches group by canvas_id) t
 on t.canvas_id = cast(e.event_id % e.cnt as varchar(20))"""

ACTIONS = """select user_id as session, event_id as seq, case event_type when 'error' then 'undo' when 'signup' then 'redo' else 'do' end as op, case when event_type in ('error','signup') then null else event_id end as action_id from events"""

SELECTION = """select distinct id + seq % 2 as id from edits where field = 'recommendation'"""


def num(c: str) -> str:
    """Text -> double, bad text and NaN -> NULL."""
    return f"case when isnan(try_cast({c} as double)) then null else try_cast({c} as double) end"


NORMALIZED = f"""select id, canvas_id, canvas_addrseq, canvas_ssn, canvas_name, canvas_address, canvas_city,
 canvas_state, canvas_zip, dec_hdrcode, dec_addrsubcode, dec_name, dec_address, dec_city, dec_state,
 dec_zip, dec_contact, {num('ssn_match')} as ssn_match, {num('name_score')} as name_score,
 {num('address_score')} as address_score, recommendation, how_to_process, memo,
 {num('nameaddrscore')} as nameaddrscore, dec_address_looked_up, run_id, address_reason,
 cast(trunc(coalesce({num('jib')}, 0)) as integer) as jib, is_trust, 0 as rev, 0 as vendor
 from matches"""

PROPOSED = """select seq, case when seq % 13 = 0 then -id else id end as id,
 case when seq % 11 = 0 then 'dec_name' else field end as field,
 case when field = 'jib' and seq % 7 = 0 then 'abc' when field = 'jib' and seq % 7 = 1 then '1.7' when field = 'jib' and seq % 7 = 2 then ''
      when field = 'jib' and seq % 7 = 3 then ' 1 ' when seq % 17 = 0 then null else new_value end as new_value, edited_at from edits"""

# CTE name -> (statement, CTEs it needs)
_CTES = {
    "matches": (MATCHES, []),
    "m": (NORMALIZED, ["matches"]),
    "bucket_config": (BUCKET_CONFIG, []),
    "id_file": (ID_FILE, []),
    "master": (MASTER, []),
    "edits": (EDITS, ["matches"]),
    "proposed": (PROPOSED, ["edits"]),
    "actions": (ACTIONS, []),
    "selection": (SELECTION, ["edits"]),
}


def with_ctes(needed: list[str], extra: list[tuple[str, str]] | None = None) -> str:
    """WITH clause with the fixture CTEs (and their dependencies) plus extras."""
    order: list[str] = []

    def add(name):
        if name in order:
            return
        for dep in _CTES[name][1]:
            add(dep)
        order.append(name)

    for n in needed:
        add(n)
    parts = [f"{n} as ({_CTES[n][0]})" for n in order]
    parts += [f"{n} as ({sql})" for n, sql in (extra or [])]
    return "with " + ",\n".join(parts) + "\n"


# ---------------------------------------------------------------------------
# SQL fragments for view semantics
# ---------------------------------------------------------------------------

SHIPPED_NORMALIZED = [c for c in S.SHIPPED_COLUMNS if c in {
    "id", "ssn_match", "name_score", "address_score", "nameaddrscore", "recommendation",
    "how_to_process", "canvas_id", "canvas_addrseq", "canvas_name", "canvas_address", "canvas_city",
    "canvas_state", "canvas_zip", "canvas_ssn", "dec_name", "dec_address", "dec_city", "dec_state",
    "dec_zip", "dec_hdrcode", "dec_addrsubcode", "dec_contact", "dec_address_looked_up",
    "address_reason", "jib", "rev", "vendor", "memo", "is_trust", "run_id"}]
SHIPPED_SQL = ", ".join(SHIPPED_NORMALIZED)


def sql_str(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def blank(c: str) -> str:
    return f"coalesce({c}, '')"


def number_text(c: str) -> str:
    return (f"case when {c} = floor({c}) and abs({c}) < 1e15 then cast(cast({c} as bigint) as varchar) "
            f"else cast({c} as varchar) end")


def code_label(code: str, sub: str) -> str:
    return f"case when {blank(sub)} <> '' then concat({blank(code)}, '-', {blank(sub)}) else {blank(code)} end"


def csz_label(city: str, state: str, zipc: str) -> str:
    return f"concat({blank(city)}, ', ', {blank(state)}, ' ', {blank(zipc)})"


def effective_process() -> str:
    whens = " ".join(f"when upper({blank('recommendation')}) = {sql_str(r)} then {sql_str(p)}"
                     for r, p in S.DEFAULT_PROCESS)
    return f"case when {blank('how_to_process')} <> '' then how_to_process {whens} else '' end"


def score_band(c: str) -> str:
    return (f"case when {c} is null then 'none' when {c} = 100 then 'perfect' when {c} >= 90 then 'high' "
            f"when {c} >= 75 then 'medium' else 'low' end")


# RE2 has no lookahead; `(?:\W|$)` answers the same "is there a match" question.
DNU_RE2 = S.DO_NOT_USE_PATTERN.replace(r"(?!\w)", r"(?:\W|$)")


def regex_hit(c: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({c}, {sql_str(pattern)}, 'i'), false)"


def rec_rank(c: str = "recommendation") -> str:
    whens = " ".join(f"when {sql_str(r)} then {i + 1}" for i, r in enumerate(S.RECOMMENDATION_ORDER))
    return f"(case {c} {whens} else {S.UNKNOWN_RANK} end)"


def display_value(cid: str) -> str:
    if cid == "canvas_csz":
        return csz_label("canvas_city", "canvas_state", "canvas_zip")
    if cid == "dec_csz":
        return csz_label("dec_city", "dec_state", "dec_zip")
    if cid == "canvas_id":
        return code_label("canvas_id", "canvas_addrseq")
    if cid == "dec_hdrcode":
        return code_label("dec_hdrcode", "dec_addrsubcode")
    if cid == "how_to_process":
        return effective_process()
    if cid in S.SCORE_COLUMNS:
        return number_text(cid)
    return f"cast({cid} as varchar)"


def quick_filter(text: str) -> str:
    vals = [display_value(cid) for cid, _, v in S.GRID_COLUMNS if v]
    words = text.split()
    return " and ".join(
        "(" + " or ".join(f"coalesce(contains(upper({v}), {sql_str(w.upper())}), false)" for v in vals) + ")"
        for w in words)


M_COLUMNS_TYPES = [
    ("id", "bigint"), ("canvas_id", "text"), ("canvas_addrseq", "text"), ("canvas_ssn", "text"),
    ("canvas_name", "text"), ("canvas_address", "text"), ("canvas_city", "text"), ("canvas_state", "text"),
    ("canvas_zip", "text"), ("dec_hdrcode", "text"), ("dec_addrsubcode", "text"), ("dec_name", "text"),
    ("dec_address", "text"), ("dec_city", "text"), ("dec_state", "text"), ("dec_zip", "text"),
    ("dec_contact", "text"), ("ssn_match", "double"), ("name_score", "double"), ("address_score", "double"),
    ("recommendation", "text"), ("how_to_process", "text"), ("memo", "text"), ("nameaddrscore", "double"),
    ("dec_address_looked_up", "text"), ("run_id", "text"), ("address_reason", "text"), ("jib", "int"),
    ("is_trust", "text"), ("rev", "int"), ("vendor", "int"),
]


def text_form(c: str, t: str) -> str:
    if t == "double":
        return number_text(c)
    if t == "text":
        return c
    return f"cast({c} as varchar)"


def search_any(pattern: str) -> str:
    return "(" + " or ".join(regex_hit(text_form(c, t), pattern) for c, t in M_COLUMNS_TYPES) + ")"


def qualified(cols: list[str], alias: str) -> str:
    return ", ".join(f"{alias}.{c}" for c in cols)


def field_text(field: str, m: str = "m") -> str:
    """Current value of the editable field named by `field`, as text."""
    whens = " ".join(f"when {sql_str(f)} then cast({m}.{f} as varchar)" for f in S.EDITABLE_FIELDS)
    return f"(case {field} {whens} end)"


def change_pivot(src: str, keys: list[str]) -> str:
    """keys -> (v_<field>, e_<field>) for every editable field: value and presence."""
    parts = [f"max(new_value) filter (where field = {sql_str(f)}) as v_{f}, "
             f"coalesce(bool_or(field = {sql_str(f)}), false) as e_{f}" for f in S.EDITABLE_FIELDS]
    k = ", ".join(keys)
    return f"select {k}, {', '.join(parts)} from {src} group by {k}"


def overlay_columns(m: str = "m", p: str = "p") -> str:
    out = []
    for c, _t in M_COLUMNS_TYPES:
        if c in S.EDITABLE_FIELDS:
            v = f"{p}.v_{c}"
            if c in S.FLAG_FIELDS:
                v = f"cast(trunc(coalesce({num(v)}, 0)) as integer)"
            out.append(f"case when coalesce({p}.e_{c}, false) then {v} else {m}.{c} end as {c}")
        else:
            out.append(f"{m}.{c}")
    return ", ".join(out)


# Last value per (id, field) of the edit log.
LAST_EDITS = "select id, field, max(seq) as seq, arg_max(new_value, seq) as new_value from edits group by id, field"

# Parsed id list.
ID_LIST = ("select canvas_id from (select regexp_replace(x, '^\\s+|\\s+$', '', 'g') as canvas_id "
           "from (select unnest(regexp_split_to_array(line, '[\\r\\n,]+')) as x from id_file)) where canvas_id <> ''")


def cells_union(pred_for, cols: list[str], src: str = "m") -> str:
    """Unpivot of the text columns: (id, field, col_pos, value) filtered by a per-value predicate."""
    parts = []
    for c in cols:
        pos = S.FIND_COLUMNS.index(c)
        parts.append(f"select id, {sql_str(c)} as field, {pos} as col_pos, {c} as value from {src} "
                     f"where {pred_for('' + c)}")
    return " union all ".join(parts)


def ci_contains(c: str, needle: str) -> str:
    return f"coalesce(contains(upper({c}), {sql_str(needle.upper())}), false)"


def cs_contains(c: str, needle: str) -> str:
    return f"coalesce(contains({c}, {sql_str(needle)}), false)"


def re2_quote(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def re2_replacement(text: str) -> str:
    return text.replace("\\", "\\\\")
