"""Declared schemas, column registry and the value domains of match review.

Everything here is metadata: names, types, labels and fixed domain values.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the reviewed application's values for the
# results to agree; they are stated here together, in their natural order.
# ---------------------------------------------------------------------------

# Columns shipped to the review grid, in the application's order.
SHIPPED_COLUMNS = [
    "id", "ssn_match", "name_score", "address_score", "nameaddrscore", "recommendation",
    "how_to_process", "canvas_id", "canvas_addrseq", "canvas_name",
    "canvas_address", "canvas_city", "canvas_state", "canvas_zip", "canvas_ssn",
    "dec_name", "dec_address", "dec_city", "dec_state", "dec_zip",
    "dec_hdrcode", "dec_addrsubcode", "dec_contact", "dec_address_looked_up",
    "address_reason", "jib", "rev", "vendor", "memo", "is_trust", "run_id",
    "name_normal_detail", "address_normal_detail", "name_match_detail", "addr_match_detail",
]

# Fields a reviewer may edit.
EDITABLE_FIELDS = [
    "recommendation", "canvas_name", "canvas_address",
    "canvas_city", "canvas_state", "canvas_zip", "address_reason",
    "jib", "rev", "vendor", "how_to_process", "memo",
]

# Fields that a record-form save writes, all at once.
FORM_FIELDS = [
    "canvas_name", "canvas_address", "canvas_city", "canvas_state", "canvas_zip",
    "recommendation", "address_reason", "memo",
]

# 0/1 flag fields.
FLAG_FIELDS = ["jib", "rev", "vendor"]

# Columns searched by find / replace, in the application's column order.
FIND_COLUMNS = [
    "canvas_name", "canvas_address", "canvas_city", "canvas_state", "canvas_zip",
    "recommendation", "how_to_process", "memo", "address_reason",
]

# Columns the page may be sorted by.
SORTABLE_COLUMNS = [
    "id", "ssn_match", "name_score", "address_score", "recommendation",
    "canvas_name", "canvas_address", "canvas_city", "canvas_id",
    "dec_name", "dec_address", "dec_city", "dec_hdrcode", "dec_address_looked_up",
    "jib", "rev", "vendor", "how_to_process", "memo",
]

# Preferred display order of recommendations (unknown values rank 999).
RECOMMENDATION_ORDER = [
    "NEW BA AND NEW ADDRESS",
    "EXISTING BA ADD NEW ADDRESS",
    "EXISTING BA AND EXISTING ADDRESS",
    "NEEDS REVIEW",
    "PROCESSED",
]
UNKNOWN_RANK = 999

# Value approval writes into `recommendation`.
APPROVED = "APPROVED"

# Options of the process editor.
PROCESS_OPTIONS = [
    "Add new BA and address", "Add address to existing BA",
    "Merge BA and address", "Manual Review - DNP",
]

# Default process derived from the upper-cased recommendation.
DEFAULT_PROCESS = [
    ("NEW BA AND NEW ADDRESS", "Add new BA and address"),
    ("EXISTING BA ADD NEW ADDRESS", "Add address to existing BA"),
    ("EXISTING BA AND EXISTING ADDRESS", "Merge BA and address"),
]

# "Do not use" marker pattern, case-insensitive. Spark's (Java) regex engine
# supports the negative lookahead as written.
DO_NOT_USE_PATTERN = r"do\s*n[o']?t\s*use|don['’]t\s*use|d\.?n\.?u\.?(?!\w)"

# Values of is_trust that mean true.
TRUST_TRUE_VALUES = ["1", "true", "True"]

# Score bands: 100 perfect, >= 90 high, >= 75 medium, else low; NULL none.
BAND_PERFECT, BAND_HIGH, BAND_MEDIUM = 100, 90, 75

# Hint thresholds.
LOW_NAME_SCORE = 45
ADDRESS_HINT_SCORE = 45

# Undo depth per session.
UNDO_MAX = 50

# Default page length and default audit read.
DEFAULT_PAGE_LENGTH = 25
DEFAULT_AUDIT_LIMIT = 100

# Score bucket configuration: key prefix -> recommendation.
BUCKET_PREFIXES = [
    ("NEW_BA_NEW_ADDR", "NEW BA AND NEW ADDRESS"),
    ("EXISTING_BA_NEW_ADDR", "EXISTING BA ADD NEW ADDRESS"),
    ("EXISTING_BA_EXISTING_ADDR", "EXISTING BA AND EXISTING ADDRESS"),
]
BUCKET_CATEGORY = "BUCKETS"
# Key suffix -> pivoted bound column.
BUCKET_BOUNDS = [
    ("MIN_NAME_SCORE", "min_name"),
    ("MAX_NAME_SCORE", "max_name"),
    ("MIN_ADDR_SCORE", "min_addr"),
    ("MAX_ADDR_SCORE", "max_addr"),
]

# Alternate (master) layout: source column -> review column.
MASTER_RENAMES = [
    ("hdrcode", "dec_hdrcode"),
    ("ssn", "canvas_ssn"),
    ("hdrname", "dec_name"),
    ("addrcontact", "dec_contact"),
    ("addraddress", "dec_address"),
    ("addrcity", "dec_city"),
    ("addrstate", "dec_state"),
    ("addrzipcode", "dec_zip"),
    ("addrsubcode", "dec_addrsubcode"),
]
MASTER_TEXT_DEFAULTS = ["canvas_id", "canvas_name", "canvas_address",
                        "canvas_city", "canvas_state", "canvas_zip"]
MASTER_SCORE_DEFAULTS = ["ssn_match", "name_score", "address_score"]
MASTER_EXTRA_TEXT_DEFAULTS = ["recommendation", "address_reason"]

# Columns schema evolution guarantees on the stored table, with defaults.
EVOLVED_COLUMNS = [("jib", 0), ("rev", 0), ("vendor", 0), ("memo", ""), ("how_to_process", "")]

# Numeric score columns (text coerced to double, bad text -> NULL).
SCORE_COLUMNS = ["ssn_match", "name_score", "address_score", "nameaddrscore"]

# Grid columns: (column id, header label, visible by default). Derived
# columns (canvas_csz, dec_csz) and value getters are defined in
# functions.exprs.DISPLAY_VALUE.
GRID_COLUMNS = [
    ("id", "UID", False),
    ("ssn_match", "SSN", True),
    ("name_score", "Name", True),
    ("address_score", "Addr", True),
    ("nameaddrscore", "N+A", False),
    ("recommendation", "Status", True),
    ("how_to_process", "Process", True),
    ("canvas_name", "Canvas Name", True),
    ("canvas_address", "Canvas Addr", True),
    ("canvas_csz", "Canvas City/St/Zip", True),
    ("canvas_id", "Canvas ID", False),
    ("dec_name", "DEC Name", True),
    ("dec_address", "DEC Addr", True),
    ("dec_csz", "DEC City/St/Zip", True),
    ("dec_hdrcode", "DEC Code", False),
    ("dec_address_looked_up", "Address Lookup", False),
    ("jib", "JIB", False),
    ("rev", "Rev", False),
    ("vendor", "Vendor", False),
    ("memo", "Memo", False),
    ("run_id", "Run ID", False),
    ("name_normal_detail", "Name Normal", False),
    ("address_normal_detail", "Addr Normal", False),
    ("name_match_detail", "Name Match", False),
    ("addr_match_detail", "Addr Match", False),
]

# ---------------------------------------------------------------------------
# Declared Spark types
# ---------------------------------------------------------------------------

TEXT_COLUMNS = [
    "canvas_id", "canvas_addrseq", "canvas_name", "canvas_address", "canvas_city",
    "canvas_state", "canvas_zip", "canvas_ssn",
    "dec_name", "dec_address", "dec_city", "dec_state", "dec_zip", "dec_hdrcode",
    "dec_addrsubcode", "dec_contact",
    "recommendation", "how_to_process", "address_reason", "memo",
    "dec_address_looked_up", "is_trust", "run_id",
    "name_normal_detail", "address_normal_detail", "name_match_detail", "addr_match_detail",
]


def column_type(name: str) -> T.DataType:
    """Spark type of a normalized match column."""
    if name == "id":
        return T.LongType()
    if name in SCORE_COLUMNS:
        return T.DoubleType()
    if name in FLAG_FIELDS:
        return T.IntegerType()
    return T.StringType()


AUDIT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("canvas_id", T.StringType(), True),
    T.StructField("canvas_ssn", T.StringType(), True),
    T.StructField("field_name", T.StringType(), True),
    T.StructField("old_value", T.StringType(), True),
    T.StructField("new_value", T.StringType(), True),
    T.StructField("updated_at", T.TimestampNTZType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

# Edit log: one row per field change, ordered by `seq`.
EDITS_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("id", T.LongType(), False),
    T.StructField("field", T.StringType(), False),
    T.StructField("new_value", T.StringType(), True),
    T.StructField("edited_at", T.TimestampNTZType(), True),
])

# Compacted pending change: first old, last new per (row, field).
PENDING_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("field", T.StringType(), False),
    T.StructField("old_value", T.StringType(), True),
    T.StructField("new_value", T.StringType(), True),
])
