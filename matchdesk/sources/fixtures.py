"""Representative review inputs derived from the driver's Parquet tables.

The match table, id list, master table, edit log and undo/redo action log
are derived with DataFrame expressions from the TPC-H-style tables
(lineitem, orders, customer, supplier, nation, region, events), so every input grows with the
scale factor. The derivations follow FIXTURES.md statement for statement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchdesk.operators.joins import lookup
from matchdesk.sources.tables import read_table, row_count


def _s(col) -> F.Column:
    return col.cast("string")


def _lpad_mod(col, mul: int, mod: int, width: int) -> F.Column:
    return F.lpad(_s((col * F.lit(mul)) % F.lit(mod)), width, "0")


def nation_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations (25 rows) with the name of their region (5 rows): fixed-size tables."""
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")


def supplier_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier with its nation and region names."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    places = F.broadcast(nation_places(spark, sf_dir))
    return s.join(places, s.s_nationkey == places.n_nationkey).drop("n_nationkey")


def raw_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw match table: 29 columns, scores and flags as text on purpose.

    One row per order line: the order's customer against the line's supplier (of lines that
    repeat a number, the smallest), so rows grow with the orders. All joins are on keys. Rows are clustered
    by recommendation and id within partitions, sorted before they get their 29 columns.
    """
    lines = (read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber")
             .agg(F.min("l_suppkey").alias("l_suppkey")))
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    places = nation_places(spark, sf_dir)
    cust = (cust.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
            .withColumnsRenamed({"n_name": "c_city", "r_name": "c_state"}).drop("n_nationkey"))
    pairs = (lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
             .join(cust, F.col("c_custkey") == F.col("o_custkey"))
             .join(supplier_places(spark, sf_dir), F.col("s_suppkey") == F.col("l_suppkey")))
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    cs = c + s
    name_score = (c * 37 + s * 11) % 101
    addr_score = (c * 53 + s * 29) % 101
    seg = F.lower("c_mktsegment")
    ident = F.col("l_orderkey").cast("bigint") * 8 + F.col("l_linenumber")
    recommendation = (F.when((c * 3 + s) % 7 == 0, F.lit("NEW BA AND NEW ADDRESS"))
                      .when((c * 3 + s) % 7 == 1, F.lit("EXISTING BA ADD NEW ADDRESS"))
                      .when((c * 3 + s) % 7 == 2, F.lit("EXISTING BA AND EXISTING ADDRESS"))
                      .when((c * 3 + s) % 7 == 3, F.lit("NEEDS REVIEW"))
                      .when((c * 3 + s) % 7 == 4, F.lit("NEEDS REVIEW"))
                      .when((c * 3 + s) % 7 == 5, F.lit("PROCESSED")))
    return pairs.sortWithinPartitions(recommendation, ident).select(
        ident.alias("id"),
        _s(c).alias("canvas_id"),
        F.when(c % 3 == 0, _s(c % 7)).otherwise(F.lit("")).alias("canvas_addrseq"),
        _lpad_mod(c, 7919, 1000000000, 9).alias("canvas_ssn"),
        F.when(c % 17 == 0, F.concat("c_name", F.lit(" DO NOT USE")))
         .when(c % 19 == 0, F.concat("c_name", F.lit(" Family Trust")))
         .otherwise(F.col("c_name")).alias("canvas_name"),
        F.concat(_s(c % 999), F.lit(" "), seg, F.lit(" St.")).alias("canvas_address"),
        F.col("c_city").alias("canvas_city"),
        F.col("c_state").alias("canvas_state"),
        _lpad_mod(c, 31, 100000, 5).alias("canvas_zip"),
        _s(s).alias("dec_hdrcode"),
        F.when(s % 4 == 0, F.lit("")).otherwise(_s(s % 5)).alias("dec_addrsubcode"),
        F.when(s % 13 == 0, F.concat("s_name", F.lit(" D.N.U."))).otherwise(F.col("s_name")).alias("dec_name"),
        F.concat(_s(s % 99), F.lit(" Main St")).alias("dec_address"),
        F.col("n_name").alias("dec_city"),
        F.col("r_name").alias("dec_state"),
        _lpad_mod(s, 37, 100000, 5).alias("dec_zip"),
        F.concat(F.lit("contact "), _s(s)).alias("dec_contact"),
        F.when((c * 31 + s) % 11 == 0, F.lit(None).cast("string"))
         .when(cs % 5 == 0, F.lit("100"))
         .when((cs % 5).isin(1, 2), F.lit("0"))
         .when(cs % 41 == 3, F.lit("n/a"))
         .otherwise(_s((c * 7 + s) % 101)).alias("ssn_match"),
        F.when(cs % 23 == 0, F.lit(None).cast("string")).otherwise(_s(name_score)).alias("name_score"),
        F.when(cs % 29 == 0, F.lit(None).cast("string")).otherwise(_s(addr_score)).alias("address_score"),
        recommendation.alias("recommendation"),
        F.when(cs % 9 == 0, F.lit("Manual Review - DNP")).otherwise(F.lit("")).alias("how_to_process"),
        F.when(cs % 6 == 0, F.concat(F.lit("call A.B "), seg, F.lit(" a.b axb $1")))
         .when(cs % 6 == 1, F.lit(None).cast("string"))
         .otherwise(F.lit("")).alias("memo"),
        _s(name_score + addr_score).alias("nameaddrscore"),
        F.when(cs % 3 == 0, F.lit("1")).when(cs % 3 == 1, F.lit("0")).alias("dec_address_looked_up"),
        F.concat(F.lit("run-"), _s(c % 4)).alias("run_id"),
        F.when(cs % 8 == 0, F.lit("suite differs")).otherwise(F.lit("")).alias("address_reason"),
        F.when(cs % 5 == 0, F.lit("1")).when(cs % 5 == 1, F.lit("0")).when(cs % 5 == 2, F.lit(None).cast("string"))
         .when(cs % 5 == 3, F.lit("abc")).otherwise(F.lit("1.7")).alias("jib"),
        F.when((c + 2 * s) % 6 == 0, F.lit("1")).when((c + 2 * s) % 6 == 1, F.lit("true"))
         .when((c + 2 * s) % 6 == 2, F.lit("True")).when((c + 2 * s) % 6 == 3, F.lit("0"))
         .when((c + 2 * s) % 6 == 4, F.lit(None).cast("string")).otherwise(F.lit("TRUE")).alias("is_trust"),
    )


def bucket_config(spark: SparkSession) -> DataFrame:
    """BA_CONFIG rows (category, config_key, config_value): 13 key/value rows.

    This is configuration, not data: the values below are the fixture's.
    """
    rows = [
        ("BUCKETS", "NEW_BA_NEW_ADDR_MIN_NAME_SCORE", "0"),
        ("BUCKETS", "NEW_BA_NEW_ADDR_MAX_NAME_SCORE", "60"),
        ("BUCKETS", "NEW_BA_NEW_ADDR_MIN_ADDR_SCORE", "0"),
        ("BUCKETS", "NEW_BA_NEW_ADDR_MAX_ADDR_SCORE", "60"),
        ("BUCKETS", "EXISTING_BA_NEW_ADDR_MIN_NAME_SCORE", "60"),
        ("BUCKETS", "EXISTING_BA_NEW_ADDR_MAX_NAME_SCORE", ""),
        ("BUCKETS", "EXISTING_BA_NEW_ADDR_MIN_ADDR_SCORE", ""),
        ("BUCKETS", "EXISTING_BA_NEW_ADDR_MAX_ADDR_SCORE", "60"),
        ("BUCKETS", "EXISTING_BA_EXISTING_ADDR_MIN_NAME_SCORE", "60"),
        ("BUCKETS", "EXISTING_BA_EXISTING_ADDR_MAX_NAME_SCORE", "100"),
        ("BUCKETS", "EXISTING_BA_EXISTING_ADDR_MIN_ADDR_SCORE", "60"),
        ("BUCKETS", "EXISTING_BA_EXISTING_ADDR_MAX_ADDR_SCORE", "100"),
        ("OTHER", "IGNORED", "1"),
    ]
    return spark.createDataFrame(rows, "category string, config_key string, config_value string")


def id_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an uploaded id file: padded ids, comma lists, an empty line."""
    cust = read_table(spark, sf_dir, "customer").select("c_custkey")
    c = F.col("c_custkey")
    padded = cust.filter(c % 10 == 0).select(F.concat(F.lit(" "), _s(c), F.lit(" ")).alias("line"))
    listed = cust.filter(c % 50 == 5).select(
        F.concat(_s(c), F.lit(","), _s(c + 1), F.lit(",,")).alias("line"))
    blank = spark.createDataFrame([("",)], "line string")
    return padded.unionByName(listed).unionByName(blank)


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in the alternate (master) layout."""
    sup = supplier_places(spark, sf_dir)
    s = F.col("s_suppkey")
    return sup.select(
        s.alias("id"), _s(s).alias("hdrcode"), _lpad_mod(s, 7919, 1000000000, 9).alias("ssn"),
        F.col("s_name").alias("hdrname"), F.col("n_name").alias("addrcity"),
        F.col("r_name").alias("addrstate"))


def edits(spark: SparkSession, sf_dir: str, matches: DataFrame) -> DataFrame:
    """Edit log (seq, id, field, new_value, edited_at) from the event stream.

    Each event edits the first row of customer ``event_id % n_customers``.
    The customer count is a scalar taken from Parquet footers.
    """
    n_cust = row_count(read_table(spark, sf_dir, "customer").select("c_custkey"))
    ev = read_table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    first_row = matches.groupBy("canvas_id").agg(F.min("id").alias("id"))
    et = F.col("event_type")
    e = F.col("event_id")
    joined = ev.join(first_row, first_row.canvas_id == _s(e % F.lit(n_cust)))
    return joined.select(
        e.alias("seq"), F.col("id"),
        F.when(et == "click", "memo").when(et == "view", "canvas_name")
         .when(et == "purchase", "recommendation").when(et == "signup", "jib")
         .otherwise("how_to_process").alias("field"),
        F.when(et == "click", F.concat(F.lit("m"), _s(e)))
         .when(et == "view", F.concat(F.lit("N "), _s(e % 10)))
         .when(et == "purchase", F.lit("APPROVED"))
         .when(et == "signup", _s(e % 2))
         .otherwise(F.lit("Merge BA and address")).alias("new_value"),
        F.col("ts").cast("timestamp_ntz").alias("edited_at"),
    )


def proposed_edits(edit_log: DataFrame) -> DataFrame:
    """The edit log with the faults that users send: a field that may not be
    edited, ids of no row, flags that are no integers, and missing values."""
    seq, flag = F.col("seq"), F.col("field") == "jib"
    bad = (F.when(flag & (seq % 7 == 0), "abc").when(flag & (seq % 7 == 1), "1.7").when(flag & (seq % 7 == 2), "")
           .when(flag & (seq % 7 == 3), " 1 ").when(seq % 17 == 0, F.lit(None).cast("string"))
           .otherwise(F.col("new_value")))
    return edit_log.select(
        "seq", F.when(seq % 13 == 0, -F.col("id")).otherwise(F.col("id")).alias("id"),
        F.when(seq % 11 == 0, "dec_name").otherwise(F.col("field")).alias("field"),
        bad.alias("new_value"), "edited_at")


def keyed_changes(edit_log: DataFrame, matches: DataFrame) -> DataFrame:
    """Changes by business key, as a save holds them, some with keys of no row: without an
    SSN, or with an id that the table does not have."""
    keys = matches.select("id", "canvas_id", "canvas_ssn")
    seq = F.col("seq")
    return lookup(edit_log, keys, "id").select(
        "seq", "id", F.when(seq % 17 == 0, F.concat("canvas_id", F.lit("x"))).otherwise(F.col("canvas_id")).alias("canvas_id"),
        F.when(seq % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("canvas_ssn")).alias("canvas_ssn"), "field", "new_value")


MASTER_HEADER = "ID,HDRCODE,SSN,HDRNAME,ADDRCONTACT,ADDRADDRESS,ADDRCITY,ADDRSTATE,ADDRZIPCODE,ADDRSUBCODE,NAME_SCORE"


def master_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a master table as CSV, some of them damaged: a field too many or too few, an id
    that is no number, scores that are none."""
    s = F.col("s_suppkey")
    ident = F.when(s % 11 == 3, F.concat(F.lit("no"), _s(s))).otherwise(_s(s))
    score = F.when(s % 3 == 0, F.lit("n/a")).otherwise(_s(s % 101))
    whole = F.concat_ws(
        ",", ident, F.concat(F.lit("H"), _s(s)), _lpad_mod(s, 7919, 1000000000, 9), F.col("s_name"),
        F.concat(F.lit("contact "), _s(s)), F.concat(_s(s % 99), F.lit(" Main St")), F.col("n_name"), F.col("r_name"),
        _lpad_mod(s, 37, 100000, 5), _s(s % 5), score)
    line = F.when(s % 7 == 1, F.concat(whole, F.lit(",surplus"))).when(s % 7 == 2, F.concat(_s(s), F.lit(",cut"))).otherwise(whole)
    return supplier_places(spark, sf_dir).select(line.alias("line"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undo/redo action log (session, seq, op, action_id) from the event stream."""
    et = F.col("event_type")
    return read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"),
        F.when(et == "error", "undo").when(et == "signup", "redo").otherwise("do").alias("op"),
        F.when(et.isin("error", "signup"), F.lit(None).cast("bigint"))
         .otherwise(F.col("event_id")).alias("action_id"))


def selection(edit_log: DataFrame) -> DataFrame:
    """Row ids a reviewer selected: rows with a status edit and their neighbours.

    Odd-sequence edits point one past the edited row, which may not exist --
    the stale-selection case of bulk actions.
    """
    return (edit_log.filter(F.col("field") == "recommendation")
            .select((F.col("id") + F.col("seq") % 2).alias("id")).distinct())
