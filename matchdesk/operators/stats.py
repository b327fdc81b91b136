"""Aggregates of the review (A1-A17). Each is one scan with partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchdesk.functions import exprs as X


def summary(df: DataFrame) -> DataFrame:
    """A1, A3, A4: totals, mean scores (1 decimal, NULLs skipped) and SSN counts in one pass."""
    ssn = F.col("ssn_match")
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.round(F.avg("name_score"), 1).alias("avg_name_score"),
        F.round(F.avg("address_score"), 1).alias("avg_address_score"),
        F.count_if(ssn == 100).alias("ssn_perfect_matches"),
        F.count_if((ssn > 0) & (ssn < 100)).alias("ssn_partial_matches"),
        F.count_if(ssn == 0).alias("ssn_no_match"),
    )


def recommendation_counts(df: DataFrame) -> DataFrame:
    """Rows per recommendation (NULL dropped), share of all
    rows to 1 decimal, and display rank.

    The domain is open, so the groups stay distributed; the total is a one-row
    aggregate of them that is joined to each.
    """
    g = df.groupBy("recommendation").agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    return (g.filter(F.col("recommendation").isNotNull()).crossJoin(F.broadcast(total))
            .select("recommendation", "n",
                    F.round(F.lit(100.0) * F.col("n") / F.col("total"), 1).alias("pct"),
                    X.rec_rank().alias("rank")))


def distinct_recommendations(df: DataFrame) -> DataFrame:
    """A5: sorted distinct recommendations, NULL dropped."""
    return (df.select("recommendation").filter(F.col("recommendation").isNotNull())
            .distinct().orderBy("recommendation"))


def view_counts(df: DataFrame, predicate: Column) -> DataFrame:
    """Total and filtered counts in one pass."""
    return df.agg(F.count(F.lit(1)).alias("records_total"),
                  F.count_if(predicate).alias("records_filtered"))


def domain_order(df: DataFrame) -> DataFrame:
    """Recommendation counts in preferred display order."""
    return recommendation_counts(df).select("rank", "recommendation", "n").orderBy("rank", "recommendation")


def audit_volume(audit: DataFrame) -> DataFrame:
    """Audit rows per field and day."""
    return (audit.groupBy("field_name", F.to_date("updated_at").alias("day"))
            .agg(F.count(F.lit(1)).alias("changes")))
