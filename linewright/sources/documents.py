"""JSON documents and projections between the two market shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, *, whole_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents as VARIANT with their file, and the rejects.

    One object per line, or per file with ``whole_files``. Text that is not JSON
    or not an object is rejected with a reason; blank lines are skipped.
    """
    text = spark.read.text(path, wholetext=whole_files).withColumn("file", F.col("_metadata.file_path"))
    text = text.where(F.trim("value") != "")
    parsed = text.withColumn("document", F.try_parse_json("value"))
    shape = F.substring(F.schema_of_variant("document"), 1, 6)
    reason = F.when(F.col("document").isNull(), "invalid_json").when(shape != "OBJECT", "top-level JSON value must be an object")
    judged = parsed.withColumn("rejection", reason)
    good = judged.where(F.col("rejection").isNull()).select("file", "document")
    return good, judged.where(F.col("rejection").isNotNull()).select("file", "value", "rejection")


def flatten_snapshots(nested: DataFrame, *, target_market: str, settlement_rules: str, namespace: str) -> DataFrame:
    """Nested snapshots (event, market) as flat ``market`` rows of the decision core.

    The nested shape names neither the target market nor the settlement rules,
    so the caller does. A scheduled event's market counts as open.
    """
    line = F.struct(
        F.when(F.col("market.line").isNull(), "null").otherwise("number").alias("kind"), F.col("market.line").alias("num"),
        F.lit(None).cast("string").alias("str"),
    )
    outcomes = F.transform("market.outcomes", lambda o: F.struct(o["selection"].alias("selection"), o["odds_decimal"].alias("decimal_odds")))
    flat = F.struct(
        F.lit(f"{namespace}.market-snapshot.v1").alias("schema_version"), F.col("event.event_id"), F.col("market.market_id"),
        F.col("market.book"), F.col("market.snapshot_at").alias("captured_at"), F.col("event.event_start_at"), F.col("event.sport"),
        F.col("event.competition"), F.col("market.market_type"), F.lit(target_market).alias("target_market"), F.col("market.period"),
        line.alias("line"), F.lit(settlement_rules).alias("settlement_rules"), F.col("market.selection"),
        F.col("market.odds_decimal").alias("decimal_odds"),
        F.when(F.col("event.status") == "scheduled", "open").otherwise("closed").alias("market_status"),
        (F.size("market.outcomes") >= 2).alias("is_complete"), outcomes.alias("outcomes"),
        F.lit(None).cast("string").alias("correlation_group"), F.col("event.source").alias("source"),
    )
    return nested.select(flat.alias("market"))
