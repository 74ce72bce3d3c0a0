"""Latest snapshot per key and reconciliation of sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright import fixed_values as fixed
from linewright.functions.ordered import attach, latest_per_key


def latest_snapshot(
    df: DataFrame, keys: Sequence[str], time: str, *, evaluated_at: Column, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """Newest row per key that was already known at ``evaluated_at``."""
    usable = df.where(F.col(time) <= evaluated_at)
    return latest_per_key(usable, keys, [F.col(time), *map(F.col, tiebreak)])


def authority(source: Column, priority: Sequence[str] = fixed.SOURCE_PRIORITY) -> Column:
    """1 = strongest; unknown sources rank last."""
    rank = F.lit(len(priority) + 1)
    for place in range(len(priority), 0, -1):
        rank = F.when(source == priority[place - 1], F.lit(place)).otherwise(rank)
    return rank


def reconcile(
    quotes: DataFrame, keys: Sequence[str], *, value: str, source: str, time: str, tiebreak: str
) -> tuple[DataFrame, DataFrame]:
    """Chosen value per key (strongest source, then newest) and the conflicts kept beside it.

    The second frame has one row per (key, value, source) of every key whose
    sources disagree: conflicts stay rows, so a key may have any number of them.
    """
    ranked = quotes.withColumn("_rank", -authority(F.col(source)))
    claims = ranked.groupBy(*keys, value, source).agg(
        F.max(F.struct("_rank", time, tiebreak)).alias("_best"), F.count(F.lit(1)).alias("n_reports")
    )
    per_value = claims.groupBy(*keys, value).agg(F.max("_best").alias("_best"), F.sum("n_reports").alias("_n"))
    chosen = per_value.groupBy(*keys).agg(
        F.max_by(value, "_best").alias("chosen_value"),
        F.max("_best").alias("_best"),
        F.count(F.lit(1)).alias("n_values"),
        F.sum("_n").alias("n_reports"),
    ).withColumn("conflict", F.col("n_values") > 1)
    chosen = chosen.withColumn("source_rank", -F.col("_best._rank")).withColumn("chosen_id", F.col("_best")[tiebreak]).drop("_best")
    conflicts = attach(
        claims.select(*keys, value, source, "n_reports", F.col("_best")[time].alias("last_reported")),
        chosen.select(*keys, "conflict"), keys,
    ).where("conflict").drop("conflict")
    return chosen, conflicts
