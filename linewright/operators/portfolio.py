"""Exposure amounts of portfolios from their positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.functions.ordered import attach
from linewright.session import cut_lineage


def exposure_rollup(positions: DataFrame, *, as_of: str, amount: str = "stake", time: str = "decision_at") -> DataFrame:
    """Open, daily, league, rolling three-day and correlation-group amounts.

    One row per (portfolio, league, correlation group), as the portfolio contract
    wants it. ``as_of`` is a timestamp literal; later positions are not counted.
    All three levels come from one pre-aggregated table, written once, so the
    positions are read and shuffled once.
    """
    now = F.lit(as_of).cast("timestamp")
    moment, value = F.col(time).cast("timestamp"), F.col(amount)
    is_open = F.col("result") == "OPEN"
    known = positions.where(moment <= now)
    base = known.groupBy("portfolio_id", "competition", "correlation_group").agg(
        F.sum(F.when(is_open, value).otherwise(value * 0)).alias("_open"),
        F.sum(F.when(F.to_date(moment) == F.to_date(now), value).otherwise(value * 0)).alias("_daily"),
        F.sum(F.when(moment >= now - F.expr("INTERVAL '3' DAY"), value).otherwise(value * 0)).alias("_rolling"),
        F.sum(F.when(is_open, 1).otherwise(0)).alias("_positions"),
    )
    base = cut_lineage(base)
    book = base.groupBy("portfolio_id").agg(
        F.sum("_open").alias("open_amount"), F.sum("_daily").alias("daily_turnover_amount"),
        F.sum("_rolling").alias("rolling_3d_turnover_amount"), F.sum("_positions").alias("open_positions_count"),
    )
    league = base.groupBy("portfolio_id", "competition").agg(F.sum("_open").alias("league_amount"))
    rows = base.select("portfolio_id", "competition", "correlation_group", F.col("_open").alias("correlation_group_amount"))
    return attach(attach(rows, book, ["portfolio_id"]), league, ["portfolio_id", "competition"])
