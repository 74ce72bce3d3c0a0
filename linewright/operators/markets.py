"""No-vig boards over exploded markets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.functions import pricing


def market_totals(outcomes: DataFrame, keys: Sequence[str], odds: str = "decimal_odds") -> DataFrame:
    """One row per market: outcome count, implied sum, overround; invalid prices void the market."""
    implied = pricing.implied_probability(F.col(odds))
    return (
        outcomes.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_outcomes"), F.count(implied).alias("_usable"), F.sum(implied).alias("market_sum"))
        .where((F.col("n_outcomes") >= 2) & (F.col("_usable") == F.col("n_outcomes")))
        .drop("_usable")
        .withColumn("overround", F.col("market_sum") - 1.0)
    )


def no_vig_board(outcomes: DataFrame, keys: Sequence[str], odds: str = "decimal_odds") -> DataFrame:
    """Every outcome of a complete market with its implied and no-vig probability.

    The sums are aggregated map-side and joined back, so a market with very many
    quotes never has to fit one task; the join is split by the adaptive planner
    when a key is hot and broadcast by it when the totals turn out small.
    """
    # Plain equality: a row without a market id belongs to no market, and the
    # totals keep the partitioning of their aggregation.
    return (
        outcomes.join(market_totals(outcomes, keys, odds), list(keys))
        .withColumn("raw_implied", 1.0 / F.col(odds))
        .withColumn("no_vig_probability", F.col("raw_implied") / F.col("market_sum"))
    )


def overround_by(outcomes: DataFrame, market: Sequence[str], by: str) -> DataFrame:
    """Average market sum and overround per ``by`` over its markets (``market`` includes ``by``)."""
    return (
        market_totals(outcomes, market)
        .groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("n_markets"),
            F.avg("market_sum").alias("avg_market_sum"),
            F.avg("overround").alias("avg_overround"),
        )
    )


def edge_board(df: DataFrame, *, minimum_ev: float, minimum_edge: float) -> DataFrame:
    """Economics of (p, odds, market_p) rows with the QUALIFIES / WATCH_PRICE / PASS status."""
    p, d, m = F.col("p"), F.col("odds"), F.col("market_p")
    target, need = F.lit(minimum_ev), F.lit(minimum_edge)
    return df.withColumns({
        "break_even_probability": pricing.implied_probability(d),
        "ev": pricing.expected_value(p, d),
        "edge_vs_break_even_pp": pricing.edge(p, F.try_divide(F.lit(1.0), d)),
        "edge_vs_market_pp": pricing.edge(p, m),
        "full_kelly": pricing.full_kelly(p, d),
        "break_even_odds": F.try_divide(F.lit(1.0), p),
        "minimum_qualifying_odds": pricing.minimum_odds(p, target),
        "economic_status": pricing.economic_status(p, d, m, target, need),
    })
