"""Settled-bet performance, closing-line value, drawdown and turnover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions import pricing, stats
from linewright.functions.ordered import attach, ordered_scan
from linewright.session import cut_lineage

SETTLED = ["WIN", "LOSS"]


def _sums() -> dict[str, Column]:
    """What a summary is made of: sums and counts that add up over parts."""
    y = F.when(F.col("result") == "WIN", 1.0).otherwise(0.0)
    p = F.when((F.col("p") > 0) & (F.col("p") < 1), F.col("p"))
    taken, closing = F.col("odds_taken").try_cast("double"), F.col("closing_odds").try_cast("double")
    clv = F.try_divide(taken, closing) - 1.0
    return {
        "_n": F.count(F.lit(1)), "_stake": F.sum("stake"), "_profit": F.sum("profit"),
        "_brier": F.sum(stats.brier_term(p, y)), "_loss": F.sum(stats.log_loss_term(p, y)), "_judged": F.count(p),
        "_clv": F.sum(clv), "_closed": F.count(clv),
    }


def _measures() -> list[Column]:
    stake, profit = F.col("_stake").cast("double"), F.col("_profit").cast("double")
    return [
        F.col("_n").alias("bets"), stake.alias("stake"), profit.alias("profit"), F.try_divide(profit, stake).alias("roi"),
        F.try_divide("_brier", F.col("_judged")).alias("brier"), F.try_divide("_loss", F.col("_judged")).alias("log_loss"),
        F.try_divide("_clv", F.col("_closed")).alias("avg_price_clv"),
    ]


def settled(bets: DataFrame) -> DataFrame:
    return bets.where(F.col("result").isin(SETTLED))


def settled_summary(bets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bets, stake, profit, ROI, Brier, log loss and price CLV; only WIN and LOSS count.

    Log loss leaves out probabilities outside (0, 1); CLV leaves out odds that
    do not parse or divide.
    """
    return settled(bets).groupBy(*by).agg(*[e.alias(n) for n, e in _sums().items()]).select(*by, *_measures())


def with_buckets(bets: DataFrame) -> DataFrame:
    """Probability decile, price range and time-to-start bucket of each bet."""
    odds, lead = F.col("odds_taken"), F.col("lead_seconds")
    return bets.withColumns({
        "probability_bucket": stats.calibration_bin(F.col("p")),
        "price_range": F.when(odds < 1.5, "short").when(odds < 2.5, "middle").when(odds < 4.0, "long").otherwise("outsider"),
        "time_to_start": F.when(lead < 0, "in_play").when(lead < 86_400, "same_day").when(lead < 604_800, "same_week").otherwise("early"),
    })


def segmented(bets: DataFrame, dimensions: Sequence[str], *, minimum_sample: int) -> DataFrame:
    """The summary by each dimension on its own, with small-sample and version-mixing flags.

    Each bet contributes once per dimension and is summed map-side per (dimension,
    value, model version); the versions of a segment are then the rows of that
    small table, which sums up to the segment.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("segment")) for d in dimensions
    ]))
    sums = _sums()
    per_version = (
        settled(bets).withColumn("_pair", pairs)
        .groupBy(F.col("_pair.dimension").alias("dimension"), F.col("_pair.segment").alias("segment"), "model_version")
        .agg(*[e.alias(n) for n, e in sums.items()])
    )
    return (
        per_version.groupBy("dimension", "segment")
        .agg(*[F.sum(n).alias(n) for n in sums], F.count(F.lit(1)).alias("_versions"))
        .select(
            "dimension", "segment", *_measures(), (F.col("_n") < minimum_sample).alias("small_sample"),
            (F.col("_versions") > 1).alias("mixed_versions"),
        )
    )


def bankroll_return(bets: DataFrame, starting: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Net profit over the starting bankroll (not over turnover)."""
    profit = settled(bets).groupBy(*keys).agg(F.sum("profit").cast("double").alias("net_profit"))
    return attach(profit, starting, keys).withColumn(
        "bankroll_return", F.try_divide("net_profit", F.col("starting_bankroll"))
    )


def clv_report(bets: DataFrame, closing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Closing prices joined on, decision-time columns left as they are, all four CLV conventions."""
    taken, close = F.col("odds_taken"), F.col("closing_odds")
    return attach(bets, closing, keys).withColumns({
        "raw_clv_pp": pricing.raw_clv(taken, close),
        "price_clv": pricing.price_clv(taken, close),
        "no_vig_clv_pp": pricing.no_vig_clv(F.col("entry_no_vig"), F.col("closing_no_vig")),
        "probability_clv": pricing.probability_clv(F.col("closing_no_vig"), taken),
    })


def drawdown_path(
    bets: DataFrame, keys: Sequence[str], order: Sequence[str], *, starting: str, block_rows: int | None = None
) -> DataFrame:
    """Bankroll, running peak and drawdown after every settled bet.

    ``starting`` is the opening bankroll column, one value per key. The peak includes
    the opening value. Running sum and running peak come from one scan.
    """
    path = ordered_scan(settled(bets), keys, order, sums={"_pnl": F.col("profit")}, peaks={"_peak": "_pnl"}, block_rows=block_rows)
    path = path.withColumns({
        "bankroll": F.col(starting) + F.col("_pnl"), "running_peak": F.greatest(F.col(starting) + F.col("_peak"), F.col(starting)),
    }).drop("_pnl", "_peak")
    return path.withColumn(
        "drawdown", F.try_divide((F.col("running_peak") - F.col("bankroll")).cast("double"), F.col("running_peak").cast("double"))
    )


def maximum_drawdown(
    bets: DataFrame, keys: Sequence[str], order: Sequence[str], *, starting: str, block_rows: int | None = None
) -> DataFrame:
    path = drawdown_path(bets, keys, order, starting=starting, block_rows=block_rows)
    # The opening point itself has drawdown zero.
    return path.groupBy(*keys).agg(
        F.greatest(F.max("drawdown"), F.lit(0.0)).alias("maximum_drawdown"), F.count(F.lit(1)).alias("n_bets")
    )


def rolling_turnover(
    bets: DataFrame, keys: Sequence[str], time: str, amount: str, *, days: int = 3, block_rows: int | None = None
) -> DataFrame:
    """Turnover of the trailing ``days`` (both ends included) at every distinct time.

    Stakes are first summed per instant. A trailing sum is the running sum at t
    minus the running sum before t - days; the second is read by a probe row
    placed there, so no window has to hold a whole portfolio. ``amount`` must be
    decimal, which makes the difference exact.
    """
    span = F.expr(f"INTERVAL '{days}' DAY")
    instants = cut_lineage(bets.groupBy(*keys, F.col(time).alias("_t")).agg(F.sum(amount).alias("_amount")))
    kinds = F.explode(F.array(
        F.struct(F.lit(1).alias("kind"), F.col("_t").alias("at"), F.col("_amount").alias("value")),
        F.struct(F.lit(0).alias("kind"), (F.col("_t") - span).alias("at"), (F.col("_amount") * 0).alias("value")),
    ))
    rows = instants.select(*keys, "_t", kinds.alias("_r")).select(*keys, "_t", "_r.*")
    # A probe sorts before the stakes of its own instant: it excludes them.
    running = ordered_scan(rows, keys, ["at", "kind", "_t"], sums={"_run": F.col("value")}, block_rows=block_rows)
    both = running.groupBy(*keys, "_t").agg(
        F.sum(F.when(F.col("kind") == 1, F.col("_run"))).alias("_upto"),
        F.sum(F.when(F.col("kind") == 0, F.col("_run"))).alias("_before"),
    )
    return both.select(*keys, F.col("_t").alias(time), (F.col("_upto") - F.col("_before")).alias("rolling_turnover"))
