"""Scoring rules, calibration error and the model-vs-market scorecard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.functions import stats


def reliability(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Per bin: rows, mean probability, observed rate."""
    return (
        df.withColumn("bin", stats.calibration_bin(F.col(p)))
        .groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("observed_rate"))
    )


def calibration_error(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    gap = F.abs(F.col("mean_p") - F.col("observed_rate"))
    return reliability(df, p, y, by).groupBy(*by).agg(
        (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.sum("n").alias("n")
    )


def scoring_rules(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    pc, yc = F.col(p), F.col(y)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(stats.brier_term(pc, yc)).alias("brier"),
        F.avg(stats.clipped_log_loss_term(pc, yc)).alias("log_loss"),
    )


def scorecard(df: DataFrame, p: str, market_p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Brier, log loss and ECE of model and market, with the Brier skill score.

    One aggregation with map-side sums: a bin's weight times |mean p - mean y| is
    |sum (p - y)| / N, so each bin is one conditional sum.
    """
    m, k, yc = F.col(p), F.col(market_p), F.col(y)
    binned = df.withColumns({"_bm": stats.calibration_bin(m), "_bk": stats.calibration_bin(k)})
    bins = range(len(stats.ECE_EDGES) + 1)
    gap = lambda bin_col, value, i: F.sum(F.when(F.col(bin_col) == i, value - yc).otherwise(0.0))
    sums = {
        "_n": F.count(F.lit(1)),
        "_mb": F.sum(stats.brier_term(m, yc)), "_kb": F.sum(stats.brier_term(k, yc)),
        "_ml": F.sum(stats.clipped_log_loss_term(m, yc)), "_kl": F.sum(stats.clipped_log_loss_term(k, yc)),
        **{f"_mg{i}": gap("_bm", m, i) for i in bins}, **{f"_kg{i}": gap("_bk", k, i) for i in bins},
    }
    totals = binned.groupBy(*by).agg(*[e.alias(name) for name, e in sums.items()])
    n = F.col("_n")
    error = lambda tag: sum((F.abs(F.col(f"_{tag}g{i}")) for i in bins), F.lit(0.0)) / n
    return totals.select(
        *by, n.alias("sample_size"),
        (F.col("_mb") / n).alias("model_brier_score"), (F.col("_kb") / n).alias("market_brier_score"),
        F.when(F.col("_kb") > 0, 1.0 - F.col("_mb") / F.col("_kb")).otherwise(F.lit(float("nan"))).alias("brier_skill_score"),
        (F.col("_ml") / n).alias("model_log_loss"), (F.col("_kl") / n).alias("market_log_loss"),
        error("m").alias("model_ece"), error("k").alias("market_ece"),
    )


def calibration_status(card: DataFrame, minimum_sample: int) -> DataFrame:
    """provisional below the sample minimum; validated if both losses beat the market; else degraded."""
    beats = (F.col("model_brier_score") < F.col("market_brier_score")) & (F.col("model_log_loss") < F.col("market_log_loss"))
    return card.withColumn(
        "calibration_status",
        F.when(F.col("sample_size") < minimum_sample, "provisional").when(beats, "validated").otherwise("degraded"),
    )
