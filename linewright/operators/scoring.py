"""Line probabilities from a residual sample and exact-line scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright import fixed_values as fixed
from linewright.functions import pricing, stats
from linewright.functions.ordered import attach, ordered_scan, small_side


def line_probability(
    predictions: DataFrame, residuals: DataFrame, keys: Sequence[str], row_id: str, *, point: str = "prediction",
    line: str = "line", residual: str = "residual", tolerance: float = fixed.PUSH_TOLERANCE, block_rows: int | None = None,
) -> DataFrame:
    """Over / under / push shares of the residual sample of a prediction's key.

    Residuals and two probes per prediction are put in one order and a running
    count of residuals is read off at the probes: n log n, no pairs. ``row_id``
    is unique within the keys. Adds over, under, push, raw (conditional over),
    residual_n and threshold; raw is NULL when every residual pushes.
    """
    keys = list(keys)
    threshold = F.col(line) - F.col(point)
    probes = F.explode(F.array(
        F.struct(F.lit(0).alias("_kind"), (threshold - tolerance).alias("_v")),
        F.struct(F.lit(2).alias("_kind"), (threshold + tolerance).alias("_v")),
    ))
    asked = predictions.select(*keys, F.col(row_id).alias("_id"), probes.alias("_p")).select(*keys, "_id", "_p.*")
    sample = residuals.select(
        *keys, F.lit(None).cast(predictions.schema[row_id].dataType).alias("_id"), F.lit(1).alias("_kind"), F.col(residual).alias("_v")
    )
    is_residual = F.when(F.col("_kind") == 1, 1).otherwise(0)
    ranked = ordered_scan(asked.unionByName(sample), keys, ["_v", "_kind", "_id"], sums={"_count": is_residual}, block_rows=block_rows)
    counts = ranked.where(F.col("_kind") != 1).groupBy(*keys, F.col("_id").alias(row_id)).agg(
        F.max(F.when(F.col("_kind") == 0, F.col("_count"))).alias("_under"),
        F.max(F.when(F.col("_kind") == 2, F.col("_count"))).alias("_upto"),
    )
    sizes = residuals.groupBy(*keys).agg(F.count(F.lit(1)).alias("residual_n"))
    n, under = F.col("residual_n"), F.col("_under")
    over = n - F.col("_upto")
    joined = attach(attach(predictions, counts, [*keys, row_id]), sizes, keys)
    return joined.where(n >= 2).withColumns({
        "threshold": threshold, "over": over / n, "under": under / n, "push": (n - over - under) / n,
        "raw": F.when(over + under > 0, over / (over + under)),
    }).drop("_under", "_upto")


def exact_line_scores(
    priced: DataFrame, calibrators: DataFrame, keys: Sequence[str], *, selection: str = "selection",
    odds: str = "odds", opposing_odds: str = "opposing_odds",
) -> DataFrame:
    """Calibrated probabilities of the selected and the opposing side of an over/under line.

    ``priced`` comes from ``line_probability``; ``calibrators`` has one intercept
    and coefficient per key. The push mass is set aside, the conditional over is
    calibrated, and the push mass attached again. Adds edge and push-aware EV.
    """
    side = F.lower(F.trim(F.col(selection)))
    is_over = side == "over"
    known = attach(priced, small_side(calibrators.select(*keys, "intercept", "coefficient")), keys).where(side.isin("over", "under"))
    conditional = stats.platt(F.col("raw"), F.col("intercept"), F.col("coefficient"))
    staged = known.withColumn("_conditional", conditional).withColumn("_live", 1.0 - F.col("push"))
    staged = staged.withColumns({
        "_over": F.col("_live") * F.col("_conditional"),
        "_under_p": F.col("_live") * (1.0 - F.col("_conditional")),
    })
    staged = staged.withColumns({
        "selected_raw": F.when(is_over, F.col("over")).otherwise(F.col("under")),
        "selected_calibrated": F.when(is_over, F.col("_over")).otherwise(F.col("_under_p")),
        "opposing_calibrated": F.when(is_over, F.col("_under_p")).otherwise(F.col("_over")),
        "market_no_vig": pricing.binary_no_vig(F.col(odds), F.col(opposing_odds)),
    })
    return staged.withColumns({
        "edge_probability_points": F.col("selected_calibrated") - F.col("market_no_vig"),
        "expected_value_with_push": pricing.expected_value_with_push(F.col("selected_calibrated"), F.col(odds), F.col("push")),
    }).drop("_conditional", "_live", "_over", "_under_p")
