"""History to calibrated, evaluated and hashed probability artifacts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.functions.ordered import attach
from linewright.operators import artifacts, calibration, history, metrics
from linewright.session import cut_lineage


#: Why a version cannot be fitted, in the order of the checks.
FAULTS = {
    "training.unusable": "values that no fit can use",
    "chronology.not_increasing": "a time that is not after the one before",
    "history.no_test_rows": "no rows after the first training window",
    "history.too_few_priced": "too few priced rows for the calibration history",
    "calibration.one_class": "one class only in every calibration history",
}


@dataclass(frozen=True)
class FittedHistory:
    """Everything one fit leaves behind; each table has one row per model version unless noted."""

    predictions: DataFrame  # one per row: out-of-sample prediction or NULL
    residuals: DataFrame  # (model_version, pos, residual)
    residual_versions: DataFrame
    calibrators: DataFrame
    evaluated: DataFrame  # one per evaluated row: calibrated and market probability
    report: DataFrame  # fault, scorecard, status, window bounds, training cutoff
    models: dict[str, object] | None = None


def fit_history(
    df: DataFrame, features: Sequence[str], config: history.WalkForward, *, key: str = "model_version",
    order: Sequence[str] = ("ts",), time: str = "ts", estimator: Estimator | None = None, block_rows: int = 200_000,
    strict: bool = True, parallel: int = 4,
) -> FittedHistory:
    """Walk forward, price by earlier residuals, calibrate walk-forward, score against the market.

    Without ``estimator`` the least-squares baseline is fitted for all versions
    at once. With one, every fold of every version is an MLlib fit, and ``model`` holds the final
    one of each version by name. A version is faulty (``report.fault``, a code of ``FAULTS``) when its values are
    unusable, its times do not strictly increase, or its history is too short for
    its settings or its calibration. ``strict`` ends the job on the first faulty
    version; else such versions are rows of the report and of no other table.
    """
    group = [key]
    rows = cut_lineage(history.with_position(df, group, order))
    versions = rows.groupBy(key).agg(F.max(time).alias("training_cutoff_at"), F.count(F.lit(1)).alias("training_rows"))
    found = None

    def note(bad: DataFrame, fault: str) -> None:
        """Add the versions of ``bad`` to the faulty ones, or stop on one."""
        nonlocal found
        bad = cut_lineage(bad.select(key).distinct().withColumn("fault", F.lit(fault)))
        if strict and not bad.isEmpty():
            raise ValueError(f"{fault} ({FAULTS[fault]}): {bad.first()[key]}")
        found = bad if found is None else found.unionByName(bad)

    def sound(table: DataFrame) -> DataFrame:
        return attach(table, found.select(key).distinct().withColumn("_faulty", F.lit(True)), group).where("_faulty IS NULL").drop("_faulty")

    note(history.training_faults(rows, group, features, time=time).where(~F.col("usable")), "training.unusable")
    note(history.chronology_breaks(sound(rows), group, [history.POSITION], time), "chronology.not_increasing")
    note(sound(versions).where(F.col("training_rows") <= config.min_train_size), "history.no_test_rows")
    rows = cut_lineage(sound(rows))
    if estimator is None:
        predictions = cut_lineage(history.walk_forward_linear(rows, group, features, config))
    else:
        predictions = cut_lineage(history.walk_forward_estimators(rows, group, features, config, estimator, parallel=parallel))
    priced = cut_lineage(history.priced_history(predictions, group, config, block_rows=block_rows))
    counted = attach(sound(versions), priced.groupBy(key).agg(F.count("raw").alias("_priced")), group)
    note(counted.where(F.coalesce("_priced", F.lit(0)) <= config.min_calibration_history), "history.too_few_priced")
    priced = sound(priced)
    evaluated = cut_lineage(calibration.walk_forward_platt(
        priced, group, [history.POSITION], minimum_history=config.min_calibration_history
    ))
    scored = attach(sound(versions), evaluated.select(key).distinct().withColumn("_scored", F.lit(True)), group)
    note(scored.where("_scored IS NULL"), "calibration.one_class")
    priced, evaluated = sound(priced), sound(evaluated)
    residuals = sound(predictions).where(F.col("prediction").isNotNull()).select(
        key, history.POSITION, (F.col("y") - F.col("prediction")).alias("residual")
    )
    hashed = artifacts.artifact_hash(residuals, key, history.POSITION, "residual", method="empirical")
    residual_versions = hashed.withColumn(
        "residual_distribution_version", F.concat(F.col(key), F.lit("-residuals-"), F.substring("artifact_sha256", 1, 12))
    )
    fits = calibration.platt_fit(priced, group)
    calibrators = artifacts.versioned(
        fits.withColumn("method", F.lit("platt")), [key, "method", "intercept", "coefficient", "training_sample_size", "positive_rate"], key, "platt"
    )
    card = metrics.calibration_status(
        metrics.scorecard(evaluated, "calibrated", "market_p", "outcome", group), config.minimum_validation_sample
    )
    bounds = evaluated.groupBy(key).agg(F.min(time).alias("validation_period_start"), F.max(time).alias("validation_period_end"))
    report = attach(attach(attach(versions, found, group), card, group), bounds, group)
    models = None if estimator is None else history.final_models(sound(rows), key, features, estimator, parallel=parallel)
    return FittedHistory(sound(predictions), residuals, residual_versions, calibrators, evaluated, report, models)


def bundle_tables(fitted: FittedHistory) -> dict[str, DataFrame]:
    return {
        "residuals": fitted.residuals, "residual_versions": fitted.residual_versions,
        "calibrators": fitted.calibrators, "validation_report": fitted.report,
    }
