"""Hard gates of a candidate: identity, scope, price, freshness, leakage, calibration.

All are narrow SQL expressions over the columns ``model``, ``market``,
``portfolio``, ``policy`` (structs) and ``evaluated_at`` (zoned text), so they
also run on a streaming DataFrame. Each job adds code arrays and drops nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright import fixed_values as fixed

EPOCH = "1970-01-01T00:00:00+00:00"


def coded(condition: str, code: str) -> str:
    return f"CASE WHEN {condition} THEN '{code}' END"


def codes(rules: Sequence[str]) -> str:
    """First-seen distinct codes of the rules that fire."""
    return f"array_distinct(array_compact(array({', '.join(rules)})))"


# Timestamps the gates read, each parsed once into a column of this name.
MOMENTS = {
    "_now": "evaluated_at", "_captured": "market.captured_at", "_starts": "market.event_start_at",
    "_book_at": "portfolio.captured_at", "_predicted": "model.prediction_generated_at",
    "_features": "model.feature_cutoff_at", "_trained": "model.training_cutoff_at",
}


def age(now: str, then: str) -> str:
    """Seconds between two timestamp columns."""
    return f"((unix_micros({now}) - unix_micros({then})) / 1e6)"


def with_moments(df: DataFrame, names: Sequence[str] = tuple(MOMENTS)) -> DataFrame:
    """Text without a zone is not a usable moment (NULL): the session's zone must not decide."""
    zoned = lambda text: f"CASE WHEN {text} RLIKE '(Z|[+-][0-9][0-9]:?[0-9][0-9])$' THEN try_to_timestamp({text}) END"
    return df.withColumns({n: F.expr(zoned(MOMENTS[n])) for n in names})


def mismatched_fields() -> str:
    direct = [coded(f"NOT (model.{f} <=> market.{f})", f) for f in fixed.IDENTITY_FIELDS]
    domain = [
        coded(f"NOT (model.validation_domain.{f} <=> market.{f})", f"validation_domain.{f}")
        for f in fixed.DOMAIN_FIELDS
    ]
    return codes(direct + domain)


def identity_codes(mismatch: str = "_mismatch") -> list[str]:
    return [
        coded(f"array_contains({mismatch}, 'event_id')", "EVENT_ID_MISMATCH"),
        coded(f"array_contains({mismatch}, 'market_id')", "MARKET_ID_MISMATCH"),
        coded(f"array_contains({mismatch}, 'selection')", "SELECTION_MISMATCH"),
        coded(f"exists({mismatch}, f -> f NOT IN ('event_id', 'market_id', 'selection'))", "DOMAIN_MISMATCH"),
    ]


def scope_codes() -> list[str]:
    return [
        coded("NOT (portfolio.league <=> market.competition)", "DOMAIN_MISMATCH"),
        coded("NOT (portfolio.correlation_group <=> market.correlation_group)", "DOMAIN_MISMATCH"),
        coded("policy.block_unknown_correlation AND coalesce(market.correlation_group, '') = ''", "UNKNOWN_CORRELATION"),
    ]


def market_state_codes() -> list[str]:
    return [
        coded("NOT (market.market_status <=> 'open')", "MARKET_NOT_OPEN"),
        coded("_starts <= _now", "EVENT_ALREADY_STARTED"),
    ]


SELECTED = "filter(market.outcomes, o -> o.selection = market.selection)"


def price_code(selected: str = "_selected") -> str:
    return (
        f"CASE WHEN NOT coalesce(size({selected}) = 1, false) THEN 'MARKET_INCOMPLETE' "
        f"WHEN abs({selected}[0].decimal_odds - market.decimal_odds) > {fixed.PRICE_TOLERANCE:e} "
        "THEN 'SELECTED_PRICE_MISMATCH' END"
    )


def freshness_codes() -> list[str]:
    rules = []
    for code, moment, limit in (
        ("MARKET_SNAPSHOT_STALE", "_captured", "market_snapshot"),
        ("PORTFOLIO_STATE_STALE", "_book_at", "portfolio_state"),
        ("MODEL_OUTPUT_STALE", "_predicted", "model_output"),
    ):
        rules.append(
            f"CASE WHEN {moment} > _now THEN 'TIMESTAMP_IN_FUTURE' "
            f"WHEN {age('_now', moment)} > policy.freshness_seconds.{limit} THEN '{code}' END"
        )
    return rules


def leakage_codes() -> list[str]:
    return [
        coded("_features > _predicted", "FEATURE_CUTOFF_AFTER_PREDICTION"),
        coded("_trained > _features", "TRAINING_CUTOFF_AFTER_FEATURES"),
    ]


def calibration_codes() -> list[str]:
    return [
        coded(
            "NOT coalesce(array_contains(policy.allowed_calibration_statuses, model.calibration_status), false)",
            "CALIBRATION_STATUS_NOT_ALLOWED",
        ),
        coded("model.calibration_status = 'unknown'", "CALIBRATION_PROVENANCE_UNKNOWN"),
    ]


ECONOMIC_PROBABILITY = (
    "CASE WHEN model.calibration_status = 'validated' THEN model.probability_calibrated ELSE model.probability_raw END"
)


def with_identity(df: DataFrame) -> DataFrame:
    """Add ``mismatched_fields`` and ``identity_codes``."""
    return df.withColumn("mismatched_fields", F.expr(mismatched_fields())).withColumn(
        "identity_codes", F.expr(codes(identity_codes("mismatched_fields")))
    )


def with_gate(df: DataFrame, out: str, rules: Sequence[str]) -> DataFrame:
    """Add one gate's code array; parsed timestamps and ``_selected`` are supplied when used."""
    used = [n for n in MOMENTS if any(n in r for r in rules)]
    staged = with_moments(df, used) if used else df
    if any("_selected" in r for r in rules):
        staged = staged.withColumn("_selected", F.expr(SELECTED))
    return staged.withColumn(out, F.expr(codes(rules))).drop("_selected", *used)


def quality_gate(df: DataFrame, *, max_price_age: int = fixed.DEFAULT_MAX_PRICE_AGE_SECONDS) -> DataFrame:
    """Mechanical candidate gate over ``event``, ``market`` (nested shape), ``model`` and ``now`` text.

    Adds ``errors`` and ``status`` (VALID / BLOCKED); zone-less timestamps count as UTC.
    Without an event the ``status`` beside it, if there is one, is the event's.
    """
    own, beside = "event" in df.columns, "status" in df.columns
    state = "if(event IS NULL, status, event.status)" if own and beside else "event.status" if own else "status" if beside else "NULL"
    utc = lambda text: f"try_to_timestamp(if({text} RLIKE '(Z|[+-][0-9][0-9]:?[0-9][0-9])$', {text}, concat({text}, 'Z')))"
    seconds = f"((unix_micros({utc('now')}) - unix_micros({utc('market.snapshot_at')})) / 1e6)"
    rules = [
        coded(f"NOT ({state} <=> 'scheduled')", "event_not_scheduled"),
        "CASE WHEN _age IS NULL THEN 'invalid_or_missing_price_timestamp' "
        f"WHEN _age < {fixed.FUTURE_PRICE_ALLOWANCE_SECONDS} THEN 'price_timestamp_in_future' "
        f"WHEN _age > {max_price_age} THEN concat('stale_price:', CAST(_age AS BIGINT), 's') END",
        coded("coalesce(size(market.outcomes), 0) < 2", "incomplete_outcome_set"),
        coded("exists(market.outcomes, o -> coalesce(o.odds_decimal, 0) <= 1)", "invalid_outcome_odds"),
        coded(
            "NOT coalesce(model.probability_calibrated > 0 AND model.probability_calibrated < 1, false)",
            "invalid_model_probability",
        ),
        coded("NOT (model.selection <=> market.selection)", "model_selection_mismatch"),
    ]
    return (
        df.withColumn("_age", F.expr(seconds))
        .withColumn("errors", F.expr(f"array_compact(array({', '.join(rules)}))"))
        .withColumn("status", F.expr("if(size(errors) > 0, 'BLOCKED', 'VALID')"))
        .drop("_age")
    )
