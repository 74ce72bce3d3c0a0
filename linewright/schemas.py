"""Row types of the documents. ``line`` may be a number, text or null, so it is
held as (kind, num, str), which compares null-safely field by field."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, NUM, INT, BOOL = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()


def _of(kind: T.DataType, *names: str) -> dict[str, T.DataType]:
    return dict.fromkeys(names, kind)


def _row(fields: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


LINE = _row({"kind": TEXT, "num": NUM, "str": TEXT})
_DOMAIN = {
    **_of(TEXT, "sport", "competition", "market_type", "target_market", "period"),
    "line": LINE, "settlement_rules": TEXT,
}
MODEL_OUTPUT = _row({
    **_of(TEXT, "schema_version", "event_id", "market_id", "model_name", "model_version"),
    **_DOMAIN, "selection": TEXT, **_of(NUM, "probability_raw", "probability_calibrated"),
    **_of(TEXT, "calibration_status", "calibration_method", "prediction_generated_at",
          "feature_cutoff_at", "training_cutoff_at", "feature_schema_version"),
    "validation_domain": _row(_DOMAIN), "validation_window": TEXT, "validation_sample_size": INT,
    **_of(NUM, "brier_score", "log_loss", "expected_calibration_error"),
    **_of(TEXT, "training_data_version", "model_artifact_sha256", "calibration_artifact_sha256", "notes"),
})
MARKET_SNAPSHOT = _row({
    **_of(TEXT, "schema_version", "event_id", "market_id", "book", "book_market_id", "captured_at",
          "event_start_at"),
    **_DOMAIN, "selection": TEXT, "decimal_odds": NUM, "market_status": TEXT, "is_complete": BOOL,
    "outcomes": T.ArrayType(_row({"selection": TEXT, "decimal_odds": NUM})),
    **_of(TEXT, "correlation_group", "source", "source_url"),
})
PORTFOLIO_STATE = _row({
    **_of(TEXT, "schema_version", "portfolio_id", "captured_at", "currency"),
    **_of(NUM, "bankroll", "available_balance", "stake_increment"),
    **_of(TEXT, "league", "correlation_group"), "drawdown_fraction": NUM, "open_positions_count": INT,
    "exposures": _row(_of(NUM, "open_amount", "daily_turnover_amount", "league_amount",
                          "rolling_3d_turnover_amount", "correlation_group_amount")),
})
_TIERS = _row(_of(NUM, "validated", "uncalibrated", "unknown"))
RISK_POLICY = _row({
    **_of(TEXT, "schema_version", "policy_id", "policy_version"),
    **_of(NUM, "minimum_ev", "minimum_edge_probability_points", "minimum_stake"),
    "allowed_calibration_statuses": T.ArrayType(TEXT), "kelly_fraction": _TIERS, "sizing_model_weight": _TIERS,
    "caps": _row(_of(NUM, "max_stake_fraction_per_bet", "max_open_exposure_fraction",
                     "max_daily_turnover_fraction", "max_league_exposure_fraction",
                     "max_rolling_3d_turnover_fraction", "max_correlation_group_fraction")),
    "freshness_seconds": _row(_of(INT, "market_snapshot", "portfolio_state", "model_output", "mlb_context")),
    "drawdown": _row(_of(NUM, "warning_fraction", "review_fraction", "pause_fraction")),
    **_of(BOOL, "human_approval_required", "block_unknown_correlation"),
})
_STARTER = _row(_of(TEXT, "name", "status"))
_SIDES = _row(_of(TEXT, "home", "away"))
MLB_CONTEXT = _row({
    **_of(TEXT, "schema_version", "event_id", "captured_at"),
    "settlement": _row({"pitcher_rule": TEXT, "listed_pitchers_match": BOOL}),
    "starters": _row({"home": _STARTER, "away": _STARTER}), "lineups": _SIDES, "bullpen": _SIDES,
    "environment": _row(_of(BOOL, "roof_matches_model", "weather_matches_model", "umpire_matches_model")),
    "model_dependencies": _row(_of(BOOL, "requires_confirmed_starters", "requires_lineup_compatibility",
                                   "requires_bullpen_state", "uses_roof", "uses_weather", "uses_umpire")),
})
HUMAN_REVIEW = _row({
    **_of(TEXT, "review_id", "packet_sha256", "prediction_id", "model_version", "reviewed_at",
          "system_decision", "human_decision"),
    "model_probability_changed": BOOL, **_of(NUM, "proposed_stake", "approved_stake"),
    **_of(TEXT, "reason", "notes"),
})
NESTED_SNAPSHOT = _row({
    "event_id": TEXT,
    "event": _row({**_of(TEXT, "event_id", "sport", "competition", "event_start_at", "status"),
                   "participants": T.ArrayType(TEXT), **_of(TEXT, "venue", "source", "retrieved_at")}),
    "market": _row({**_of(TEXT, "market_id", "book", "market_type", "period"), "line": NUM,
                    "selection": TEXT, "odds_decimal": NUM, "snapshot_at": TEXT,
                    "outcomes": T.ArrayType(_row({"selection": TEXT, "odds_decimal": NUM}))}),
})
RICH_PREDICTION = _row({
    **_of(TEXT, "output_schema_version", "event_id", "sport"),
    "market": _row({**_of(TEXT, "market_type", "period", "selection"), "line": NUM, "book": TEXT,
                    **_of(NUM, "odds_decimal", "opposing_odds_decimal", "no_vig_probability"),
                    "snapshot_at": TEXT}),
    "model": _row({**_of(TEXT, "model_name", "model_version", "model_artifact_sha256",
                         "feature_schema_version"), "point_estimate": NUM,
                   **_of(TEXT, "prediction_generated_at", "feature_cutoff_at", "training_cutoff_at")}),
    "distribution": _row({**_of(TEXT, "method", "residual_distribution_version", "residual_artifact_sha256"),
                          "residual_sample_size": INT,
                          **_of(NUM, "threshold_residual", "probability_over_raw", "probability_under_raw",
                                "probability_push_raw", "probability_over_conditional_non_push_raw")}),
    "calibration": _row({**_of(TEXT, "method", "status", "calibration_version", "calibration_artifact_sha256"),
                         "training_sample_size": INT,
                         **_of(NUM, "probability_selected_raw", "probability_selected_calibrated",
                               "probability_opposing_calibrated", "probability_push")}),
    "validation": _row({"sample_size": INT,
                        **_of(NUM, "model_brier_score", "market_brier_score", "brier_skill_score",
                              "model_log_loss", "market_log_loss", "model_ece", "market_ece"),
                        **_of(TEXT, "method", "validation_period_start", "validation_period_end")}),
    "decision_inputs": _row(_of(NUM, "edge_probability_points", "expected_value_with_push")),
})
