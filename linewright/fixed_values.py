"""These must equal the published contracts for results to agree.

Enumerations, thresholds, required-field lists and codes, in their natural
order. Nothing here is tuned.
"""

# --- contract identity -------------------------------------------------------
# The namespace prefixes every schema_version ("<namespace>.model-output.v1").
# Callers holding documents under another namespace pass it explicitly.
NAMESPACE = "linewright"

# --- enumerations --------------------------------------------------------------
SPORTS = ["MLB", "KBO", "NPB", "TENNIS", "SOCCER", "NBA", "WNBA", "NFL"]
CALIBRATION_STATUSES = ["validated", "uncalibrated", "unknown"]
CALIBRATION_METHODS = ["sigmoid", "isotonic", "beta", "none", "other"]
MARKET_STATUSES = ["open", "suspended", "closed"]
DECISIONS = ["BET", "WATCH", "PASS", "BLOCKED"]
HUMAN_DECISIONS = ["approved", "rejected", "watch", "refresh_required"]
PITCHER_RULES = ["action", "listed"]
STARTER_STATUSES = ["confirmed", "projected", "changed", "unknown"]
LINEUP_STATUSES = ["confirmed_compatible", "projected_compatible", "material_change", "unknown"]
BULLPEN_STATUSES = ["current", "stale", "unknown"]
FIRST_FIVE_PERIODS = ["f5", "first_five", "first_5", "first-five"]
CONTEXT_STATUSES = ["VALID", "WATCH", "BLOCKED", "NOT_APPLICABLE"]

# --- identity ------------------------------------------------------------------
DOMAIN_FIELDS = [
    "sport", "competition", "market_type", "target_market", "period", "line", "settlement_rules",
]
IDENTITY_FIELDS = [
    "event_id", "market_id", "sport", "competition", "market_type",
    "target_market", "period", "line", "settlement_rules", "selection",
]

# --- reason codes --------------------------------------------------------------
REASON_CODES = [
    "INPUT_SCHEMA_INVALID", "EVENT_ID_MISMATCH", "MARKET_ID_MISMATCH", "DOMAIN_MISMATCH",
    "SELECTION_MISMATCH", "SELECTED_PRICE_MISMATCH", "MARKET_NOT_OPEN", "MARKET_INCOMPLETE",
    "MARKET_SNAPSHOT_STALE", "PORTFOLIO_STATE_STALE", "MODEL_OUTPUT_STALE", "TIMESTAMP_IN_FUTURE",
    "FEATURE_CUTOFF_AFTER_PREDICTION", "TRAINING_CUTOFF_AFTER_FEATURES",
    "CALIBRATION_STATUS_NOT_ALLOWED", "CALIBRATION_PROVENANCE_UNKNOWN", "EV_BELOW_MINIMUM",
    "EDGE_BELOW_MINIMUM", "PRICE_BELOW_MINIMUM", "NO_RISK_CAPACITY", "STAKE_BELOW_MINIMUM",
    "DRAWDOWN_PAUSE", "MLB_CONTEXT_MISSING", "MLB_CONTEXT_STALE", "MLB_CONTEXT_EVENT_MISMATCH",
    "MLB_STARTER_CHANGED", "MLB_STARTER_UNCONFIRMED", "MLB_LINEUP_CHANGED",
    "MLB_LINEUP_UNCONFIRMED", "MLB_BULLPEN_UNAVAILABLE", "MLB_ENVIRONMENT_MISMATCH",
    "MLB_ENVIRONMENT_UNCONFIRMED", "MLB_LISTED_PITCHER_MISMATCH", "EVENT_ALREADY_STARTED",
    "UNKNOWN_CORRELATION", "DRAWDOWN_REVIEW", "DRAWDOWN_WARNING", "QUALIFIED",
]

# --- numeric constants ---------------------------------------------------------
PROBABILITY_CLIP = 1e-6
PUSH_TOLERANCE = 1e-12
PRICE_TOLERANCE = 1e-12
FUTURE_PRICE_ALLOWANCE_SECONDS = -5
DEFAULT_MAX_PRICE_AGE_SECONDS = 300
PLATT_INVERSE_PENALTY = 1e6
OUTPUT_DECIMALS = 12
# Interior edges of ten equal bins exactly as evenly spaced doubles come out.
ECE_EDGES = [
    0.1, 0.2, 0.30000000000000004, 0.4, 0.5,
    0.6000000000000001, 0.7000000000000001, 0.8, 0.9,
]
BOOSTED_TREES = {
    "maxIter": 300, "stepSize": 0.03, "maxDepth": 4, "minInstancesPerNode": 5,
    "subsamplingRate": 0.85, "featureSubsetStrategy": "0.85", "seed": 42,
}
WALK_FORWARD_DEFAULTS = {
    "test_size": 1, "min_residual_history": 100, "min_calibration_history": 200,
    "minimum_validation_sample": 200,
}

# --- stake caps, in the order that breaks ties ---------------------------------
CAP_ORDER = [
    "kelly", "per_bet", "open", "daily", "league", "rolling_3d", "correlation", "available_balance",
]
LEGACY_CAP_ORDER = ["per_bet", "open", "daily", "league", "rolling"]

# --- source columns ------------------------------------------------------------
MARKET_CSV_REQUIRED = [
    "event_id", "sport", "competition", "event_start_at", "status", "participant_1",
    "participant_2", "source", "retrieved_at", "market_id", "book", "market_type", "period",
    "line", "selection", "odds_decimal", "snapshot_at", "outcome_1_selection",
    "outcome_1_odds_decimal", "outcome_2_selection", "outcome_2_odds_decimal",
]
BET_LOG_COLUMNS = [
    "bet_id", "event_id", "decision_at", "event_start_at", "sport", "competition", "market_id",
    "market_type", "period", "selection", "line", "book", "odds_taken_decimal", "stake_eur",
    "units", "bankroll_before_eur", "model_name", "model_version", "model_probability",
    "sizing_probability", "market_no_vig_probability", "break_even_probability", "expected_ev",
    "edge_vs_market_pp", "data_quality_status", "candidate_tier", "kelly_full",
    "kelly_fraction_used", "price_threshold", "correlation_group", "closing_odds_decimal",
    "closing_market_no_vig_probability", "result", "profit_loss_eur", "notes",
]
SNAPSHOT_EVENT_REQUIRED = [
    "event_id", "sport", "competition", "event_start_at", "status", "participants",
]
SNAPSHOT_MARKET_REQUIRED = [
    "market_id", "book", "market_type", "period", "selection", "odds_decimal", "snapshot_at",
    "outcomes",
]
SNAPSHOT_MODEL_REQUIRED = [
    "model_name", "model_version", "target_market", "selection", "probability_calibrated",
    "prediction_generated_at",
]
PACKET_EVENT_REQUIRED = [
    "event_id", "sport", "competition", "event_start_at", "status", "participants", "source",
    "retrieved_at",
]
PACKET_MARKET_REQUIRED = [
    "market_id", "book", "market_type", "period", "line", "selection", "odds_decimal",
    "snapshot_at", "outcomes",
]

# --- source authority, strongest first -----------------------------------------
SOURCE_PRIORITY = ["official", "licensed_feed", "statistical_provider", "verified_reporter", "aggregator"]

# --- audit checklist -----------------------------------------------------------
AUDIT_ITEMS = [
    "forced_action", "recency", "result_chasing", "favorite_or_underdog_identity",
    "price_anchoring", "confirmation", "public_fade", "sharp_money_story", "double_counting",
    "outcome_bias",
]
AUDIT_ANSWERS = ["CLEAR", "FLAG", "NOT APPLICABLE"]
