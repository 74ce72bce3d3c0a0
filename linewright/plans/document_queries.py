"""Contract checks over JSON documents, adapters, review packets."""

from pyspark.sql import functions as F

from linewright.functions.canonical import content_addressed
from linewright.operators import adapters, artifacts, contracts, gates, review
from linewright.plans import views as v
from linewright.plans.registry import over, query

MODEL_JSON = v.struct_sql(v.MODEL | {"line": "model_line", "validation_domain": v.MODEL["validation_domain"] | {"line": "model_line"}})
MARKET_JSON = v.struct_sql(v.MARKET | {"line": "line"})


def _codes(*cases: str) -> str:
    return "concat_ws(',', " + ", ".join(cases) + ")"


def _case(test: str, code: str) -> str:
    return f"CASE WHEN {test} THEN '{code}' END"


def documents(df, sql: str, out: str, *keep: str):
    """Rows as parsed JSON; null fields are absent keys."""
    return df.select(*keep, F.expr(f"try_parse_json(to_json({sql}))").alias(out))


def error_codes(column: str = "errors"):
    return F.array_join(F.transform(column, lambda e: e["code"]), ",").alias("codes")


def flat(spark, sf_dir):
    return v.view(spark, sf_dir, v.candidates(v.SPARK), spread="orders")


_MODEL_CODES = [
    _case("probability_calibrated IS NULL", "schema.$.required"), _case("brier_score IS NULL", "schema.$.required"),
    _case("candidate_id % 47 = 0", "schema.prediction_generated_at.format"),
    _case("candidate_id % 41 = 0", "schema.probability_raw.exclusiveMaximum"),
    _case("candidate_id % 43 = 0", "schema.settlement_rules.minLength"),
    _case("candidate_id % 43 = 0", "schema.validation_domain.settlement_rules.minLength"),
]
_VERDICT_CODES = [*_MODEL_CODES, _case("domain_competition <> competition", "domain_mismatch.competition"), _case("calibration_status = 'unknown'", "calibration_status.unknown")]


@query("contract_errors", over({"c": v.candidates}, f"SELECT candidate_id, {_codes(*_MODEL_CODES)} AS codes FROM c"))
def contract_errors(spark, sf_dir):
    docs = documents(flat(spark, sf_dir), MODEL_JSON, "document", "candidate_id")
    return contracts.contract_errors(docs, "document", contracts.model_output).select("candidate_id", error_codes())


@query("model_verdict", over({"c": v.candidates}, f"""
    SELECT candidate_id, codes, CASE WHEN codes <> '' THEN 'BLOCKED' WHEN calibration_status = 'validated' THEN 'VALIDATED' ELSE 'UNCALIBRATED' END AS decision,
      codes = '' AS valid, domain_competition = competition AS domain_match FROM (SELECT *, {_codes(*_VERDICT_CODES)} AS codes FROM c) t"""))
def model_verdict(spark, sf_dir):
    docs = documents(flat(spark, sf_dir), MODEL_JSON, "document", "candidate_id")
    rows = contracts.model_verdict(docs, "document")
    return rows.select("candidate_id", error_codes(), "decision", "valid", "domain_match")


@query("market_contract_errors", over({"c": v.candidates}, f"""SELECT candidate_id, {_codes(
    _case("candidate_id % 14 = 0", "schema.decimal_odds.exclusiveMinimum"), _case("candidate_id % 17 = 0", "schema.is_complete.const"),
    _case("candidate_id % 22 = 0 AND sport <> 'SOCCER'", "schema.outcomes.1.decimal_odds.exclusiveMinimum"),
    _case("candidate_id % 43 = 0", "schema.settlement_rules.minLength"))} AS codes FROM c"""))
def market_contract_errors(spark, sf_dir):
    away = "named_struct('selection', second_selection, 'decimal_odds', odds_away))),"
    short = away.replace("odds_away", "if(candidate_id % 22 = 0, 0.9D, odds_away)")
    sql = (
        MARKET_JSON.replace("'is_complete', true", "'is_complete', candidate_id % 17 <> 0")
        .replace("'decimal_odds', decimal_odds", "'decimal_odds', if(candidate_id % 14 = 0, 1D, decimal_odds)")
        .replace(away, short)
    )
    docs = documents(flat(spark, sf_dir), sql, "document", "candidate_id")
    return contracts.contract_errors(docs, "document", contracts.market_snapshot).select("candidate_id", error_codes())


@query("portfolio_contract_errors", over({"p": v.portfolios}, f"""SELECT portfolio_id, correlation_key, captured_at, {_codes(
    _case("open_positions_count % 7 = 0", "schema.currency.pattern"), _case("open_positions_count % 5 = 0", "schema.drawdown_fraction.maximum"),
    _case("open_positions_count % 11 = 0", "schema.exposures.open_amount.minimum"),
    _case("open_positions_count % 6 = 0", "schema.stake_increment.exclusiveMinimum"))} AS codes FROM p"""))
def portfolio_contract_errors(spark, sf_dir):
    faulty = lambda every, wrong, column: v.num(f"if(open_positions_count % {every} = 0, {wrong}, {column})")
    sql = v.struct_sql(v.PORTFOLIO | {
        "currency": "if(open_positions_count % 7 = 0, 'eur', 'EUR')", "drawdown_fraction": faulty(5, "1.5D", "drawdown_fraction"),
        "stake_increment": faulty(6, "0D", "stake_increment"), "exposures": v.PORTFOLIO["exposures"] | {"open_amount": faulty(11, "-1D", "open_amount")},
    })
    docs = documents(v.view(spark, sf_dir, v.portfolios(v.SPARK)), sql, "document", "portfolio_id", "correlation_key", "captured_at")
    rows = contracts.contract_errors(docs, "document", contracts.portfolio_state)
    return rows.select("portfolio_id", "correlation_key", "captured_at", error_codes())


@query("context_contract_errors", over({"x": v.contexts}, f"""SELECT k, {_codes(
    _case("true", "schema.environment.required"), _case("roof IS NULL", "schema.environment.required"), _case("weather IS NULL", "schema.environment.required"),
    _case("k % 9 = 0", "schema.lineups.home.enum"), _case("listed_match IS NULL", "schema.settlement.required"))} AS codes FROM x"""))
def context_contract_errors(spark, sf_dir):
    """Null tri-states are absent keys here, which the contract does not allow."""
    sql = v.struct_sql(v.CONTEXT | {"lineups": v.CONTEXT["lineups"] | {"home": "if(k % 9 = 0, 'maybe', home_lineup)"}})
    docs = documents(v.view(spark, sf_dir, v.contexts(v.SPARK)), sql, "document", "k")
    return contracts.contract_errors(docs, "document", contracts.mlb_context).select("k", error_codes())


# ---- nested snapshots ---------------------------------------------------------------------------------

_NESTED = """named_struct(
  'event_id', if(candidate_id % 43 = 0, 'E-other', event_id), 'status', 'scheduled',
  'event', if(candidate_id % 59 = 0, NULL, named_struct('event_id', event_id, 'sport', sport,
     'competition', if(candidate_id % 37 = 0, NULL, competition), 'event_start_at', event_start_at,
     'status', if(candidate_id % 8 = 0, 'postponed', 'scheduled'),
     'participants', if(candidate_id % 31 = 0, array('a'), array('a', 'b')), 'source', 's', 'retrieved_at', captured_at)),
  'market', named_struct('market_id', market_id, 'book', portfolio_id, 'market_type', 'game_total', 'period', period,
     'line', line, 'selection', 'home', 'odds_decimal', if(candidate_id % 41 = 0, 1D, decimal_odds),
     'snapshot_at', if(candidate_id % 47 = 0, 'soon', captured_at),
     'outcomes', if(candidate_id % 29 = 0, array(named_struct('selection', 'home', 'odds_decimal', odds_home)),
        array(named_struct('selection', 'home', 'odds_decimal', odds_home), named_struct('selection', 'away', 'odds_decimal', if(candidate_id % 23 = 0, 1D, odds_away))))),
  'model', named_struct('model_name', 'm', 'model_version', '1', 'target_market', 'points', 'selection', model_selection,
     'probability_calibrated', probability_calibrated, 'prediction_generated_at', prediction_generated_at))"""

_K = "candidate_id"
_NO_EVENT = f"{_K} % 59 = 0"
_SNAPSHOT = [
    # Without an event object the root supplies event_id and status only.
    _case(f"{_NO_EVENT}", "missing_event.sport"),
    _case(f"{_NO_EVENT} OR {_K} % 37 = 0", "missing_event.competition"), _case(_NO_EVENT, "missing_event.event_start_at"),
    _case(_NO_EVENT, "missing_event.participants"),
    _case("probability_calibrated IS NULL", "missing_model.probability_calibrated"),
    _case(f"{_K} % 41 = 0", "invalid_market.odds_decimal"), _case("probability_calibrated IS NULL", "invalid_model.probability_calibrated"),
    _case(f"{_K} % 47 = 0", "invalid_timestamp.market.snapshot_at"), _case(f"{_K} % 29 = 0", "invalid_market.outcomes"),
]


def nested(spark, sf_dir, *keep):
    return documents(flat(spark, sf_dir), _NESTED, "document", _K, *keep)


@query("snapshot_check", over({"c": v.candidates}, f"SELECT candidate_id, codes, codes = '' AS valid FROM (SELECT *, {_codes(*_SNAPSHOT)} AS codes FROM c) t"))
def snapshot_check(spark, sf_dir):
    rows = contracts.contract_errors(nested(spark, sf_dir), "document", contracts.minimum_snapshot)
    return rows.select("candidate_id", F.array_join("errors", ",").alias("codes"), (F.size("errors") == 0).alias("valid"))


_QUALITY = [
    _case(f"{_K} % 8 = 0 AND NOT {_NO_EVENT}", "event_not_scheduled"),
    f"""CASE WHEN {_K} % 47 = 0 THEN 'invalid_or_missing_price_timestamp' WHEN date_diff('second', captured, evaluated) < -5 THEN 'price_timestamp_in_future'
        WHEN date_diff('second', captured, evaluated) > 300 THEN concat('stale_price:', date_diff('second', captured, evaluated), 's') END""",
    _case(f"{_K} % 29 = 0", "incomplete_outcome_set"), _case(f"{_K} % 23 = 0 AND {_K} % 29 <> 0", "invalid_outcome_odds"),
    _case("probability_calibrated IS NULL", "invalid_model_probability"), _case("model_selection <> 'home'", "model_selection_mismatch"),
]


@query("quality_gate", over({"c": v.candidates}, f"""
    SELECT candidate_id, codes, CASE WHEN codes = '' THEN 'VALID' ELSE 'BLOCKED' END AS status FROM (SELECT *, {_codes(*_QUALITY)} AS codes FROM c) t"""))
def quality_gate(spark, sf_dir):
    rows = flat(spark, sf_dir).select("candidate_id", F.col("evaluated_at").alias("now"), F.expr(_NESTED).alias("d")).select("candidate_id", "now", "d.*")
    out = gates.quality_gate(rows)
    return out.select("candidate_id", F.array_join("errors", ",").alias("codes"), "status")


# ---- review packets -----------------------------------------------------------------------------------

_PACKET = [
    _case(f"{_K} % 37 = 0", "packet.missing.event.competition"),
    _case(f"{_K} % 31 = 0", "packet.participants.two"),
    _case(f"{_K} % 41 = 0", "packet.odds.above_one"),
    _case(f"{_K} % 29 = 0", "packet.outcomes.two"),
    _case(f"{_K} % 43 = 0", "packet.event_id.conflict"),
]


@query("review_packet", over({"c": v.candidates}, f"""
    SELECT candidate_id, market_errors, model_decision, CASE WHEN market_errors = '' AND model_decision <> 'BLOCKED' THEN 'HUMAN_REVIEW_REQUIRED' ELSE 'BLOCKED' END AS gate, notes
    FROM (SELECT candidate_id, CASE WHEN {_NO_EVENT} THEN 'packet.event.object' ELSE {_codes(*_PACKET)} END AS market_errors,
      CASE WHEN {_codes(*_VERDICT_CODES)} <> '' THEN 'BLOCKED' WHEN calibration_status = 'validated' THEN 'VALIDATED' ELSE 'UNCALIBRATED' END AS model_decision,
      CASE WHEN candidate_id % 3 = 0 THEN competition END AS notes FROM c) t"""))
def review_packet(spark, sf_dir):
    base = flat(spark, sf_dir)
    packets = packets_of(spark, sf_dir, base)
    return packets.select(
        "candidate_id", F.array_join("validation.market_errors", ",").alias("market_errors"),
        F.col("validation.model.decision").alias("model_decision"), "gate", F.col("analysis.notes").alias("notes"),
    )


def packets_of(spark, sf_dir, base):
    markets = documents(base, _NESTED, "market_snapshot", "candidate_id")
    models = documents(base, MODEL_JSON, "model_output", "candidate_id")
    notes = base.where("candidate_id % 3 = 0").select("candidate_id", F.col("competition").alias("notes"))
    return review.review_packets(markets, models, notes, "candidate_id", created_at="2024-01-31T00:00:00Z")


@query("review_packet_hashes")
def review_packet_hashes(spark, sf_dir):
    return packets_of(spark, sf_dir, flat(spark, sf_dir)).select(
        "candidate_id", "packet_sha256", "market_snapshot_sha256", "model_output_sha256"
    )


# ---- risk policies ------------------------------------------------------------------------------------


def policy_values(d):
    """Settings of one policy per part; many break a rule."""
    return """
    SELECT p_partkey AS policy_key, (p_size - 5) / 1e2 AS minimum_ev, p_size / 1e2 AS warning, p_retailprice / 15e2 AS open_share,
      p_size - 3 AS market_age, CASE WHEN p_partkey % 9 = 0 THEN 1e-1 ELSE 0e0 END AS unknown_kelly, p_partkey % 10 <> 0 AS approval
    FROM {part}"""


@query("policy_contract_errors", over({"c": policy_values}, """
    SELECT policy_key, concat_ws(',',
      CASE WHEN open_share > 1 THEN 'schema.caps.max_open_exposure_fraction.maximum' END,
      CASE WHEN warning > 15e-2 THEN 'drawdown.order' END,
      CASE WHEN market_age < 1 THEN 'schema.freshness_seconds.market_snapshot.minimum' END,
      CASE WHEN NOT approval THEN 'schema.human_approval_required.const' END,
      CASE WHEN unknown_kelly <> 0 THEN 'schema.kelly_fraction.unknown.const' END,
      CASE WHEN minimum_ev < 0 THEN 'schema.minimum_ev.minimum' END) AS errors FROM c"""))
def policy_contract_errors(spark, sf_dir):
    policy = F.expr(v.policy_struct())
    changed = (
        policy.withField("minimum_ev", F.col("minimum_ev").cast("double"))
        .withField("drawdown.warning_fraction", F.col("warning").cast("double"))
        .withField("caps.max_open_exposure_fraction", F.col("open_share").cast("double"))
        .withField("freshness_seconds.market_snapshot", F.col("market_age").cast("long"))
        .withField("kelly_fraction.unknown", F.col("unknown_kelly").cast("double"))
        .withField("human_approval_required", F.col("approval"))
    )
    rows = v.view(spark, sf_dir, policy_values(v.SPARK), spread="part").select("policy_key", changed.alias("policy"))
    found = contracts.contract_errors(rows, "policy", contracts.risk_policy, "faults")
    return found.select("policy_key", F.array_join(F.array_sort(F.transform("faults", lambda e: e["code"])), ",").alias("errors"))


# ---- adapters -----------------------------------------------------------------------------------------

_RICH = """named_struct('output_schema_version', 'prediction-v2', 'event_id', event_id, 'sport', sport,
  'market', named_struct('market_type', 'game_total', 'period', period, 'selection', if(candidate_id % 53 = 0, ' ', ' over '), 'line', line,
     'book', 'b', 'odds_decimal', decimal_odds, 'opposing_odds_decimal', odds_away, 'no_vig_probability', 0.5D, 'snapshot_at', captured_at),
  'model', named_struct('model_name', 'm', 'model_version', '1', 'model_artifact_sha256', if(candidate_id % 9 = 0, 'xyz', upper(sha2(event_id, 256))),
     'feature_schema_version', 'f1', 'point_estimate', line, 'prediction_generated_at', captured_at, 'feature_cutoff_at', captured_at, 'training_cutoff_at', captured_at),
  'distribution', named_struct('method', 'm', 'residual_distribution_version', 'r1'),
  'calibration', named_struct('method', 'm', 'status', CASE candidate_id % 5 WHEN 0 THEN 'validated' WHEN 1 THEN 'provisional' WHEN 2 THEN 'degraded' WHEN 3 THEN 'validated' ELSE 'Other' END,
     'calibration_version', 'c1', 'calibration_artifact_sha256', sha2(market_id, 256), 'training_sample_size', CAST(90 AS BIGINT),
     'probability_selected_raw', probability_raw, 'probability_selected_calibrated', probability_calibrated,
     'probability_opposing_calibrated', 1 - probability_calibrated, 'probability_push', 0D),
  'validation', named_struct('sample_size', CAST(candidate_id % 7 AS BIGINT), 'model_brier_score', if(candidate_id % 13 = 0, 1.5D, brier_score),
     'market_brier_score', 0.23D, 'brier_skill_score', 0D, 'model_log_loss', 0.6D, 'market_log_loss', if(candidate_id % 6 = 0, 0.5D, 0.65D), 'model_ece', 0.02D, 'market_ece', 0.02D,
     'method', 'w', 'validation_period_start', if(candidate_id % 10 = 0, '', 'a'), 'validation_period_end', 'z'))"""

_RAW_OK = "probability_raw > 0 AND probability_raw < 1"
_STATUS = "CASE candidate_id % 5 WHEN 0 THEN 'validated' WHEN 1 THEN 'provisional' WHEN 2 THEN 'degraded' WHEN 3 THEN 'validated' ELSE 'Other' END"
_BRIER = "CASE WHEN candidate_id % 13 = 0 THEN 15e-1 ELSE brier_score END"
_PROVEN = f"coalesce({_STATUS} = 'validated' AND candidate_id % 7 >= 1 AND {_BRIER} <= 1 AND {_BRIER} < 23e-2 AND 6e-1 < CASE WHEN candidate_id % 6 = 0 THEN 5e-1 ELSE 65e-2 END AND probability_calibrated > 0, false)"


def rich(spark, sf_dir):
    rows = flat(spark, sf_dir).select("candidate_id", F.expr(_RICH).alias("d"), "market_id", "competition", F.lit("points").alias("target_market"), F.lit("standard").alias("settlement_rules"))
    return rows.select("candidate_id", "d.*", "market_id", "competition", "target_market", "settlement_rules")


@query("adapter_downgrade", over({"c": v.candidates}, f"""
    SELECT candidate_id, err AS mapping_error, CASE WHEN err IS NULL THEN st END AS calibration_status,
      CASE WHEN err IS NULL AND st = 'validated' THEN probability_calibrated END AS probability_calibrated,
      CASE WHEN err IS NULL THEN CASE WHEN st = 'validated' THEN 'sigmoid' ELSE 'none' END END AS calibration_method,
      CASE WHEN err IS NULL AND candidate_id % 7 >= 1 THEN candidate_id % 7 END AS validation_sample_size,
      CASE WHEN err IS NULL AND {_BRIER} <= 1 THEN {_BRIER} END AS brier_score,
      CASE WHEN err IS NULL AND candidate_id % 10 <> 0 THEN 'a/z' END AS validation_window,
      CASE WHEN err IS NULL AND candidate_id % 9 <> 0 THEN sha256(event_id) END AS model_artifact_sha256,
      CASE WHEN err IS NULL THEN 'over' END AS selection
    FROM (SELECT *, CASE WHEN candidate_id % 53 = 0 THEN 'blank:market.selection'
        WHEN NOT ({_RAW_OK}) THEN 'not_a_probability:calibration.probability_selected_raw' END AS err,
      CASE WHEN {_PROVEN} THEN 'validated' WHEN {_STATUS} = 'Other' THEN 'unknown' ELSE 'uncalibrated' END AS st FROM c) t"""))
def adapter_downgrade(spark, sf_dir):
    return adapters.adapt(rich(spark, sf_dir), "downgrade").select(
        "candidate_id", "mapping_error", "calibration_status", "probability_calibrated", "calibration_method",
        "validation_sample_size", "brier_score", "validation_window", "model_artifact_sha256", "selection",
    )


@query("adapter_block", over({"c": v.candidates}, f"""
    SELECT candidate_id, err AS mapping_error, CASE WHEN err IS NULL THEN CASE WHEN {_STATUS} = 'validated' THEN 'validated' ELSE 'unknown' END END AS calibration_status,
      CASE WHEN err IS NULL THEN probability_calibrated END AS probability_calibrated, CASE WHEN err IS NULL THEN 'other' END AS calibration_method,
      CASE WHEN err IS NULL THEN {_BRIER} END AS brier_score, CASE WHEN err IS NULL THEN 'a/z' END AS validation_window,
      CASE WHEN err IS NULL THEN concat('adapted_from=prediction-v2; rich_status=', {_STATUS}) END AS notes
    FROM (SELECT *, CASE WHEN NOT ({_RAW_OK}) THEN 'not_a_probability:probability_selected_raw' WHEN probability_calibrated IS NULL THEN 'not_a_probability:probability_selected_calibrated'
        WHEN candidate_id % 53 = 0 THEN 'blank:selection' WHEN candidate_id % 10 = 0 THEN 'blank:validation_period_start'
        WHEN candidate_id % 7 = 0 THEN 'below_one:sample_size' WHEN {_BRIER} IS NULL THEN 'not_a_number:model_brier_score' END AS err FROM c) t"""))
def adapter_block(spark, sf_dir):
    return adapters.adapt(rich(spark, sf_dir), "block").select(
        "candidate_id", "mapping_error", "calibration_status", "probability_calibrated", "calibration_method",
        "brier_score", "validation_window", "notes",
    )


# ---- hashes -------------------------------------------------------------------------------------------


@query("content_address", """
    SELECT doc_id, h AS content_sha256, concat('record_', substring(h, 1, 24)) AS prediction_id FROM (
      SELECT doc_id, sha256(concat('{"doc_id":', doc_id, ',"lang":', CAST(to_json(lang) AS VARCHAR), ',"n_chars":', n_chars,
        ',"source":', CAST(to_json(source) AS VARCHAR), ',"text":', CAST(to_json(text) AS VARCHAR), '}')) AS h FROM documents) t""")
def content_address(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents")
    return content_addressed(docs, ["doc_id", "text", "lang", "source", "n_chars"]).select("doc_id", "content_sha256", "prediction_id")


@query("residual_artifact_hash", over({"h": v.history}, """
    , p AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY ts, event_id) - 1 AS pos, CAST(y AS BIGINT) AS t FROM h)
    , a AS (SELECT grp, pos // 64 AS n, sha256(string_agg(CAST(t AS VARCHAR), ',' ORDER BY pos)) AS t FROM p GROUP BY ALL)
    , b AS (SELECT grp, n // 64 AS n, sha256(string_agg(t, ',' ORDER BY a.n)) AS t FROM a GROUP BY grp, a.n // 64)
    , d AS (SELECT grp, n // 64 AS n, sha256(string_agg(t, ',' ORDER BY b.n)) AS t FROM b GROUP BY grp, b.n // 64)
    , m AS (SELECT grp, max(pos) AS last FROM p GROUP BY grp)
    SELECT grp, sha256(concat('{"method":"empirical","model_version":', CAST(to_json(grp) AS VARCHAR), ',"values_sha256":"',
      CASE WHEN last < 64 THEN a.t WHEN last < 4096 THEN b.t ELSE d.t END, '"}')) AS artifact_sha256
    FROM m JOIN a USING (grp) JOIN b USING (grp) JOIN d USING (grp) WHERE a.n = 0 AND b.n = 0 AND d.n = 0"""))
def residual_artifact_hash(spark, sf_dir):
    from linewright.plans.history_queries import series

    rows = series(spark, sf_dir).withColumn("value", F.col("y").cast("long"))
    return artifacts.artifact_hash(rows, "grp", "pos", "value", method="empirical", fan=64)
