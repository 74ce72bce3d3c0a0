"""Gates, context, sizing and the decision table over candidate documents."""

from pyspark.sql import functions as F

from linewright.functions.ordered import latest_per_key
from linewright.operators import context, decision, gates, report, sizing
from linewright import fixed_values as fixed
from linewright.plans import views as v
from linewright.plans.registry import over, query
from linewright.session import code_version, store_folder
from linewright.sources import stores

P = v.POLICY


def _codes(*cases: str) -> str:
    return "concat_ws(',', " + ", ".join(cases) + ")"


def _case(test: str, code: str) -> str:
    return f"CASE WHEN {test} THEN '{code}' END"


# ---- gates as SQL over the flat candidates ------------------------------------------------------------
# Every 47th prediction time has no zone: no usable moment, and a contract error in the decision table.

_EVENT = "model_event_id <> event_id"
_FIELDS = [
    _case(_EVENT, "event_id"), _case("model_period <> period", "period"), _case("model_line <> line", "line"),
    _case("model_selection <> 'home'", "selection"),
    _case("domain_competition <> competition", "validation_domain.competition"),
    _case("model_period <> period", "validation_domain.period"), _case("model_line <> line", "validation_domain.line"),
]
_DOMAIN = "(model_period <> period OR model_line <> line OR domain_competition <> competition)"
_IDENTITY = [
    _case(_EVENT, "EVENT_ID_MISMATCH"), _case("model_selection <> 'home'", "SELECTION_MISMATCH"), _case(_DOMAIN, "DOMAIN_MISMATCH"),
]
_MARKET_STATE = [_case("market_status <> 'open'", "MARKET_NOT_OPEN"), _case("starts <= evaluated", "EVENT_ALREADY_STARTED")]
_PRICE = "CASE WHEN second_selection = 'home' THEN 'MARKET_INCOMPLETE' WHEN abs(odds_home - decimal_odds) > 1e-12 THEN 'SELECTED_PRICE_MISMATCH' END"
_AGE = lambda t: f"date_diff('second', {t}, evaluated)"
_FUTURE = _case(f"{_AGE('captured')} < 0", "TIMESTAMP_IN_FUTURE")
_STALE_MARKET = _case(f"{_AGE('captured')} > {P['age_market']}", "MARKET_SNAPSHOT_STALE")
_STALE_MODEL = _case(f"candidate_id % 47 <> 0 AND {_AGE('predicted')} > {P['age_model']}", "MODEL_OUTPUT_STALE")
_LEAKAGE = [
    _case("candidate_id % 47 <> 0 AND feature > predicted", "FEATURE_CUTOFF_AFTER_PREDICTION"), _case("training > feature", "TRAINING_CUTOFF_AFTER_FEATURES"),
]
_CALIBRATION = [
    _case("calibration_status = 'unknown'", "CALIBRATION_STATUS_NOT_ALLOWED"),
    _case("calibration_status = 'unknown'", "CALIBRATION_PROVENANCE_UNKNOWN"),
]


def paired(spark, sf_dir):
    return v.paired_documents(spark, sf_dir)


def joined(column: str):
    return F.array_join(column, ",").alias(column)


@query("identity_mismatch", over({"c": v.candidates}, f"""
    SELECT candidate_id, {_codes(*_FIELDS)} AS mismatched_fields, {_codes(*_IDENTITY)} AS identity_codes FROM c"""))
def identity_mismatch(spark, sf_dir):
    return gates.with_identity(paired(spark, sf_dir)).select("candidate_id", joined("mismatched_fields"), joined("identity_codes"))


@query("market_state_gate", over({"c": v.candidates}, f"SELECT candidate_id, {_codes(*_MARKET_STATE)} AS codes FROM c"))
def market_state_gate(spark, sf_dir):
    return gates.with_gate(paired(spark, sf_dir), "codes", gates.market_state_codes()).select("candidate_id", joined("codes"))


@query("price_match", over({"c": v.candidates}, f"SELECT candidate_id, {_codes(_PRICE)} AS codes FROM c"))
def price_match(spark, sf_dir):
    return gates.with_gate(paired(spark, sf_dir), "codes", [gates.price_code()]).select("candidate_id", joined("codes"))


@query("leakage_gate", over({"c": v.candidates}, f"SELECT candidate_id, {_codes(*_LEAKAGE)} AS codes FROM c"))
def leakage_gate(spark, sf_dir):
    return gates.with_gate(paired(spark, sf_dir), "codes", gates.leakage_codes()).select("candidate_id", joined("codes"))


@query("calibration_gate", over({"c": v.candidates}, f"""
    SELECT candidate_id, {_codes(*_CALIBRATION)} AS codes,
      CASE calibration_status WHEN 'validated' THEN probability_calibrated ELSE probability_raw END AS probability FROM c"""))
def calibration_gate(spark, sf_dir):
    rows = gates.with_gate(paired(spark, sf_dir), "codes", gates.calibration_codes())
    return rows.select("candidate_id", joined("codes"), F.expr(gates.ECONOMIC_PROBABILITY).alias("probability"))


# ---- candidates with portfolio and context as of their evaluation -------------------------------------

_ASOF = f"""
    , pj AS (SELECT candidate_id AS pk, pf.* FROM c JOIN pf ON c.portfolio_id = pf.portfolio_id AND c.correlation_key = pf.correlation_key
         AND pf.captured <= c.evaluated QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY pf.captured DESC) = 1)
    , cj AS (SELECT candidate_id AS ck, cx.* FROM c JOIN cx ON c.event_id = cx.event_id AND cx.context_time <= c.evaluated
         QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY cx.context_time DESC, cx.k) = 1)"""

_PORT_AGE = "date_diff('second', p_captured, evaluated)"
_BLOCKING = [
    _case("pitcher_rule = 'listed' AND listed_match IS NOT TRUE", "MLB_LISTED_PITCHER_MISMATCH"),
    _case("home_starter = 'changed'", "MLB_STARTER_CHANGED"), _case("home_lineup = 'material_change'", "MLB_LINEUP_CHANGED"),
    _case("(use_roof AND roof = false) OR (use_weather AND weather = false)", "MLB_ENVIRONMENT_MISMATCH"),
]
_WATCHING = [
    _case(f"{_AGE('context_time')} > {P['age_context']}", "MLB_CONTEXT_STALE"),
    _case("need_starters AND home_starter IN ('projected', 'unknown')", "MLB_STARTER_UNCONFIRMED"),
    _case("need_lineup AND home_lineup IN ('projected_compatible', 'unknown')", "MLB_LINEUP_UNCONFIRMED"),
    _case("need_bullpen AND period <> 'first_five' AND home_bullpen <> 'current'", "MLB_BULLPEN_UNAVAILABLE"),
    _case("(use_roof AND roof IS NULL) OR (use_weather AND weather IS NULL)", "MLB_ENVIRONMENT_UNCONFIRMED"),
]
_CONTEXT = f"""
    , x0 AS (SELECT c.*, pj.captured AS p_captured, league, bankroll, available_balance, stake_increment, drawdown_fraction, open_amount,
        daily_amount, league_amount, rolling_amount, correlation_amount, pj.pk, cj.ck, cj.* EXCLUDE (ck, k, event_id, captured_at),
        {_codes(*_BLOCKING)} AS blocking, {_codes(*_WATCHING)} AS watching
      FROM c LEFT JOIN pj ON pk = candidate_id LEFT JOIN cj ON ck = candidate_id)
    , x AS (SELECT *, CASE WHEN sport <> 'MLB' THEN 'NOT_APPLICABLE' WHEN ck IS NULL OR blocking <> '' THEN 'BLOCKED' WHEN watching <> '' THEN 'WATCH' ELSE 'VALID' END AS context_status,
        CASE WHEN sport <> 'MLB' THEN '' WHEN ck IS NULL THEN 'MLB_CONTEXT_MISSING' WHEN blocking <> '' THEN blocking ELSE watching END AS context_codes FROM x0)"""
_VIEWS = {"c": v.candidates, "pf": v.portfolios, "cx": v.contexts}


def assembled(spark, sf_dir):
    """Model and market come as separate tables here, as they would in use."""
    return decision.assemble_candidates(
        v.model_documents(spark, sf_dir), v.market_documents(spark, sf_dir), v.portfolio_documents(spark, sf_dir),
        v.policy_documents(spark), v.context_documents(spark, sf_dir).drop("k"),
    )


def with_books(spark, sf_dir):
    """Candidates with the portfolio as of their evaluation and nothing else joined."""
    return decision.as_of(v.paired_documents(spark, sf_dir), v.portfolio_documents(spark, sf_dir))


@query("context_status", over(_VIEWS, f"{_ASOF}{_CONTEXT} SELECT candidate_id, context_status, context_codes FROM x"))
def context_status(spark, sf_dir):
    known = decision.as_of(v.paired_documents(spark, sf_dir), contexts=v.context_documents(spark, sf_dir).drop("k"))
    rows = context.with_context_status(known, "policy.freshness_seconds.mlb_context")
    return rows.select("candidate_id", "context_status", joined("context_codes"))


_FRESH = [
    f"CASE WHEN {_AGE('captured')} < 0 THEN 'TIMESTAMP_IN_FUTURE' WHEN {_AGE('captured')} > {P['age_market']} THEN 'MARKET_SNAPSHOT_STALE' END",
    _case(f"{_PORT_AGE} > {P['age_portfolio']}", "PORTFOLIO_STATE_STALE"), _STALE_MODEL,
]


@query("freshness_gate", over(_VIEWS, f"{_ASOF}{_CONTEXT} SELECT candidate_id, {_codes(*_FRESH)} AS codes FROM x"))
def freshness_gate(spark, sf_dir):
    return gates.with_gate(with_books(spark, sf_dir), "codes", gates.freshness_codes()).select("candidate_id", joined("codes"))


@query("portfolio_scope_gate", over(_VIEWS, f"""{_ASOF}{_CONTEXT}
    SELECT candidate_id, {_codes(_case("league IS NULL OR league <> competition OR correlation_group IS DISTINCT FROM CASE WHEN league IS NULL THEN NULL ELSE correlation_key END", "DOMAIN_MISMATCH"),
      _case("correlation_group IS NULL", "UNKNOWN_CORRELATION"))} AS codes FROM x"""))
def portfolio_scope_gate(spark, sf_dir):
    return gates.with_gate(with_books(spark, sf_dir), "codes", gates.scope_codes()).select("candidate_id", joined("codes"))


_HARD = _codes(
    *_IDENTITY[:2],
    _case(f"{_DOMAIN} OR league <> competition OR correlation_group IS NULL", "DOMAIN_MISMATCH"),
    _case("correlation_group IS NULL", "UNKNOWN_CORRELATION"), *_MARKET_STATE, _PRICE, *_FRESH, *_LEAKAGE, *_CALIBRATION,
)
_TIER = lambda a, b: f"CASE calibration_status WHEN 'validated' THEN {a:e} WHEN 'uncalibrated' THEN {b:e} ELSE 0e0 END"
_ROOM = lambda cap, used: f"greatest(0, bankroll * {cap:e} - {used})"
_CAPS = {
    "kelly": "bankroll * kelly * fraction", "per_bet": f"bankroll * {P['per_bet']:e}", "open": _ROOM(P["open"], "open_amount"),
    "daily": _ROOM(P["daily"], "daily_amount"), "league": _ROOM(P["league"], "league_amount"),
    "rolling_3d": _ROOM(P["rolling"], "rolling_amount"), "correlation": _ROOM(P["correlation"], "correlation_amount"),
    "available_balance": "available_balance",
}
_CAP_NAMES = list(_CAPS)
_DECIDED = f"""{_ASOF}{_CONTEXT}
    , g AS (SELECT *, candidate_id % 41 = 0 OR candidate_id % 43 = 0 OR candidate_id % 47 = 0 OR pk IS NULL
          OR (candidate_id % 61 = 0 AND calibration_status = 'validated') AS invalid, {_HARD} AS hard,
        1 / decimal_odds AS raw, 1 / odds_home + 1 / odds_away + CASE WHEN sport = 'SOCCER' THEN 1 / odds_draw ELSE 0 END AS total,
        {_TIER(P['kelly_validated'], P['kelly_uncalibrated'])} AS fraction, {_TIER(P['weight_validated'], P['weight_uncalibrated'])} AS weight FROM x)
    , e1 AS (SELECT *, raw / total AS fair, CASE WHEN NOT invalid AND hard = '' THEN CASE calibration_status WHEN 'validated' THEN probability_calibrated ELSE probability_raw END END AS p FROM g)
    , e2 AS (SELECT *, fair + weight * (p - fair) AS sized, p * decimal_odds - 1 AS ev, p - fair AS edge FROM e1)
    , e3 AS (SELECT *, greatest(0, (sized * decimal_odds - 1) / (decimal_odds - 1)) AS kelly,
        {_codes(_case(f"ev < {P['minimum_ev']:e}", "EV_BELOW_MINIMUM"), _case(f"ev < {P['minimum_ev']:e}", "PRICE_BELOW_MINIMUM"), _case(f"edge < {P['minimum_edge']:e}", "EDGE_BELOW_MINIMUM"))} AS economic,
        CASE WHEN drawdown_fraction >= {P['pause']:e} THEN 'DRAWDOWN_PAUSE' WHEN drawdown_fraction >= {P['review']:e} THEN 'DRAWDOWN_REVIEW'
             WHEN drawdown_fraction >= {P['warning']:e} THEN 'DRAWDOWN_WARNING' END AS dd FROM e2)
    , e4 AS (SELECT *, {', '.join(f'{sql} AS cap_{n}' for n, sql in _CAPS.items())} FROM e3)
    , e5 AS (SELECT *, least({', '.join('cap_' + n for n in _CAP_NAMES)}) AS lowest, least({', '.join('cap_' + n for n in _CAP_NAMES[1:])}) AS hardest FROM e4)
    , e6 AS (SELECT *, CASE {' '.join(f"WHEN cap_{n} = lowest THEN '{n}'" for n in _CAP_NAMES)} END AS binding,
        CAST(floor(CAST(lowest AS DECIMAL(38,12)) / CAST(stake_increment AS DECIMAL(10,2))) * stake_increment AS DOUBLE) AS stake FROM e5)
    , z AS (SELECT *, CASE WHEN invalid OR hard <> '' THEN 'BLOCKED' WHEN economic <> '' THEN 'PASS' WHEN context_status = 'BLOCKED' THEN 'BLOCKED'
          WHEN context_status = 'WATCH' THEN 'WATCH' WHEN dd = 'DRAWDOWN_PAUSE' THEN 'BLOCKED' WHEN dd = 'DRAWDOWN_REVIEW' THEN 'WATCH'
          WHEN hardest <= 0 THEN 'BLOCKED' WHEN stake <= 0 OR stake < {P['minimum_stake']} THEN 'PASS' ELSE 'BET' END AS decision,
        CASE WHEN invalid THEN 'INPUT_SCHEMA_INVALID' WHEN hard <> '' THEN hard WHEN economic <> '' THEN economic
          WHEN context_status IN ('BLOCKED', 'WATCH') THEN context_codes WHEN dd IN ('DRAWDOWN_PAUSE', 'DRAWDOWN_REVIEW') THEN dd
          WHEN hardest <= 0 THEN 'NO_RISK_CAPACITY' WHEN stake <= 0 OR stake < {P['minimum_stake']} THEN 'STAKE_BELOW_MINIMUM'
          ELSE concat_ws(',', 'QUALIFIED', dd) END AS reason_codes,
        p IS NOT NULL AND economic = '' AND context_status NOT IN ('BLOCKED', 'WATCH') AND coalesce(dd NOT IN ('DRAWDOWN_PAUSE', 'DRAWDOWN_REVIEW'), true) AS reached FROM e6)"""


def decided(spark, sf_dir):
    """All decisions, built once for a state of the tables and a formula, held to their contract on every reading."""
    inputs = [v.table(spark, sf_dir, t) for t in v.tables_of(v.candidates, v.portfolios, v.contexts)]
    key = stores.content_key(decision.FORMULA, code_version(), fixed.NAMESPACE, v.policy_struct(), *[stores.input_version(t) for t in inputs])
    build = lambda: decision.decide(decision.with_contract_gate(assembled(spark, sf_dir)))
    return decision.upheld(stores.built_once(spark, store_folder(spark, "decisions"), key, build))


@query("decision_table", over(_VIEWS, f"""{_DECIDED}
    SELECT candidate_id, event_id, market_id, sport, competition, decision, reason_codes,
      CASE WHEN NOT invalid AND second_selection <> 'home' AND abs(odds_home - decimal_odds) <= 1e-12 THEN round(round(fair, 12), 6) END AS no_vig_probability,
      round(p, 6) AS probability, CASE WHEN p IS NOT NULL THEN round(round(ev, 12), 6) END AS ev, CASE WHEN p IS NOT NULL THEN round(round(edge, 12), 6) END AS edge,
      CASE WHEN p IS NOT NULL THEN round(round(kelly, 12), 6) END AS full_kelly, CASE WHEN reached THEN round(stake, 6) END AS final_stake,
      CASE WHEN reached THEN binding END AS binding_cap FROM z"""))
def decision_table(spark, sf_dir):
    rows = decided(spark, sf_dir).select(
        "candidate_id", "event_id", "market_id", "sport", "competition", "decision", joined("reason_codes"),
        F.col("market.no_vig_probability").alias("no_vig_probability"),
        F.col("model.probability_used_for_economics").alias("probability"), F.col("economics.ev").alias("ev"),
        F.col("economics.edge_vs_market_pp").alias("edge"), F.col("economics.full_kelly").alias("full_kelly"),
        F.round("staking.final_stake", 6).alias("final_stake"), F.col("staking.binding_cap").alias("binding_cap"),
    )
    numbers = ["no_vig_probability", "probability", "ev", "edge", "full_kelly"]
    return rows.withColumns({n: F.round(n, 6) for n in numbers})


_TAMPERED = "candidate_id % 7 = 0 OR candidate_id % 11 = 0 OR candidate_id % 13 = 0 OR candidate_id % 17 = 0"


@query("decision_contract", over(_VIEWS, f"SELECT CAST(0 AS BIGINT) AS violations, count(*) FILTER (WHERE {_TAMPERED}) AS tampered, count(*) AS decisions FROM c"))
def decision_contract(spark, sf_dir):
    """Every output row satisfies the decision contract; rows altered by key do not."""
    rows = decided(spark, sf_dir)
    wrong = F.expr(decision.output_violation())
    k = F.col("candidate_id")
    altered = rows.withColumn("_before", wrong).withColumns({
        "decision": F.when(k % 7 == 0, "MAYBE").otherwise(F.col("decision")),
        "reason_codes": F.when(k % 11 == 0, F.concat("reason_codes", F.slice("reason_codes", 1, 1))).otherwise(F.col("reason_codes")),
        "audit": F.when(k % 13 == 0, F.col("audit").withField("formula_version", F.lit("other"))).otherwise(F.col("audit")),
        "economics": F.when(k % 17 == 0, F.col("economics").withField("ev", F.lit(float("inf")))).otherwise(F.col("economics")),
    })
    return altered.agg(F.count_if("_before").alias("violations"), F.count_if(wrong).alias("tampered"), F.count(F.lit(1)).alias("decisions"))


@query("stake_caps", over(_VIEWS, f"""{_DECIDED}
    SELECT candidate_id, {', '.join(f'round(cap_{n}, 6) AS cap_{n}' for n in _CAP_NAMES)}, binding AS binding_cap, round(stake, 6) AS final_stake
    FROM z WHERE reached"""))
def stake_caps(spark, sf_dir):
    rows = decided(spark, sf_dir)
    return rows.where("staking.final_stake IS NOT NULL").select(
        "candidate_id", *[F.round(f"staking.caps.{n}", 6).alias(f"cap_{n}") for n in _CAP_NAMES],
        F.col("staking.binding_cap").alias("binding_cap"), F.round("staking.final_stake", 6).alias("final_stake"),
    )


@query("five_cap_sizing", over({"c": v.priced}, """
    , a AS (SELECT candidate_id, odds, p, CAST(10000 + candidate_id % 9000 AS DOUBLE) AS b, CAST(candidate_id % 1100 AS DOUBLE) AS u1, CAST(candidate_id % 2600 AS DOUBLE) AS u2,
        CAST(candidate_id % 1700 AS DOUBLE) AS u3, CAST(candidate_id % 4300 AS DOUBLE) AS u4 FROM c)
    , f AS (SELECT *, greatest(0, (p * odds - 1) / (odds - 1)) AS full_kelly FROM a)
    , g AS (SELECT *, b * full_kelly * 25e-2 AS provisional_stake, b * 2e-2 AS c1, greatest(0, b * 1e-1 - u1) AS c2, greatest(0, b * 25e-2 - u2) AS c3,
        greatest(0, b * 15e-2 - u3) AS c4, greatest(0, b * 4e-1 - u4) AS c5 FROM f)
    , h AS (SELECT *, least(c1, c2, c3, c4, c5) AS low FROM g)
    SELECT candidate_id, full_kelly, provisional_stake,
      CASE WHEN low > provisional_stake THEN 'kelly' WHEN c1 = low THEN 'per_bet' WHEN c2 = low THEN 'open' WHEN c3 = low THEN 'daily' WHEN c4 = low THEN 'league' ELSE 'rolling' END AS binding_cap,
      greatest(0, floor(least(provisional_stake, low) / 5e-1) * 5e-1) AS final_stake FROM h"""))
def five_cap_sizing(spark, sf_dir):
    k = F.col("candidate_id")
    rows = v.view(spark, sf_dir, v.priced(v.SPARK)).select(
        "candidate_id", "odds", F.col("p").alias("probability"), (10000 + k % 9000).cast("double").alias("bankroll"),
        F.lit(0.25).alias("kelly_fraction"), F.lit(0.02).alias("max_bet"), F.lit(0.10).alias("max_open"),
        F.lit(0.25).alias("max_daily"), F.lit(0.15).alias("max_league"), F.lit(0.40).alias("max_rolling"),
        (k % 1100).cast("double").alias("open_exposure"), (k % 2600).cast("double").alias("daily_turnover"),
        (k % 1700).cast("double").alias("league_exposure"), (k % 4300).cast("double").alias("rolling_turnover"),
        F.lit(0.5).alias("increment"),
    )
    out = sizing.five_cap_stakes(rows)
    # Per-row arithmetic is the same in both engines: no rounding needed.
    return out.select("candidate_id", "full_kelly", "provisional_stake", "binding_cap", "final_stake")


@query("drawdown_control", over(_VIEWS, f"""{_ASOF}{_CONTEXT}
    SELECT candidate_id, drawdown_fraction, CASE WHEN drawdown_fraction >= {P['pause']:e} THEN 'DRAWDOWN_PAUSE' WHEN drawdown_fraction >= {P['review']:e} THEN 'DRAWDOWN_REVIEW'
      WHEN drawdown_fraction >= {P['warning']:e} THEN 'DRAWDOWN_WARNING' END AS drawdown_code FROM x"""))
def drawdown_control(spark, sf_dir):
    return with_books(spark, sf_dir).select(
        "candidate_id", F.col("portfolio.drawdown_fraction").alias("drawdown_fraction"), F.expr(sizing.drawdown_codes()).alias("drawdown_code")
    )


@query("scan_summary", over(_VIEWS, f"""{_DECIDED}
    SELECT sport, count(DISTINCT event_id) AS events_scanned, count(DISTINCT (event_id, market_id)) AS markets_scanned,
      count(*) FILTER (WHERE decision = 'BET') AS bets, count(*) FILTER (WHERE decision = 'WATCH') AS watches,
      count(*) FILTER (WHERE decision = 'PASS') AS passes, count(*) FILTER (WHERE decision = 'BLOCKED') AS blocked,
      round(coalesce(sum(CASE WHEN decision = 'BET' THEN stake END), 0), 6) AS total_stake,
      round(any_value(open_before), 6) AS open_before, round(coalesce(any_value(open_before), 0) + coalesce(sum(CASE WHEN decision = 'BET' THEN stake END), 0), 6) AS open_after
    FROM z LEFT JOIN (SELECT o_sport, sum(open_amount) AS open_before FROM (SELECT DISTINCT sport AS o_sport, portfolio_id, correlation_key FROM c) asked
      JOIN (SELECT portfolio_id, correlation_key, open_amount FROM pf QUALIFY row_number() OVER (PARTITION BY portfolio_id, correlation_key ORDER BY captured DESC) = 1) newest
        USING (portfolio_id, correlation_key) GROUP BY o_sport) o ON o_sport = sport GROUP BY sport"""))
def scan_summary(spark, sf_dir):
    """Decisions and stakes of each sport, and the open exposure of its portfolios as last seen, before and after."""
    rows = decided(spark, sf_dir).withColumn("stake", F.col("staking.final_stake"))
    books = v.view(spark, sf_dir, v.portfolios(v.SPARK)).select("portfolio_id", "correlation_key", "captured", "open_amount")
    newest = latest_per_key(books, ["portfolio_id", "correlation_key"], [F.col("captured")])
    asked = v.view(spark, sf_dir, v.candidates(v.SPARK)).select("sport", "portfolio_id", "correlation_key").distinct()
    exposure = asked.join(newest, ["portfolio_id", "correlation_key"]).groupBy("sport").agg(F.sum("open_amount").alias("open_before"))
    out = report.scan_summary(rows, ["sport"], exposure=exposure)
    return out.withColumns({c: F.round(c, 6) for c in ("total_stake", "open_before", "open_after")})


_PERCENT = lambda x, sign="": f"printf('%{sign}.1f%%', round(round({x} * 100, 6), 1))"
_POINTS = "printf('%+.1f pp', round(round(edge * 100, 6), 1))"
_NEED = f"printf('%.2f', ceil(round((1 + {P['minimum_ev']:e}) / p * 100, 6)) / 100)"
_STAKE = "printf('%.2f', floor(round(stake * 100, 6)) / 100)"
_ODDS = "printf('%.2f', decimal_odds)"
_WHY = "replace(reason_codes, ',', ', ')"
_TOO_SHORT = "; ".join(f"{path}: text is too short" for path in ("model.settlement_rules", "model.validation_domain.settlement_rules", "market.settlement_rules"))
_INPUT_ERRORS = [
    _case("candidate_id % 61 = 0 AND calibration_status = 'validated'", "model.brier_score: value has the wrong type"),
    _case("candidate_id % 47 = 0", "model.prediction_generated_at: not a timestamp with a zone"),
    _case("candidate_id % 41 = 0", "model.probability_raw: number is out of range"),
    _case("candidate_id % 43 = 0", _TOO_SHORT), _case("pk IS NULL", "portfolio.$: document is missing"),
]
_CONFLICTS = [
    f"'fields that differ: ' || nullif(replace({_codes(*_FIELDS)}, ',', ', '), '')",
    _case("league IS DISTINCT FROM competition", "league of the portfolio differs"),
    _case("correlation_group IS DISTINCT FROM correlation_key", "correlation group of the portfolio differs"),
    f"CASE {_PRICE} WHEN 'MARKET_INCOMPLETE' THEN 'selection is not priced exactly once' WHEN 'SELECTED_PRICE_MISMATCH' THEN 'quoted price differs from the outcome' END",
]
_RESOLUTION = f"CASE WHEN invalid THEN concat_ws('; ', {', '.join(_INPUT_ERRORS)}) WHEN hard <> '' THEN concat_ws('; ', {', '.join(_CONFLICTS)}) ELSE '' END"


def _lines(*lines: str) -> str:
    """Text of several lines, each a list of SQL texts."""
    return "concat(" + ", chr(10), ".join(lines) + ")"


_FULL_BET = _lines(
    "'BET'", "'Event: ', event_id", "'Market / selection: ', market_id, ' — home'", f"'Book / odds: ', portfolio_id, ' @ ', {_ODDS}",
    f"'Model: m 1 | P ', {_PERCENT('p')}", f"'Market no-vig P: ', {_PERCENT('fair')}, ' | Break-even P: ', {_PERCENT('1 / decimal_odds')}",
    f"'EV: ', {_PERCENT('ev', '+')}, ' | Edge: ', {_POINTS}, ' | Minimum price: ', {_NEED}",
    f"'Stake: EUR ', {_STAKE}, ' / ', {_PERCENT('stake / bankroll')}", "'Risk: Kelly fraction ', fraction, ', binding cap ', binding",
    f"'Rule: ', {_NEED}, ' or better'", f"'Reason: ', {_WHY}",
)
_COMPACT_BET = _lines(
    "'PICK'", "sport, ' — ', event_id", "'Bet: home'", f"'Odds: ', {_ODDS}, ' @ ', portfolio_id", f"'Stake: ', {_STAKE}, ' (EUR)'",
    f"'Model P: ', {_PERCENT('p')}, ' | No-vig P: ', {_PERCENT('fair')}", f"'EV: ', {_PERCENT('ev', '+')}, ' | Edge: ', {_POINTS}",
    f"'Rule: ', {_NEED}", f"'Reason: ', {_WHY}",
)


@query("decision_report", over(_VIEWS, f"""{_DECIDED}
    SELECT candidate_id, CASE decision WHEN 'BET' THEN {_FULL_BET}
      WHEN 'WATCH' THEN {_lines("'WATCH'", f"'Current price: ', {_ODDS}", f"'Required price: ', {_NEED}", f"'Recheck: ', {_WHY}")}
      WHEN 'PASS' THEN {_lines("'PASS'", f"'Current price: ', {_ODDS}", f"'EV: ', {_PERCENT('ev', '+')}", f"'Primary reason: ', {_WHY}")}
      ELSE {_lines("'BLOCKED'", f"'Missing or conflicting input: ', {_WHY}", f"'Resolution: ', {_RESOLUTION}")} END AS report,
      CASE decision WHEN 'BET' THEN {_COMPACT_BET} END AS compact FROM z"""))
def decision_report(spark, sf_dir):
    """Full texts of all four decisions and the compact texts of bets."""
    rows = report.report_text(decided(spark, sf_dir).drop("audit", "decision_id"))
    return rows.select("candidate_id", "report", "compact")


_AUDITED = f"""
    , pf AS (SELECT portfolio_id, correlation_key, captured, sha256({v.canonical_sql(v.PORTFOLIO)}) AS h FROM pf0)
    , cx AS (SELECT k, event_id, context_time, sha256({v.canonical_sql(v.CONTEXT)}) AS h FROM cx0)
    , h AS (SELECT candidate_id, portfolio_id, correlation_key, event_id, evaluated, evaluated_at, sha256({v.canonical_sql(v.MODEL)}) AS h_model, sha256({v.canonical_sql(v.MARKET)}) AS h_market,
        sha256({v.canonical_sql(v.policy_tree())}) AS h_policy FROM c)
    , hp AS (SELECT h.*, coalesce(pf.h, sha256('null')) AS h_portfolio FROM h LEFT JOIN pf ON h.portfolio_id = pf.portfolio_id AND h.correlation_key = pf.correlation_key AND pf.captured <= h.evaluated
        QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY pf.captured DESC NULLS LAST) = 1)
    , hc AS (SELECT hp.*, cx.h AS h_context FROM hp LEFT JOIN cx ON hp.event_id = cx.event_id AND cx.context_time <= hp.evaluated
        QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY cx.context_time DESC NULLS LAST, cx.k) = 1)"""
_ID_TEXT = """'{' || CASE WHEN h_context IS NULL THEN '' ELSE '"context":"' || h_context || '",' END || '"evaluated_at":"' || evaluated_at || '","formula":"%s","market":"' || h_market
      || '","model":"' || h_model || '","policy":"' || h_policy || '","portfolio":"' || h_portfolio || '"}'""" % decision.FORMULA


@query("decision_audit_hashes", over({"c": v.candidates, "pf0": v.portfolios, "cx0": v.contexts}, f"""{_AUDITED}
    SELECT candidate_id, sha256({_ID_TEXT}) AS decision_id, h_model AS model_output_sha256, h_market AS market_snapshot_sha256, h_portfolio AS portfolio_state_sha256,
      h_policy AS risk_policy_sha256, h_context AS sport_context_sha256, '{decision.FORMULA}' AS formula_version FROM hc"""))
def decision_audit_hashes(spark, sf_dir):
    return decided(spark, sf_dir).select("candidate_id", "decision_id", "audit.*")


_ITEMS = ["forced_action", "recency", "price_anchoring", "double_counting"]


@query("audit_rollup", over({"c": v.candidates}, """
    , a AS (SELECT candidate_id, i, CASE (candidate_id * 7 + i * 13) % 9 WHEN 0 THEN 'FLAG' WHEN 1 THEN 'NOT APPLICABLE' ELSE 'CLEAR' END AS answer,
        (candidate_id + i) % 2 = 0 AS invalidates FROM c, (VALUES (0), (1), (2), (3)) items(i))
    SELECT candidate_id, count(*) AS n_answers, count(*) FILTER (WHERE answer = 'FLAG') AS n_flags, CAST(0 AS BIGINT) AS n_unknown,
      CASE WHEN bool_or(answer = 'FLAG' AND invalidates) THEN 'BLOCKED' ELSE 'PASS' END AS audit FROM a GROUP BY candidate_id"""))
def audit_rollup(spark, sf_dir):
    k, i = F.col("candidate_id"), F.col("i")
    answers = v.view(spark, sf_dir, v.candidates(v.SPARK)).select(
        "candidate_id", F.posexplode(F.array(*map(F.lit, _ITEMS))).alias("i", "item")
    ).select(
        "candidate_id", "item",
        F.when((k * 7 + i * 13) % 9 == 0, "FLAG").when((k * 7 + i * 13) % 9 == 1, "NOT APPLICABLE").otherwise("CLEAR").alias("answer"),
        ((k + i) % 2 == 0).alias("invalidates"),
    )
    return report.audit_rollup(answers, "candidate_id")
