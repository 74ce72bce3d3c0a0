"""The engine's inputs expressed over the given tables.

Each view is one SELECT in the dialect-neutral core of SQL; ``Dialect`` holds
the few spellings that differ, so an outside engine can read the same inputs.
Table names are placeholders (``{orders}``). Keys, prices and times come from
the rows; faults are injected by key modulus so every gate has rows on both
sides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


@dataclass(frozen=True)
class Dialect:
    name: str

    def iso(self, expr: str) -> str:
        if self.name == "spark":
            # Plain text of a zone-less timestamp: the session's zone plays no part.
            return f"concat(substring(CAST({expr} AS STRING), 1, 10), 'T', substring(CAST({expr} AS STRING), 12, 8), 'Z')"
        return f"strftime({expr}, '%Y-%m-%dT%H:%M:%SZ')"

    def text(self, expr: str) -> str:
        return f"CAST({expr} AS {'STRING' if self.name == 'spark' else 'VARCHAR'})"

    def seconds(self, later: str, earlier: str) -> str:
        if self.name == "spark":
            return f"timestampdiff(SECOND, {earlier}, {later})"
        return f"date_diff('second', {earlier}, {later})"

    def epoch(self, expr: str) -> str:
        if self.name == "spark":
            return f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {expr})"
        return f"CAST(floor(epoch({expr})) AS BIGINT)"


SPARK, DUCK = Dialect("spark"), Dialect("duck")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables_of(*views) -> list[str]:
    """The tables that views read."""
    texts = [view(SPARK) for view in views]
    return [t for t in TABLES if any("{" + t + "}" in text for text in texts)]


def view(spark: SparkSession, sf_dir: str, sql: str, *, spread: str | None = None) -> DataFrame:
    """Run a view. ``spread`` names the driving table of CPU-heavy work after it."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    if spread:
        used[spread] = spread_out(used[spread])
    return spark.sql(sql, **used)


def spread_out(scan: DataFrame) -> DataFrame:
    """Use all cores on an input of fewer file splits than cores; otherwise leave it alone."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def duck(sql: str) -> str:
    """The same view for an engine where the tables are registered by name."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def outcomes(d: Dialect) -> str:
    """Priced outcomes, one row per quote of a market."""
    return """
    SELECT l_orderkey AS market_id, l_suppkey AS book, l_linenumber AS line_number,
           concat('S', l_linenumber, '-', l_partkey) AS selection,
           (105 + 10 * l_quantity) / 1e2 AS decimal_odds, l_shipdate AS captured_on
    FROM {lineitem}"""


def priced(d: Dialect) -> str:
    """One candidate price per order with a model probability and a fair market value."""
    return """
    SELECT o_orderkey AS candidate_id, o_custkey AS event_id,
           (105 + o_orderkey * 31 % 400) / 1e2 AS odds,
           (105 + o_orderkey * 53 % 300) / 1e2 AS opposing_odds,
           (50 + o_orderkey * 7919 % 900) / 1e3 AS p,
           (10 + o_orderkey * 17 % 80) / 1e2 AS market_p,
           (o_orderkey * 13 % 6) / 5e0 AS weight,
           (o_orderkey % 7) / 1e2 AS target_ev
    FROM {orders}"""


def bets(d: Dialect) -> str:
    """Bet log. Money is exact decimal, so sums do not depend on row order.

    Probabilities are over 997: their squares do not end on exact halves, where
    two engines round apart.
    """
    return f"""
    SELECT l_orderkey AS market_id, concat('S', l_linenumber, '-', l_partkey) AS selection,
           concat('P', c_nationkey) AS portfolio_id, n_name AS competition,
           CASE n_regionkey WHEN 0 THEN 'MLB' WHEN 1 THEN 'NBA' WHEN 2 THEN 'NFL' WHEN 3 THEN 'SOCCER' ELSE 'KBO' END AS sport,
           concat('G', o_custkey % 20) AS correlation_group,
           concat('v', l_suppkey % 3) AS model_version, l_returnflag AS market_type,
           CAST(l_extendedprice AS DECIMAL(12,2)) AS stake,
           (105 + 10 * l_quantity) / 1e2 AS odds_taken,
           (105 + 10 * l_quantity) / 1e2 * (1 - l_discount + l_tax) AS closing_odds,
           CASE l_returnflag WHEN 'A' THEN 'WIN' WHEN 'R' THEN 'LOSS' ELSE 'OPEN' END AS result,
           CAST(CASE l_returnflag
                WHEN 'A' THEN CAST(l_extendedprice AS DECIMAL(12,2)) * CAST((5 + 10 * l_quantity) / 1e2 AS DECIMAL(6,2))
                WHEN 'R' THEN -CAST(l_extendedprice AS DECIMAL(12,2)) ELSE 0 END AS DECIMAL(20,4)) AS profit,
           (50 + (l_orderkey * 7919 + l_partkey * 31 + l_linenumber) % 900) / 997e0 AS p,
           (10 + (l_orderkey * 17 + l_partkey) % 80) / 1e2 AS market_p,
           l_shipdate AS decision_at, {d.seconds('l_shipdate', 'o_orderdate')} AS lead_seconds,
           l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS bet_key
    FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
         JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
         """


def scored(d: Dialect) -> str:
    """Labelled rows with a model probability; the market side is a spread of prices."""
    return """
    SELECT doc_id, lang AS segment, quality AS y,
           (1 + n_chars * 37 % 998) / 1003e0 AS p, (300 + doc_id % 400) / 997e0 AS market_p
    FROM {labels} JOIN {documents} USING (doc_id)"""


def history(d: Dialect) -> str:
    """Time-ordered training rows per event type."""
    return f"""
    SELECT event_type AS grp, event_id, ts, CAST(floor(value) AS DOUBLE) AS y, CAST(user_id % 7 AS DOUBLE) AS x,
           CAST(40 + user_id % 21 AS DOUBLE) AS line,
           (150 + event_id * 31 % 100) / 1e2 AS over_odds, (150 + event_id * 17 % 100) / 1e2 AS under_odds
    FROM {{events}}"""


def quotes(d: Dialect) -> str:
    """Facts reported by several sources about one subject."""
    return f"""
    SELECT user_id AS subject, event_id AS quote_id, ts, {d.epoch('ts')} AS retrieved_epoch, CAST(floor(value) AS BIGINT) AS fact,
           CASE event_type WHEN 'purchase' THEN 'official' WHEN 'signup' THEN 'licensed_feed'
                WHEN 'click' THEN 'statistical_provider' WHEN 'view' THEN 'verified_reporter'
                ELSE 'aggregator' END AS source
    FROM {{events}}"""


def log_rows(d: Dialect) -> str:
    """Append-only log: one log per conversation."""
    return "SELECT conv_id AS log_id, turn AS seq, role, text AS payload FROM {conversations}"


# The policy of the registered queries; portfolio snapshots are yearly, hence the wide limit.
POLICY = {
    "minimum_ev": 0.03, "minimum_edge": 0.015, "minimum_stake": 1.0,
    "kelly_validated": 0.25, "kelly_uncalibrated": 0.10, "weight_validated": 0.85, "weight_uncalibrated": 0.35,
    "per_bet": 0.02, "open": 0.10, "daily": 0.25, "league": 0.15, "rolling": 0.40, "correlation": 0.04,
    "age_market": 300, "age_portfolio": 40_000_000, "age_model": 1800, "age_context": 900,
    "warning": 0.10, "review": 0.15, "pause": 0.20,
}


def candidates(d: Dialect) -> str:
    """Candidates with flat model and market fields."""
    at = lambda base, n: f"{base} + INTERVAL '1' SECOND * ({n})"
    return f"""
    WITH base AS (
      SELECT o_orderkey AS k, o_custkey AS cust, o_orderpriority AS pri, n_name, n_nationkey, n_regionkey,
             {at("o_orderdate + INTERVAL '20' DAY", 'o_orderkey % 86400')} AS evaluated
      FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey),
    timed AS (
      SELECT *, {at('evaluated', 'CASE WHEN k % 53 = 0 THEN 10 ELSE -(k * 31 % 330) END')} AS captured,
             {at('evaluated', '-(k * 17 % 1900)')} AS predicted,
             {at('evaluated', 'CASE WHEN k % 101 = 0 THEN -60 ELSE 86400 * 10 END')} AS starts
      FROM base),
    cut AS (
      SELECT *, {at('predicted', 'CASE WHEN k % 89 = 0 THEN 5 ELSE -(k * 13 % 600) END')} AS feature FROM timed),
    trained AS (
      SELECT *, {at('feature', 'CASE WHEN k % 67 = 0 THEN 60 ELSE -86400 END')} AS training FROM cut)
    SELECT k AS candidate_id, evaluated, captured, predicted, starts, feature, training,
      {d.iso('evaluated')} AS evaluated_at, {d.iso('captured')} AS captured_at, {d.iso('starts')} AS event_start_at,
      CASE WHEN k % 47 = 0 THEN substring({d.iso('predicted')}, 1, 19) ELSE {d.iso('predicted')} END AS prediction_generated_at,
      {d.iso('feature')} AS feature_cutoff_at, {d.iso('training')} AS training_cutoff_at,
      concat('E', cust) AS event_id, concat('M', k) AS market_id, concat('P', n_nationkey) AS portfolio_id,
      concat('G', cust % 20) AS correlation_key,
      CASE WHEN k % 79 = 0 THEN NULL ELSE concat('G', cust % 20) END AS correlation_group,
      CASE n_regionkey WHEN 0 THEN 'MLB' WHEN 1 THEN 'NBA' WHEN 2 THEN 'NFL' WHEN 3 THEN 'SOCCER' ELSE 'KBO' END AS sport,
      n_name AS competition, CASE WHEN k % 13 = 0 THEN 'first_five' ELSE 'full_game' END AS period,
      (k % 20) / 2e0 AS line,
      CASE WHEN k % 31 = 0 THEN 'E-other' ELSE concat('E', cust) END AS model_event_id,
      CASE WHEN k % 29 = 0 THEN 'first_half' WHEN k % 13 = 0 THEN 'first_five' ELSE 'full_game' END AS model_period,
      CASE WHEN k % 83 = 0 THEN (k % 20) / 2e0 + 5e-1 ELSE (k % 20) / 2e0 END AS model_line,
      CASE WHEN k % 37 = 0 THEN 'elsewhere' ELSE n_name END AS domain_competition,
      CASE WHEN k % 59 = 0 THEN 'away' ELSE 'home' END AS model_selection,
      CASE WHEN k % 43 = 0 THEN '' ELSE 'standard' END AS settlement_rules,
      CASE WHEN k % 41 = 0 THEN 12e-1 ELSE (50 + k * 7919 % 900) / 1e3 END AS probability_raw,
      CASE WHEN pri = '3-MEDIUM' THEN NULL ELSE (50 + k * 6151 % 900) / 1e3 END AS probability_calibrated,
      CASE WHEN pri = '3-MEDIUM' THEN 'uncalibrated' WHEN pri = '4-NOT SPECIFIED' AND k % 2 = 0 THEN 'unknown' ELSE 'validated' END AS calibration_status,
      CASE WHEN pri = '3-MEDIUM' THEN 'none' ELSE 'sigmoid' END AS calibration_method,
      CASE WHEN k % 61 = 0 THEN NULL ELSE (200 + k % 50) / 1e3 END AS brier_score,
      CASE WHEN k % 19 = 0 THEN 'suspended' WHEN k % 23 = 0 THEN 'closed' ELSE 'open' END AS market_status,
      CASE WHEN k % 73 = 0 THEN (160 + k * 37 % 340) / 1e2 ELSE (155 + k * 37 % 340) / 1e2 END AS decimal_odds,
      (155 + k * 37 % 340) / 1e2 AS odds_home, (150 + k * 53 % 200) / 1e2 AS odds_away,
      (300 + k * 59 % 300) / 1e2 AS odds_draw,
      CASE WHEN k % 71 = 0 THEN 'home' ELSE 'away' END AS second_selection
    FROM trained"""


def portfolios(d: Dialect) -> str:
    """Yearly portfolio snapshots per (portfolio, correlation group); integer arithmetic throughout."""
    return f"""
    WITH yearly AS (
      SELECT n_nationkey, n_name, c_custkey % 20 AS g, year(o_orderdate) AS y, max(o_orderdate) AS captured,
             CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey % 97) AS BIGINT) AS s
      FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
      GROUP BY n_nationkey, n_name, c_custkey % 20, year(o_orderdate))
    SELECT concat('P', n_nationkey) AS portfolio_id, concat('G', g) AS correlation_key,
      captured, {d.iso('captured')} AS captured_at,
      CASE WHEN n_nationkey = 7 AND g = 3 THEN 'elsewhere' ELSE n_name END AS league,
      CAST(5000 + 500 * n AS DOUBLE) AS bankroll, CAST(s * 37 % (2000 + 200 * n) AS DOUBLE) AS available_balance,
      CASE g % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 5e-1 ELSE 1e-2 END AS stake_increment,
      CASE WHEN s % 5 = 0 THEN (s % 25) / 1e2 ELSE (s % 9) / 1e2 END AS drawdown_fraction, n AS open_positions_count,
      CAST(s * 11 % (600 + 50 * n) AS DOUBLE) AS open_amount, CAST(s * 13 % (1300 + 100 * n) AS DOUBLE) AS daily_amount,
      CAST(s * 17 % (800 + 70 * n) AS DOUBLE) AS league_amount, CAST(s * 19 % (2100 + 190 * n) AS DOUBLE) AS rolling_amount,
      CAST(s * 23 % (210 + 18 * n) AS DOUBLE) AS correlation_amount
    FROM yearly"""


def contexts(d: Dialect) -> str:
    """Baseball context documents, flat; several per event over time."""
    return f"""
    WITH c AS ({candidates(d)})
    SELECT candidate_id AS k, event_id,
      evaluated - INTERVAL '1' SECOND * (candidate_id * 7 % 1000) AS context_time,
      {d.iso("evaluated - INTERVAL '1' SECOND * (candidate_id * 7 % 1000)")} AS captured_at,
      CASE WHEN candidate_id % 10 = 1 THEN 'listed' ELSE 'action' END AS pitcher_rule,
      CASE candidate_id % 30 WHEN 1 THEN false WHEN 11 THEN NULL ELSE true END AS listed_match,
      CASE candidate_id % 47 WHEN 0 THEN 'changed' WHEN 1 THEN 'projected' WHEN 2 THEN 'unknown' ELSE 'confirmed' END AS home_starter,
      CASE candidate_id % 49 WHEN 0 THEN 'material_change' WHEN 1 THEN 'projected_compatible' WHEN 2 THEN 'unknown' ELSE 'confirmed_compatible' END AS home_lineup,
      CASE WHEN candidate_id % 12 = 0 THEN 'stale' ELSE 'current' END AS home_bullpen,
      CASE candidate_id % 41 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS roof,
      CASE candidate_id % 43 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS weather,
      candidate_id % 4 <> 0 AS need_starters, candidate_id % 6 <> 0 AS need_lineup,
      candidate_id % 3 <> 0 AS need_bullpen, candidate_id % 5 <> 0 AS use_roof, candidate_id % 7 <> 0 AS use_weather
    FROM c WHERE sport = 'MLB' AND candidate_id % 11 <> 0"""


# ---- flat rows to documents -------------------------------------------------------------------------
# A document is a tree: names to SQL texts, trees and lists. Spark builds structs from it; an outside engine
# writes its canonical text.


@dataclass(frozen=True)
class num:
    """SQL of a double."""

    sql: str


@dataclass(frozen=True)
class either:
    """One of two trees by an SQL condition."""

    test: str
    first: object
    second: object


def struct_sql(tree) -> str:
    """The tree as Spark SQL."""
    if isinstance(tree, dict):
        return "named_struct(" + ", ".join(f"'{n}', {struct_sql(t)}" for n, t in tree.items()) + ")"
    if isinstance(tree, list):
        return "array(" + ", ".join(map(struct_sql, tree)) + ")"
    if isinstance(tree, either):
        return f"if({tree.test}, {struct_sql(tree.first)}, {struct_sql(tree.second)})"
    return tree.sql if isinstance(tree, num) else tree


def number_sql(x: str) -> str:
    """The canonical text of a double in the outside engine's SQL."""
    decimal = f"printf('%.14e', {x})"
    near = f"floor(log2(abs({x})))"
    power = f"(CASE WHEN pow(2e0, {near}) > abs({x}) THEN {near} - 1 WHEN pow(2e0, {near} + 1) <= abs({x}) THEN {near} + 1 ELSE {near} END)"
    half = f"floor((52 - {power}) / 2)"
    mantissa = f"CAST(abs({x}) * pow(2e0, {half}) * pow(2e0, 52 - {power} - {half}) AS BIGINT)"
    return (
        f"CASE WHEN abs({x}) < 1e15 AND floor({x}) = {x} THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) "
        f"WHEN abs({x}) >= 1e-300 AND CAST({decimal} AS DOUBLE) = {x} THEN regexp_replace({decimal}, '\\.?0+e', 'e') "
        f"WHEN {x} IS NOT NULL THEN concat(CASE WHEN {x} < 0 THEN '-' ELSE '' END, {mantissa}, 'p', CAST({power} - 52 AS BIGINT)) END"
    )


def _marked_sql(tree) -> str:
    if isinstance(tree, dict):
        return "struct_pack(" + ", ".join(f'"{n}" := {_marked_sql(tree[n])}' for n in sorted(tree)) + ")"
    if isinstance(tree, list):
        return "[" + ", ".join(map(_marked_sql, tree)) + "]"
    if isinstance(tree, either):
        return f"CASE WHEN {tree.test} THEN {_marked_sql(tree.first)} ELSE {_marked_sql(tree.second)} END"
    return f"chr(2) || ({number_sql(f'CAST({tree.sql} AS DOUBLE)')})" if isinstance(tree, num) else tree


def canonical_sql(tree) -> str:
    """The canonical text of the tree in the outside engine's SQL."""
    return f"""regexp_replace(CAST(to_json({_marked_sql(tree)}) AS VARCHAR), '"\\\\u0002(-?[0-9][^"]*)"', '\\1', 'g')"""


def _line(column: str) -> dict:
    return {"kind": "'number'", "num": num(column), "str": "CAST(NULL AS STRING)"}


def _outcome(selection: str, odds: str) -> dict:
    return {"selection": selection, "decimal_odds": num(odds)}


MODEL = {
    "schema_version": "'linewright.model-output.v1'", "event_id": "model_event_id", "market_id": "market_id",
    "model_name": "'m'", "model_version": "'1'", "sport": "sport", "competition": "competition", "market_type": "'game_total'",
    "target_market": "'points'", "period": "model_period",
    "line": _line("model_line"),
    "settlement_rules": "settlement_rules", "selection": "model_selection", "probability_raw": num("probability_raw"),
    "probability_calibrated": num("probability_calibrated"), "calibration_status": "calibration_status",
    "calibration_method": "calibration_method", "prediction_generated_at": "prediction_generated_at",
    "feature_cutoff_at": "feature_cutoff_at", "training_cutoff_at": "training_cutoff_at", "feature_schema_version": "'f1'",
    "validation_domain": {
        "sport": "sport", "competition": "domain_competition", "market_type": "'game_total'", "target_market": "'points'",
        "period": "model_period", "line": _line("model_line"),
        "settlement_rules": "settlement_rules",
    },
    "validation_window": "'w'", "validation_sample_size": "CAST(500 AS BIGINT)", "brier_score": num("brier_score"),
    "log_loss": num("0.6e0"), "expected_calibration_error": num("0.02e0"),
}

MARKET = {
    "schema_version": "'linewright.market-snapshot.v1'", "event_id": "event_id", "market_id": "market_id",
    "book": "portfolio_id", "captured_at": "captured_at", "event_start_at": "event_start_at", "sport": "sport",
    "competition": "competition", "market_type": "'game_total'", "target_market": "'points'", "period": "period",
    "line": _line("line"), "settlement_rules": "settlement_rules",
    "selection": "'home'", "decimal_odds": num("decimal_odds"), "market_status": "market_status", "is_complete": "true",
    "outcomes": either(
        "sport = 'SOCCER'",
        [_outcome("'home'", "odds_home"), _outcome("second_selection", "odds_away"), _outcome("'draw'", "odds_draw")],
        [_outcome("'home'", "odds_home"), _outcome("second_selection", "odds_away")],
    ),
    "correlation_group": "correlation_group",
}

PORTFOLIO = {
    "schema_version": "'linewright.portfolio-state.v1'", "portfolio_id": "portfolio_id", "captured_at": "captured_at",
    "currency": "'EUR'", "bankroll": num("bankroll"), "available_balance": num("available_balance"),
    "stake_increment": num("stake_increment"), "league": "league", "correlation_group": "correlation_key",
    "drawdown_fraction": num("drawdown_fraction"), "open_positions_count": "open_positions_count",
    "exposures": {
        "open_amount": num("open_amount"), "daily_turnover_amount": num("daily_amount"), "league_amount": num("league_amount"),
        "rolling_3d_turnover_amount": num("rolling_amount"), "correlation_group_amount": num("correlation_amount"),
    },
}

CONTEXT = {
    "schema_version": "'linewright.mlb-context.v1'", "event_id": "event_id", "captured_at": "captured_at",
    "settlement": {"pitcher_rule": "pitcher_rule", "listed_pitchers_match": "listed_match"},
    "starters": {"home": {"name": "'h'", "status": "home_starter"}, "away": {"name": "'a'", "status": "'confirmed'"}},
    "lineups": {"home": "home_lineup", "away": "'confirmed_compatible'"},
    "bullpen": {"home": "home_bullpen", "away": "'current'"},
    "environment": {
        "roof_matches_model": "roof", "weather_matches_model": "weather", "umpire_matches_model": "CAST(NULL AS BOOLEAN)",
    },
    "model_dependencies": {
        "requires_confirmed_starters": "need_starters", "requires_lineup_compatibility": "need_lineup",
        "requires_bullpen_state": "need_bullpen", "uses_roof": "use_roof", "uses_weather": "use_weather", "uses_umpire": "false",
    },
}


def policy_tree() -> dict:
    p = {k: num(f"{v!r}e0") if isinstance(v, float) else f"CAST({v} AS BIGINT)" for k, v in POLICY.items()}
    tiers = lambda kind: {"validated": p[kind + "_validated"], "uncalibrated": p[kind + "_uncalibrated"], "unknown": num("0e0")}
    return {
        "schema_version": "'linewright.risk-policy.v1'", "policy_id": "'base'", "policy_version": "'1'", "minimum_ev": p["minimum_ev"],
        "minimum_edge_probability_points": p["minimum_edge"], "minimum_stake": p["minimum_stake"],
        "allowed_calibration_statuses": ["'validated'", "'uncalibrated'"], "kelly_fraction": tiers("kelly"), "sizing_model_weight": tiers("weight"),
        "caps": {
            "max_stake_fraction_per_bet": p["per_bet"], "max_open_exposure_fraction": p["open"], "max_daily_turnover_fraction": p["daily"],
            "max_league_exposure_fraction": p["league"], "max_rolling_3d_turnover_fraction": p["rolling"],
            "max_correlation_group_fraction": p["correlation"],
        },
        "freshness_seconds": {
            "market_snapshot": p["age_market"], "portfolio_state": p["age_portfolio"], "model_output": p["age_model"], "mlb_context": p["age_context"],
        },
        "drawdown": {"warning_fraction": p["warning"], "review_fraction": p["review"], "pause_fraction": p["pause"]},
        "human_approval_required": "true", "block_unknown_correlation": "true",
    }


def policy_struct() -> str:
    return struct_sql(policy_tree())


def model_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, candidates(SPARK), spread="orders").select("candidate_id", F.expr(struct_sql(MODEL)).alias("model"))


def market_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, candidates(SPARK), spread="orders").select(
        "candidate_id", F.expr(struct_sql(MARKET)).alias("market"), "evaluated_at", "portfolio_id", "correlation_key",
        F.lit("base").alias("policy_id"),
    )


def paired_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and market of one candidate built from its single source row: no join needed."""
    return view(spark, sf_dir, candidates(SPARK), spread="orders").select(
        "candidate_id", F.expr(struct_sql(MODEL)).alias("model"), F.expr(struct_sql(MARKET)).alias("market"), "evaluated_at",
        "portfolio_id", "correlation_key", F.expr(policy_struct()).alias("policy"),
    )


def portfolio_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, portfolios(SPARK)).select(
        "portfolio_id", "correlation_key", F.expr(struct_sql(PORTFOLIO)).alias("portfolio"),
        F.expr("try_to_timestamp(captured_at)").alias("portfolio_at"),
    )


def context_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, contexts(SPARK)).select(
        "k", "event_id", F.expr(struct_sql(CONTEXT)).alias("context"), F.expr("try_to_timestamp(captured_at)").alias("context_at"),
    )


def policy_documents(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("base").alias("policy_id"), F.expr(policy_struct()).alias("policy"))
