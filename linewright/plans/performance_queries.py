"""Bet-log performance, exposure, turnover, calibration metrics."""

from pyspark.sql import functions as F

from linewright.functions.ordered import attach
from linewright.operators import metrics, performance, portfolio, snapshots
from linewright.operators.markets import market_totals
from linewright.plans import views as v
from linewright.plans.registry import over, query, r, rounded

_MEASURES = """count(*) AS bets, CAST(sum(stake) AS DOUBLE) AS stake, CAST(sum(profit) AS DOUBLE) AS profit,
  round(CAST(sum(profit) AS DOUBLE) / CAST(sum(stake) AS DOUBLE), 9) AS roi,
  round(avg((p - y) * (p - y)), 9) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 9) AS log_loss,
  round(avg(odds_taken / closing_odds - 1), 9) AS avg_price_clv"""
_SETTLED = "SELECT *, CASE result WHEN 'WIN' THEN 1e0 ELSE 0e0 END AS y FROM b WHERE result IN ('WIN', 'LOSS')"
_RATIOS = ["roi", "brier", "log_loss", "avg_price_clv"]


def bets(spark, sf_dir):
    return v.view(spark, sf_dir, v.bets(v.SPARK))


@query("performance_summary", over({"b": v.bets}, f"""
    SELECT model_version, {_MEASURES} FROM ({_SETTLED}) s GROUP BY model_version"""))
def performance_summary(spark, sf_dir):
    return rounded(performance.settled_summary(bets(spark, sf_dir), ["model_version"]), *_RATIOS)


_BINS = " + ".join(f"CASE WHEN p >= {e!r} THEN 1 ELSE 0 END" for e in metrics.stats.ECE_EDGES)
_SEGMENTS = ["sport", "competition", "market_type", "model_version", "probability_bucket", "time_to_start", "price_range"]


@query("performance_segments", over({"b": v.bets}, f"""
    , t AS (SELECT *, {_BINS} AS probability_bucket,
        CASE WHEN odds_taken < 1.5 THEN 'short' WHEN odds_taken < 2.5 THEN 'middle' WHEN odds_taken < 4 THEN 'long' ELSE 'outsider' END AS price_range,
        CASE WHEN lead_seconds < 0 THEN 'in_play' WHEN lead_seconds < 86400 THEN 'same_day' WHEN lead_seconds < 604800 THEN 'same_week' ELSE 'early' END AS time_to_start
        FROM ({_SETTLED}) s)
    """ + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS segment, {_MEASURES}, count(*) < 500 AS small_sample, "
        f"count(DISTINCT model_version) > 1 AS mixed_versions FROM t GROUP BY {d}" for d in _SEGMENTS
    )))
def performance_segments(spark, sf_dir):
    rows = performance.segmented(performance.with_buckets(bets(spark, sf_dir)), _SEGMENTS, minimum_sample=500)
    return rounded(rows, *_RATIOS)


@query("bankroll_return", over({"b": v.bets}, f"""
    SELECT portfolio_id, CAST(sum(profit) AS DOUBLE) AS net_profit, 1000000.0::DOUBLE + 1000 * c.n AS starting_bankroll,
      round(CAST(sum(profit) AS DOUBLE) / (1000000 + 1000 * c.n), 9) AS bankroll_return
    FROM ({_SETTLED}) s JOIN (SELECT concat('P', c_nationkey) AS pid, count(*) AS n FROM customer GROUP BY 1) c ON pid = portfolio_id
    GROUP BY portfolio_id, c.n"""))
def bankroll_return(spark, sf_dir):
    starting = v.table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("P"), "c_nationkey").alias("portfolio_id")).agg(
        (1_000_000.0 + 1000 * F.count(F.lit(1))).alias("starting_bankroll")
    )
    return rounded(performance.bankroll_return(bets(spark, sf_dir), starting, ["portfolio_id"]), "bankroll_return")


@query("clv_report", over({"b": v.bets, "o": v.outcomes}, f"""
    , f AS (SELECT market_id, sum(1e0 / decimal_odds) AS s FROM o GROUP BY market_id HAVING count(*) >= 2)
    , m AS (SELECT b.*, f.s, CASE WHEN closing_odds > 1 THEN 1 / closing_odds END AS closing FROM b LEFT JOIN f ON b.market_id = f.market_id)
    SELECT bet_key, odds_taken, {r('closing - 1 / odds_taken AS raw_clv_pp', 'odds_taken * closing - 1 AS price_clv',
      'closing / (s + closing - 1 / odds_taken) - 1 / odds_taken / s AS no_vig_clv_pp',
      'closing / (s + closing - 1 / odds_taken) - 1 / odds_taken AS probability_clv')}
    FROM m"""))
def clv_report(spark, sf_dir):
    """Closing market: the taken price moved, the other outcomes as quoted. No closing price, no comparison."""
    sums = market_totals(v.view(spark, sf_dir, v.outcomes(v.SPARK)), ["market_id"])
    entry = attach(bets(spark, sf_dir), sums.select("market_id", F.col("market_sum").alias("entry_sum")), ["market_id"])
    entry = entry.withColumns({
        "entry_no_vig": F.expr("try_divide(try_divide(1D, odds_taken), entry_sum)"),
        "closing_no_vig": F.expr("try_divide(try_divide(1D, closing_odds), entry_sum + try_divide(1D, closing_odds) - try_divide(1D, odds_taken))"),
    }).withColumn("closing_no_vig", F.expr("if(closing_odds > 1, closing_no_vig, NULL)"))
    rows = performance.clv_report(entry, sums.select("market_id", "market_sum"), ["market_id"])
    numbers = ["raw_clv_pp", "price_clv", "no_vig_clv_pp", "probability_clv"]
    return rounded(rows, *numbers).select("bet_key", "odds_taken", *numbers)


@query("max_drawdown", over({"b": v.bets}, f"""
    , run AS (SELECT portfolio_id, 1000000 + sum(profit) OVER (PARTITION BY portfolio_id ORDER BY decision_at, bet_key, profit, stake ROWS UNBOUNDED PRECEDING) AS bank,
               decision_at, bet_key, profit, stake FROM ({_SETTLED}) s),
      peak AS (SELECT *, greatest(1000000, max(bank) OVER (PARTITION BY portfolio_id ORDER BY decision_at, bet_key, profit, stake ROWS UNBOUNDED PRECEDING)) AS top FROM run)
    SELECT portfolio_id, round(greatest(0, max(CAST(top - bank AS DOUBLE) / CAST(top AS DOUBLE))), 6) AS maximum_drawdown, count(*) AS n_bets
    FROM peak GROUP BY portfolio_id"""))
def max_drawdown(spark, sf_dir):
    opened = bets(spark, sf_dir).withColumn("opening", F.lit(1_000_000).cast("decimal(20,4)"))
    rows = performance.maximum_drawdown(
        opened.select("portfolio_id", "decision_at", "bet_key", "profit", "stake", "result", "opening"),
        ["portfolio_id"], ["decision_at", "bet_key", "profit", "stake"], starting="opening",
    )
    return rows.withColumn("maximum_drawdown", F.round("maximum_drawdown", 6))


@query("rolling_turnover_3d", over({"b": v.bets}, f"""
    SELECT DISTINCT portfolio_id, {v.DUCK.iso('decision_at')} AS at,
      CAST(sum(stake) OVER (PARTITION BY portfolio_id ORDER BY decision_at RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW) AS DOUBLE) AS rolling_turnover
    FROM b"""))
def rolling_turnover_3d(spark, sf_dir):
    rows = performance.rolling_turnover(
        bets(spark, sf_dir).select("portfolio_id", F.col("decision_at").cast("timestamp").alias("decision_at"), "stake"),
        ["portfolio_id"], "decision_at", "stake",
    )
    return rows.select(
        "portfolio_id", F.expr(v.SPARK.iso("decision_at")).alias("at"), F.col("rolling_turnover").cast("double").alias("rolling_turnover")
    )


_NOW = "1998-06-15 00:00:00"


@query("exposure_rollup", over({"b": v.bets}, f"""
    , base AS (SELECT portfolio_id, competition, correlation_group,
        sum(CASE WHEN result = 'OPEN' THEN stake ELSE 0 END) AS o, sum(CASE WHEN CAST(decision_at AS DATE) = DATE '1998-06-15' THEN stake ELSE 0 END) AS d,
        sum(CASE WHEN decision_at >= TIMESTAMP '{_NOW}' - INTERVAL 3 DAY THEN stake ELSE 0 END) AS w, sum(CASE WHEN result = 'OPEN' THEN 1 ELSE 0 END) AS n
        FROM b WHERE decision_at <= TIMESTAMP '{_NOW}' GROUP BY 1, 2, 3)
    SELECT portfolio_id, competition, correlation_group, CAST(o AS DOUBLE) AS correlation_group_amount,
      CAST(sum(o) OVER p AS DOUBLE) AS open_amount, CAST(sum(d) OVER p AS DOUBLE) AS daily_turnover_amount,
      CAST(sum(w) OVER p AS DOUBLE) AS rolling_3d_turnover_amount, CAST(sum(n) OVER p AS BIGINT) AS open_positions_count,
      CAST(sum(o) OVER (PARTITION BY portfolio_id, competition) AS DOUBLE) AS league_amount
    FROM base WINDOW p AS (PARTITION BY portfolio_id)"""))
def exposure_rollup(spark, sf_dir):
    rows = portfolio.exposure_rollup(bets(spark, sf_dir), as_of=_NOW)
    money = ["correlation_group_amount", "open_amount", "daily_turnover_amount", "rolling_3d_turnover_amount", "league_amount"]
    return rows.withColumns({m: F.col(m).cast("double") for m in money})


def scored(spark, sf_dir):
    return v.view(spark, sf_dir, v.scored(v.SPARK))


_CLIPPED = "least(greatest(p, 1e-6), 1 - 1e-6)"


@query("brier_logloss", over({"s": v.scored}, f"""
    SELECT segment, count(*) AS n, {r('avg((p - y) * (p - y)) AS brier',
      f'avg(-(y * ln({_CLIPPED}) + (1 - y) * ln(1 - {_CLIPPED}))) AS log_loss')} FROM s GROUP BY segment"""))
def brier_logloss(spark, sf_dir):
    return rounded(metrics.scoring_rules(scored(spark, sf_dir), "p", "y", ["segment"]), "brier", "log_loss")


_CURVE = f"SELECT segment, {_BINS} AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS observed_rate FROM s GROUP BY 1, 2"


@query("reliability_curve", over({"s": v.scored}, f"""
    SELECT segment, bin, n, {r('mean_p AS mean_p', 'observed_rate AS observed_rate')} FROM ({_CURVE}) c"""))
def reliability_curve(spark, sf_dir):
    return rounded(metrics.reliability(scored(spark, sf_dir), "p", "y", ["segment"]), "mean_p", "observed_rate")


@query("ece_score", over({"s": v.scored}, f"""
    SELECT segment, CAST(sum(n) AS BIGINT) AS n, {r('sum(n * abs(mean_p - observed_rate)) / sum(n) AS ece')} FROM ({_CURVE}) c GROUP BY segment"""))
def ece_score(spark, sf_dir):
    return rounded(metrics.calibration_error(scored(spark, sf_dir), "p", "y", ["segment"]), "ece")


def _card(by: str) -> str:
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    bins = lambda p: _BINS.replace("p >=", f"{p} >=")
    gap = lambda p: (
        f"SELECT {lead}sum(abs(g)) AS gap FROM (SELECT {lead}{bins(p)} AS bin, sum({p} - y) AS g FROM s GROUP BY {lead}{bins(p)}) q {group}"
    )
    join = (lambda t: f"JOIN ({gap(t)}) {t}g USING ({by})") if by else (lambda t: f", ({gap(t)}) {t}g")
    clip = lambda p: f"least(greatest({p}, 1e-6), 1 - 1e-6)"
    loss = lambda p: f"avg(-(y * ln({clip(p)}) + (1 - y) * ln(1 - {clip(p)})))"
    return f"""SELECT {lead}n AS sample_size, {r('mb AS model_brier_score', 'kb AS market_brier_score', '1 - mb / kb AS brier_skill_score',
        'ml AS model_log_loss', 'kl AS market_log_loss', 'pg.gap / n AS model_ece', 'market_pg.gap / n AS market_ece')}, ml, kl, mb, kb
      FROM (SELECT {lead}count(*) AS n, avg((p - y) * (p - y)) AS mb, avg((market_p - y) * (market_p - y)) AS kb,
            {loss('p')} AS ml, {loss('market_p')} AS kl FROM s {group}) t {join('p')} {join('market_p')}"""


_CARD_NUMBERS = [
    "model_brier_score", "market_brier_score", "brier_skill_score", "model_log_loss", "market_log_loss", "model_ece", "market_ece",
]
_CARD_COLUMNS = "sample_size, " + ", ".join(_CARD_NUMBERS)


@query("model_vs_market", over({"s": v.scored}, f"""
    SELECT segment, {_CARD_COLUMNS} FROM ({_card('segment')}) a
    UNION ALL SELECT 'all', {_CARD_COLUMNS} FROM ({_card('')}) b"""))
def model_vs_market(spark, sf_dir):
    rows = scored(spark, sf_dir)
    by_segment = metrics.scorecard(rows, "p", "market_p", "y", ["segment"])
    total = metrics.scorecard(rows, "p", "market_p", "y").withColumn("segment", F.lit("all"))
    return rounded(by_segment.unionByName(total), *_CARD_NUMBERS)


@query("calibration_status", over({"s": v.scored}, f"""
    SELECT segment, sample_size, CASE WHEN sample_size < 100 THEN 'provisional' WHEN mb < kb AND ml < kl THEN 'validated' ELSE 'degraded' END AS calibration_status
    FROM ({_card('segment')}) a"""))
def calibration_status(spark, sf_dir):
    card = metrics.scorecard(scored(spark, sf_dir), "p", "market_p", "y", ["segment"])
    return metrics.calibration_status(card, 100).select("segment", "sample_size", "calibration_status")


@query("latest_snapshot", over({"q": v.quotes}, """
    SELECT subject, quote_id, fact, retrieved_epoch FROM (
      SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ts DESC, quote_id DESC) AS n FROM q
      WHERE ts <= TIMESTAMP '2024-01-20 00:00:00') t WHERE n = 1"""))
def latest_snapshot(spark, sf_dir):
    rows = v.view(spark, sf_dir, v.quotes(v.SPARK)).drop("source")
    newest = snapshots.latest_snapshot(
        rows, ["subject"], "ts", evaluated_at=F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), tiebreak=["quote_id"]
    )
    return newest.select("subject", "quote_id", "fact", "retrieved_epoch")


_RANK = "CASE source WHEN 'official' THEN 1 WHEN 'licensed_feed' THEN 2 WHEN 'statistical_provider' THEN 3 WHEN 'verified_reporter' THEN 4 WHEN 'aggregator' THEN 5 ELSE 6 END"


@query("source_reconciliation", over({"q": v.quotes}, f"""
    SELECT subject, chosen_value, source_rank, chosen_id, n_values, n_reports, n_values > 1 AS conflict FROM (
      SELECT subject, fact AS chosen_value, {_RANK} AS source_rank, quote_id AS chosen_id,
        row_number() OVER (PARTITION BY subject ORDER BY {_RANK}, ts DESC, quote_id DESC) AS n FROM q) t
    JOIN (SELECT subject, count(DISTINCT fact) AS n_values, count(*) AS n_reports FROM q GROUP BY subject) c USING (subject)
    WHERE n = 1"""))
def source_reconciliation(spark, sf_dir):
    rows = v.view(spark, sf_dir, v.quotes(v.SPARK))
    chosen, _ = snapshots.reconcile(rows, ["subject"], value="fact", source="source", time="ts", tiebreak="quote_id")
    return chosen


@query("source_conflicts", over({"q": v.quotes}, """
    SELECT subject, fact, source, count(*) AS n_reports FROM q
    WHERE subject IN (SELECT subject FROM q GROUP BY subject HAVING count(DISTINCT fact) > 1)
    GROUP BY subject, fact, source"""))
def source_conflicts(spark, sf_dir):
    rows = v.view(spark, sf_dir, v.quotes(v.SPARK))
    _, conflicts = snapshots.reconcile(rows, ["subject"], value="fact", source="source", time="ts", tiebreak="quote_id")
    return conflicts.select("subject", "fact", "source", "n_reports")
