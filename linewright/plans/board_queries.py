"""No-vig boards, edges, thresholds and stake fractions."""

from pyspark.sql import functions as F

from linewright.functions import pricing
from linewright.operators import markets
from linewright.plans import views as v
from linewright.plans.registry import over, query, r, rounded

_BOARD = """SELECT market_id, count(*) AS n_outcomes, sum(1e0 / decimal_odds) AS market_sum
            FROM o GROUP BY market_id HAVING count(*) >= 2"""


@query("novig_board", over({"o": v.outcomes}, f"""
    SELECT o.market_id, o.selection, o.decimal_odds, m.n_outcomes,
           {r('1e0 / decimal_odds AS raw_implied', 'market_sum AS market_sum', 'market_sum - 1 AS overround',
              '1e0 / decimal_odds / market_sum AS no_vig_probability')}
    FROM o JOIN ({_BOARD}) m ON o.market_id = m.market_id"""))
def novig_board(spark, sf_dir):
    board = markets.no_vig_board(v.view(spark, sf_dir, v.outcomes(v.SPARK)), ["market_id"])
    return rounded(board, "raw_implied", "market_sum", "overround", "no_vig_probability").select(
        "market_id", "selection", "decimal_odds", "n_outcomes", "raw_implied", "market_sum", "overround", "no_vig_probability"
    )


@query("overround_by_book", over({"o": v.outcomes}, f"""
    SELECT book, count(*) AS n_markets, {r('avg(s) AS avg_market_sum', 'avg(s - 1) AS avg_overround')}
    FROM (SELECT book, market_id, sum(1e0 / decimal_odds) AS s FROM o GROUP BY book, market_id HAVING count(*) >= 2) t
    GROUP BY book"""))
def overround_by_book(spark, sf_dir):
    rows = markets.overround_by(v.view(spark, sf_dir, v.outcomes(v.SPARK)), ["book", "market_id"], "book")
    return rounded(rows, "avg_market_sum", "avg_overround")


@query("binary_no_vig", over({"c": v.priced}, f"""
    SELECT candidate_id, {r('1e0 / odds / (1e0 / odds + 1e0 / opposing_odds) AS no_vig_probability',
                            '1e0 / odds + 1e0 / opposing_odds - 1 AS overround')}
    FROM c WHERE odds > 1 AND opposing_odds > 1"""))
def binary_no_vig(spark, sf_dir):
    d, e = F.col("odds"), F.col("opposing_odds")
    rows = v.view(spark, sf_dir, v.priced(v.SPARK)).select(
        "candidate_id", pricing.binary_no_vig(d, e).alias("no_vig_probability"),
        pricing.overround(F.array(d, e)).alias("overround"),
    )
    return rounded(rows, "no_vig_probability", "overround")


@query("edge_board", over({"c": v.priced}, f"""
    SELECT candidate_id, {r('1 / odds AS break_even_probability', 'p * odds - 1 AS ev', 'p - 1 / odds AS edge_vs_break_even_pp',
      'p - market_p AS edge_vs_market_pp', 'greatest(0, (p * odds - 1) / (odds - 1)) AS full_kelly', '1 / p AS break_even_odds',
      '1.03e0 / p AS minimum_qualifying_odds')},
      CASE WHEN p * odds - 1 >= 3e-2 AND p - market_p >= 15e-3 THEN 'QUALIFIES'
           WHEN odds < (1 + 3e-2) / p THEN 'WATCH_PRICE' ELSE 'PASS' END AS economic_status
    FROM c"""))
def edge_board(spark, sf_dir):
    board = markets.edge_board(v.view(spark, sf_dir, v.priced(v.SPARK)), minimum_ev=0.03, minimum_edge=0.015)
    numbers = [
        "break_even_probability", "ev", "edge_vs_break_even_pp", "edge_vs_market_pp", "full_kelly",
        "break_even_odds", "minimum_qualifying_odds",
    ]
    return rounded(board, *numbers).select("candidate_id", *numbers, "economic_status")


@query("price_thresholds", over({"c": v.priced}, f"""
    SELECT candidate_id, {r('(1 + target_ev) / p AS minimum_odds')},
      CASE WHEN (1 + target_ev) / odds < 1 THEN round((1 + target_ev) / odds, 9) END AS minimum_probability
    FROM c"""))
def price_thresholds(spark, sf_dir):
    t = F.col("target_ev")
    rows = v.view(spark, sf_dir, v.priced(v.SPARK)).select(
        "candidate_id", pricing.minimum_odds(F.col("p"), t).alias("minimum_odds"),
        pricing.minimum_probability(F.col("odds"), t).alias("minimum_probability"),
    )
    return rounded(rows, "minimum_odds", "minimum_probability")


@query("kelly_board", over({"c": v.priced}, f"""
    SELECT candidate_id, {r('greatest(0, (p * odds - 1) / (odds - 1)) AS full_kelly',
      'p * odds + (1 - p) / 10 - 1 AS ev_with_push')} FROM c"""))
def kelly_board(spark, sf_dir):
    p, d = F.col("p"), F.col("odds")
    rows = v.view(spark, sf_dir, v.priced(v.SPARK)).select(
        "candidate_id", pricing.full_kelly(p, d).alias("full_kelly"),
        pricing.expected_value_with_push(p, d, (1 - p) / 10).alias("ev_with_push"),
    )
    return rounded(rows, "full_kelly", "ev_with_push")


@query("shrinkage_board", over({"c": v.priced}, f"""
    SELECT candidate_id, {r('market_p + weight * (p - market_p) AS sizing_probability',
      'greatest(0, ((market_p + weight * (p - market_p)) * odds - 1) / (odds - 1)) AS sized_kelly')} FROM c"""))
def shrinkage_board(spark, sf_dir):
    sized = pricing.shrunk_probability(F.col("p"), F.col("market_p"), F.col("weight"))
    rows = v.view(spark, sf_dir, v.priced(v.SPARK)).withColumn("sizing_probability", sized).select(
        "candidate_id", "sizing_probability",
        pricing.full_kelly(F.col("sizing_probability"), F.col("odds")).alias("sized_kelly"),
    )
    return rounded(rows, "sizing_probability", "sized_kelly")


@query("argument_guards", over({"o": v.outcomes, "c": v.priced}, """
    SELECT coalesce(price_fault, 'none') AS price_fault, coalesce(probability_fault, 'none') AS probability_fault, count(*) AS n
    FROM (SELECT CASE WHEN odds - 5e-1 <= 1 THEN 'odds_not_above_one' END AS price_fault,
                 CASE WHEN p * 12e-1 >= 1 OR p <= 0 THEN 'probability_not_in_open_unit_interval' END AS probability_fault FROM c) t
    GROUP BY 1, 2"""))
def argument_guards(spark, sf_dir):
    rows = v.view(spark, sf_dir, v.priced(v.SPARK)).select(
        F.coalesce(pricing.price_fault(F.col("odds") - 0.5), F.lit("none")).alias("price_fault"),
        F.coalesce(pricing.probability_fault(F.col("p") * 1.2), F.lit("none")).alias("probability_fault"),
    )
    return rows.groupBy("price_fault", "probability_fault").agg(F.count(F.lit(1)).alias("n"))
