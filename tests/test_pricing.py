import math

import pytest
from pyspark.sql import functions as F

from linewright.functions import pricing, stats


def values(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_golden_scalars(spark):
    lit = F.lit
    got = values(
        spark,
        fair=pricing.no_vig_array(F.array(lit(2.10), lit(1.75)))[0],
        margin=pricing.overround(F.array(lit(2.10), lit(1.75))),
        ev=pricing.expected_value(lit(0.51), lit(2.10)),
        least_odds=pricing.minimum_odds(lit(0.51), lit(0.03)),
        least_p=pricing.minimum_probability(lit(2.10), lit(0.03)),
        shrunk=pricing.shrunk_probability(lit(0.51), lit(0.4545454545454546), lit(0.85)),
        kelly=pricing.full_kelly(lit(0.5016818181818182), lit(2.10)),
        none=pricing.full_kelly(lit(0.45), lit(2.00)),
        clv=pricing.price_clv(lit(2.30), lit(2.10)),
        raw=pricing.raw_clv(lit(2.30), lit(2.10)),
        push=pricing.expected_value_with_push(lit(0.5), lit(1.9), lit(0.1)),
    )
    expected = {
        "fair": 0.4545454545454546, "margin": 0.04761904761904767, "ev": 0.071, "least_odds": 1.03 / 0.51, "least_p": 1.03 / 2.10,
        "shrunk": 0.5016818181818182, "kelly": 0.048665289256198445, "none": 0.0, "clv": 2.30 / 2.10 - 1,
        "raw": 1 / 2.10 - 1 / 2.30, "push": 0.05,
    }
    assert got == pytest.approx(expected, abs=1e-12)


def test_out_of_domain_is_null_and_named(spark):
    lit = F.lit
    got = values(
        spark, a=pricing.implied_probability(lit(1.0)), b=pricing.expected_value(lit(1.2), lit(2.0)),
        c=pricing.no_vig_array(F.array(lit(2.0))), d=pricing.minimum_probability(lit(1.02), lit(0.03)),
        e=pricing.implied_probability(lit(float("inf"))), f=pricing.price_fault(lit(1.0)), g=pricing.probability_fault(lit(0.5)),
    )
    assert got == {"a": None, "b": None, "c": None, "d": None, "e": None, "f": "odds_not_above_one", "g": None}
    with pytest.raises(Exception, match="odds_not_above_one"):
        values(spark, x=pricing.strict(lit(1.0), pricing.price_fault(lit(0.5))))


def test_edge_status(spark):
    s = lambda p, d, m: pricing.economic_status(F.lit(p), F.lit(d), F.lit(m), F.lit(0.03), F.lit(0.015))
    got = values(spark, a=s(0.55, 2.2, 0.44), b=s(0.45, 2.2, 0.44), c=s(0.55, 2.2, 0.545))
    assert got == {"a": "QUALIFIES", "b": "WATCH_PRICE", "c": "PASS"}


def test_stake_floor_is_exact_and_never_up(spark):
    floor = lambda a, i: pricing.floor_to_increment(F.lit(a), F.lit(i))
    got = values(spark, a=floor(0.3, 0.1), b=floor(237.68, 1.0), c=floor(-5.0, 1.0), d=floor(1.15, 0.05), e=floor(99.9999999, 0.5))
    assert got == {"a": 0.3, "b": 237.0, "c": 0.0, "d": 1.15, "e": 99.5}


def test_bins_logit_and_sigmoid(spark):
    b = lambda p: stats.calibration_bin(F.lit(p))
    got = values(spark, a=b(0.3), b=b(0.30000000000000004), c=b(1.0), d=b(0.0), e=b(0.1))
    assert got == {"a": 2, "b": 3, "c": 9, "d": 0, "e": 1}
    z = values(spark, low=stats.sigmoid(F.lit(-800.0)), high=stats.sigmoid(F.lit(800.0)), top=stats.logit(F.lit(1.0)), bad=stats.logit(F.lit(1.5)))
    assert z["low"] == 0.0 and z["high"] == 1.0 and z["top"] == pytest.approx(math.log((1 - 1e-6) / 1e-6)) and z["bad"] is None


def test_floor_survives_zero_steps_and_large_amounts(spark):
    rows = spark.createDataFrame([(10.7, 0.0), (1e19, 0.5), (1e30, 1.0), (10.7, 0.5)], "amount double, step double")
    got = [r[0] for r in rows.select(pricing.floor_to_increment(F.col("amount"), F.col("step"))).collect()]
    assert got == [None, 1e19, None, 10.5]


def test_edge_board_survives_zero_prices(spark):
    from linewright.operators import markets

    rows = spark.createDataFrame([(0.0, 2.0, 0.5), (0.5, 0.0, 0.5)], "p double, odds double, market_p double")
    got = markets.edge_board(rows, minimum_ev=0.03, minimum_edge=0.01).collect()
    assert got[0]["break_even_odds"] is None and got[1]["edge_vs_break_even_pp"] is None
