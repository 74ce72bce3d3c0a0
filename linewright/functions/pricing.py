"""Prices, edges and stake fractions as Column expressions.

Arguments outside their domain give NULL; ``price_fault`` / ``probability_fault``
name the fault, so callers can report instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linewright.fixed_values import OUTPUT_DECIMALS


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def valid_odds(d: Column) -> Column:
    return finite(d) & (d > 1.0)


def valid_probability(p: Column) -> Column:
    return finite(p) & (p > 0.0) & (p < 1.0)


def price_fault(d: Column) -> Column:
    return F.when(~valid_odds(d), F.lit("odds_not_above_one"))


def probability_fault(p: Column) -> Column:
    return F.when(~valid_probability(p), F.lit("probability_not_in_open_unit_interval"))


def strict(value: Column, fault: Column) -> Column:
    """Fail the job on the first fault instead of returning NULL."""
    return F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(value)


def implied_probability(d: Column) -> Column:
    return F.when(valid_odds(d), 1.0 / d)


def binary_no_vig(selected: Column, opposing: Column) -> Column:
    own, other = implied_probability(selected), implied_probability(opposing)
    return own / (own + other)


def no_vig_array(odds: Column) -> Column:
    """n-way proportional no-vig for an array of odds; NULL unless all are valid."""
    usable = (F.size(odds) >= 2) & F.forall(odds, valid_odds)
    total = F.aggregate(odds, F.lit(0.0), lambda acc, d: acc + 1.0 / d)
    return F.when(usable, F.transform(odds, lambda d: (1.0 / d) / total))


def market_sum(odds: Column) -> Column:
    usable = (F.size(odds) >= 2) & F.forall(odds, valid_odds)
    return F.when(usable, F.aggregate(odds, F.lit(0.0), lambda acc, d: acc + 1.0 / d))


def overround(odds: Column) -> Column:
    return market_sum(odds) - 1.0


def expected_value(p: Column, d: Column) -> Column:
    return F.when(valid_probability(p) & valid_odds(d), p * d - 1.0)


def expected_value_with_push(p: Column, d: Column, push: Column) -> Column:
    return p * d + push - 1.0


def minimum_odds(p: Column, target: Column) -> Column:
    return F.when(valid_probability(p) & finite(target) & (target >= 0.0), (1.0 + target) / p)


def minimum_probability(d: Column, target: Column) -> Column:
    needed = (1.0 + target) / d
    return F.when(valid_odds(d) & finite(target) & (target >= 0.0) & (needed < 1.0), needed)


def edge(p: Column, baseline: Column) -> Column:
    return p - baseline


def full_kelly(p: Column, d: Column) -> Column:
    return F.when(
        valid_probability(p) & valid_odds(d), F.greatest(F.lit(0.0), (p * d - 1.0) / (d - 1.0))
    )


def shrunk_probability(p: Column, market: Column, weight: Column) -> Column:
    usable = valid_probability(p) & valid_probability(market) & finite(weight) & weight.between(0.0, 1.0)
    return F.when(usable, market + weight * (p - market))


def economic_status(p: Column, d: Column, market: Column, minimum_ev: Column, minimum_edge: Column) -> Column:
    """QUALIFIES, WATCH_PRICE (only the price is short) or PASS."""
    usable = valid_odds(d) & valid_probability(p) & valid_probability(market)
    qualifies = (p * d - 1.0 >= minimum_ev) & (p - market >= minimum_edge)
    short = d < (1.0 + minimum_ev) / p
    return F.when(
        usable, F.when(qualifies, "QUALIFIES").when(short, "WATCH_PRICE").otherwise("PASS")
    )


def raw_clv(taken: Column, closing: Column) -> Column:
    return implied_probability(closing) - implied_probability(taken)


def price_clv(taken: Column, closing: Column) -> Column:
    return F.when(valid_odds(taken) & valid_odds(closing), taken / closing - 1.0)


def no_vig_clv(entry: Column, closing: Column) -> Column:
    return closing - entry


def probability_clv(closing_no_vig: Column, taken: Column) -> Column:
    return closing_no_vig - implied_probability(taken)


def output_round(x: Column) -> Column:
    return F.bround(x, OUTPUT_DECIMALS)


def floor_to_increment(amount: Column, increment: Column) -> Column:
    """Exact decimal floor to a multiple of ``increment``; never rounds up.

    NULL for an increment of zero and for amounts that 26 digits before the point cannot hold.
    """
    # Remainders of decimals are exact; quotients would be rounded to a shorter scale.
    exact = F.greatest(amount, F.lit(0.0)).cast("string").try_cast("decimal(38,12)")
    step = increment.cast("string").try_cast("decimal(38,12)")
    return (exact - F.try_mod(exact, step)).cast("double")


def floor_to_increment_float(amount: Column, increment: Column) -> Column:
    floored = F.floor(F.try_divide(amount, increment)) * increment
    return F.when(increment > 0, floored).otherwise(amount)
