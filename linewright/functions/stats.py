"""Probability transforms and scoring-rule terms as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linewright.fixed_values import ECE_EDGES, PROBABILITY_CLIP


def clip_probability(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(PROBABILITY_CLIP)), F.lit(1.0 - PROBABILITY_CLIP))


def logit(p: Column) -> Column:
    c = clip_probability(p)
    return F.when((p >= 0.0) & (p <= 1.0), F.ln(c / (1.0 - c)))


def sigmoid(z: Column) -> Column:
    # exp only ever sees a non-positive argument, so it cannot overflow.
    small = F.exp(-F.abs(z))
    return F.when(z >= 0, 1.0 / (1.0 + small)).otherwise(small / (1.0 + small))


def platt(raw: Column, intercept: Column, slope: Column) -> Column:
    return clip_probability(sigmoid(intercept + slope * logit(raw)))


def brier_term(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def log_loss_term(p: Column, y: Column) -> Column:
    return -(y * F.ln(p) + (1.0 - y) * F.ln(1.0 - p))


def clipped_log_loss_term(p: Column, y: Column) -> Column:
    return log_loss_term(clip_probability(p), y)


def calibration_bin(p: Column) -> Column:
    """0..9; a value on an edge goes to the bin above it."""
    count = F.lit(0)
    for e in ECE_EDGES:
        count = count + F.when(p >= F.lit(e), 1).otherwise(0)
    return count
