"""Platt scaling: one fit over everything, and one fit per row over its past.

The score of a row is the logit of its raw probability, which is clipped and so
lies in a fixed range. A logistic fit only needs sums of smooth functions of the
score. Cutting the range into equal intervals and keeping, per interval, the
sums of the first Chebyshev polynomials, gives those sums for any coefficients
to about twelve digits as long as the slope stays small against the interval
(``_REACH``); steeper fits are repeated on finer intervals until it does. The
sums add up, so a past of any length is a bounded state: this is what lets every
row have its own exact fit without revisiting its past.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright import fixed_values as fixed
from linewright.functions import stats
from linewright.functions.ordered import attach, ordered_scan
from linewright.session import cut_lineage

_LIMIT = math.log((1 - fixed.PROBABILITY_CLIP) / fixed.PROBABILITY_CLIP)
_ORDER = 12
_REACH = 0.65
_INTERVALS = 64
# Finest intervals; a fit still too steep for them counts as not converged.
_FINEST = _INTERVALS * 8**5
# Last Newton step, relative, at which a fit counts as converged.
_SETTLED = 1e-6
_EXACT_ROWS = 1_000
_CHUNK = 256
# Numbers in one array of a fit on intervals: with many occupied intervals fewer rows are fitted at a time.
_HELD = 1 << 18
_MOMENTS = [f"t{k}" for k in range(_ORDER)]
_ANGLES = (np.arange(_ORDER) + 0.5) * math.pi / _ORDER
# Sums of polynomials -> weights on the nodes.
_TO_WEIGHTS = np.array([
    [(1 if k == 0 else 2) / _ORDER * math.cos(k * a) for a in _ANGLES] for k in range(_ORDER)
])


def _half_width(intervals: int) -> float:
    return _LIMIT / intervals


def _nodes(cells: np.ndarray, intervals: int) -> np.ndarray:
    half = _half_width(intervals)
    return (-_LIMIT + half * (2 * cells[:, None] + 1 + np.cos(_ANGLES)[None, :])).ravel()


def _moment_columns(score: str, intervals: int) -> dict:
    half = _half_width(intervals)
    place = (F.col(score) + _LIMIT) / (2 * half)
    cell = F.least(F.greatest(F.floor(place), F.lit(0)), F.lit(intervals - 1)).cast("long")
    inside = F.least(F.greatest(2 * (place - F.col("_cell")) - 1, F.lit(-1.0)), F.lit(1.0))
    return {"_cell": cell, "_angle": F.acos(inside)}


def _with_cells(df: DataFrame, score: str, intervals: int) -> DataFrame:
    columns = _moment_columns(score, intervals)
    return df.withColumn("_cell", columns["_cell"]).withColumn("_angle", columns["_angle"])


def _cell_sums(score: str, outcome: str) -> list:
    y = F.col(outcome).cast("double")
    return [F.sum(y).alias("sy"), F.sum(y * F.col(score)).alias("sxy")] + [
        F.sum(F.cos(F.lit(float(k)) * F.col("_angle"))).alias(name) for k, name in enumerate(_MOMENTS)
    ]


def _fit_rows(x: np.ndarray, w: np.ndarray, sy: np.ndarray, sxy: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Penalised logistic fits, one per row of ``w``, by Newton steps with halving; and which of them converged."""
    penalty = 1.0 / fixed.PLATT_INVERSE_PENALTY
    beta = start.copy()

    def parts(b, rows):
        z = b[:, :1] + b[:, 1:] * x[None, :]
        e = np.exp(-np.abs(z))
        p = np.where(z >= 0, 1.0, e) / (1.0 + e)
        loss = (w[rows] * (np.maximum(z, 0) + np.log1p(e))).sum(1) - b[:, 0] * sy[rows] - b[:, 1] * sxy[rows]
        return p, loss + 0.5 * penalty * b[:, 1] ** 2

    active = np.arange(len(beta))
    size = np.zeros(len(beta))
    p, loss = parts(beta, active)
    for _ in range(200):
        if not len(active):
            break
        b, wa = beta[active], w[active]
        wp = wa * p
        q = wp * (1 - p)
        g0, g1 = wp.sum(1) - sy[active], (wp @ x) - sxy[active] + penalty * b[:, 1]
        h00, h01, h11 = q.sum(1), q @ x, q @ (x * x) + penalty
        det = np.maximum(h00 * h11 - h01 * h01, 1e-300)
        step = np.stack([-(h11 * g0 - h01 * g1) / det, -(h00 * g1 - h01 * g0) / det], axis=1)
        shrink = np.ones(len(active))
        new_p, new_loss = parts(b + step, active)
        for _ in range(40):
            worse = ~(new_loss <= loss + 1e-11 * (1 + np.abs(loss)))
            if not worse.any():
                break
            shrink[worse] *= 0.5
            new_p[worse], new_loss[worse] = parts((b + shrink[:, None] * step)[worse], active[worse])
        moved = shrink[:, None] * step
        beta[active] = b + moved
        size[active] = np.abs(moved).max(1) / (1 + np.abs(beta[active]).max(1))
        still = size[active] > 1e-11
        active, p, loss = active[still], new_p[still], new_loss[still]
    return beta, np.isfinite(beta).all(1) & (size <= _SETTLED)


def _together(points: int) -> int:
    """Rows that are fitted at a time on so many points."""
    return min(_CHUNK, max(1, _HELD // max(1, points)))


def _start(sy: np.ndarray, n: np.ndarray) -> np.ndarray:
    rate = np.clip(sy / np.maximum(n, 1), 1e-6, 1 - 1e-6)
    return np.stack([np.log(rate / (1 - rate)), np.zeros_like(rate)], axis=1)


def platt_fit(
    df: DataFrame, group: Sequence[str], *, raw: str = "raw", outcome: str = "outcome", intervals: int = _INTERVALS
) -> DataFrame:
    """Intercept, slope, sample size, positive rate and ``converged`` per group; groups with one class are left out.

    One pass with map-side partial sums; each group is then solved from its few
    occupied intervals. Groups too steep for the intervals, and they alone, are
    fitted again on eight times as many, down to ``_FINEST``. A fit that did not
    settle has NULL coefficients and ``converged`` false.
    """
    group = list(group)
    scored = df.where(F.col(raw).isNotNull()).select(*group, stats.logit(F.col(raw)).alias("_x"), F.col(outcome).alias("_y"))
    sums = _with_cells(scored, "_x", intervals).groupBy(*group, "_cell").agg(*_cell_sums("_x", "_y"))

    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        t = cells[_MOMENTS].to_numpy()
        n, sy = t[:, 0].sum(), cells["sy"].sum()
        if sy <= 0 or sy >= n:
            return pd.DataFrame(columns=[*group, *names])
        x = _nodes(cells["_cell"].to_numpy(), intervals)
        w = (t @ _TO_WEIGHTS).reshape(1, -1)
        one = np.array([sy])
        fits, settled = _fit_rows(x, w, one, np.array([cells["sxy"].sum()]), _start(one, np.array([n])))
        beta = fits[0] if settled[0] else (None, None)
        row = {g: cells[g].iloc[0] for g in group}
        return pd.DataFrame([row | dict(zip(names, [beta[0], beta[1], int(round(n)), sy / n, bool(settled[0])]))])

    names = ["intercept", "coefficient", "training_sample_size", "positive_rate", "converged"]
    types = [T.DoubleType(), T.DoubleType(), T.LongType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*[df.schema[g] for g in group], *[T.StructField(n, t) for n, t in zip(names, types)]])
    fitted = cut_lineage(sums.groupBy(*group).applyInPandas(solve, schema))
    too_steep = ~F.col("converged") | (F.abs("coefficient") * _half_width(intervals) > _REACH)
    steep = fitted.where(too_steep).select(*group)
    if steep.isEmpty():
        return fitted
    if intervals >= _FINEST:
        unsettled = {c: F.when(~too_steep, F.col(c)) for c in ("intercept", "coefficient")}
        return fitted.withColumns({**unsettled, "converged": ~too_steep})
    finer = platt_fit(_of_groups(df, steep, group), group, raw=raw, outcome=outcome, intervals=intervals * 8)
    return fitted.where(~too_steep).unionByName(finer)


def _of_groups(df: DataFrame, groups: DataFrame, group: list[str]) -> DataFrame:
    """The rows of ``df`` whose group is one of ``groups`` (null-safe)."""
    return attach(df, groups.withColumn("_listed", F.lit(True)), group).where("_listed").drop("_listed")


def walk_forward_platt(
    df: DataFrame, group: Sequence[str], order: Sequence[str], *, minimum_history: int, raw: str = "raw",
    outcome: str = "outcome", block_rows: int = 20_000, intervals: int = _INTERVALS,
) -> DataFrame:
    """Calibrate row i by a fit on rows 0..i-1 of its group.

    Adds ``calibrated``; rows with less than ``minimum_history`` rows before them,
    or only one class before them, are left out. ``converged`` is false, and
    ``calibrated`` NULL, where the fit did not settle. Rows are cut into blocks by
    position; each block starts from the summed state of all earlier blocks. Only
    groups with a fit too steep for the intervals are fitted again on finer ones.
    """
    group = list(group)
    indexed = ordered_scan(df.where(F.col(raw).isNotNull()), group, order, position="_index")
    indexed = cut_lineage(indexed.withColumn("_block", F.floor(F.col("_index") / block_rows).cast("long")))
    slim = indexed.select(*group, "_block", "_index", stats.logit(F.col(raw)).alias("_x"), F.col(outcome).cast("double").alias("_y"))
    fits = _block_fits(slim, group, minimum_history, intervals)
    done = None
    while True:
        reach = fits.groupBy(*group).agg(F.max("_reach").alias("_reach"))
        steep = cut_lineage(reach.where(F.col("_reach") > _REACH).select(*group))
        if intervals >= _FINEST or steep.isEmpty():
            break
        settled = attach(fits, steep.withColumn("_listed", F.lit(True)), group).where("_listed IS NULL").drop("_listed")
        done = settled if done is None else done.unionByName(settled)
        intervals *= 8
        slim = cut_lineage(_of_groups(slim, steep, group))
        fits = _block_fits(slim, group, minimum_history, intervals)
    fits = fits if done is None else done.unionByName(fits)
    fits = fits.withColumn("converged", F.col("converged") & (F.col("_reach") <= _REACH)).drop("_reach")
    joined = attach(indexed, fits, [*group, "_index"]).where(F.col("converged").isNotNull())
    calibrated = F.when(F.col("converged"), stats.platt(F.col(raw), F.col("_intercept"), F.col("_slope")))
    return joined.withColumn("calibrated", calibrated).drop("_index", "_block", "_intercept", "_slope")


def _block_fits(slim: DataFrame, group: list[str], minimum_history: int, intervals: int) -> DataFrame:
    cells = _with_cells(slim, "_x", intervals).groupBy(*group, "_block", "_cell").agg(*_cell_sums("_x", "_y"))
    last = slim.groupBy(*group).agg(F.max("_block").alias("_last"))
    grid = attach(cells.select(*group, "_cell").distinct(), last, group).select(
        *group, "_cell", F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("_block")
    )
    names = ["sy", "sxy", *_MOMENTS]
    earlier = Window.partitionBy(*group, "_cell").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    state = (
        attach(grid, cells, [*group, "_block", "_cell"])
        .select(*group, "_block", "_cell", *[F.sum(n).over(earlier).alias(n) for n in names])
        .where(F.col("t0").isNotNull())
    )
    # Both sides stem from the same rows; new names keep the grouping columns apart.
    state = state.toDF(*state.columns)
    half = _half_width(intervals)

    def fit_block(key, rows: pd.DataFrame, past: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_index")
        index, x, y = rows["_index"].to_numpy(), rows["_x"].to_numpy(), rows["_y"].to_numpy()
        first = index[0] if len(index) else 0
        place = np.clip(np.floor((x + _LIMIT) / (2 * half)), 0, intervals - 1).astype(np.int64)
        used = np.union1d(place, past["_cell"].to_numpy(np.int64))
        base = np.zeros((len(used), _ORDER))
        if len(past):
            base[np.searchsorted(used, past["_cell"].to_numpy())] = past[_MOMENTS].to_numpy()
        slot = np.searchsorted(used, place)
        inside = np.clip((x + _LIMIT) / half - 2 * place - 1, -1, 1)
        local = np.cos(np.arange(_ORDER)[None, :] * np.arccos(inside)[:, None])
        sy_before = past["sy"].sum() + np.concatenate([[0.0], np.cumsum(y)[:-1]])
        sxy_before = past["sxy"].sum() + np.concatenate([[0.0], np.cumsum(x * y)[:-1]])
        nodes = _nodes(used, intervals)
        out = np.full((len(index), 2), np.nan)
        fitted, settled = np.zeros(len(index), bool), np.zeros(len(index), bool)
        reach = np.zeros(len(index))
        start = None
        hi, together = 0, _together(len(nodes))
        while hi < len(index):
            lo, hi = hi, min(hi + _CHUNK, len(index))
            exact = first == 0 and hi <= _EXACT_ROWS + _CHUNK
            hi = hi if exact else min(lo + together, len(index))
            span = np.arange(lo, hi)
            n = index[span].astype(float)
            ok = (n >= minimum_history) & (sy_before[span] > 0) & (sy_before[span] < n)
            if ok.any():
                pick = span[ok]
                if exact:
                    points = x[:hi]
                    w = (np.arange(hi)[None, :] < pick[:, None]).astype(float)
                else:
                    points = nodes
                    grown = np.zeros((hi - lo, len(used), _ORDER))
                    grown[np.arange(1, hi - lo), slot[lo : hi - 1]] = local[lo : hi - 1]
                    w = ((base[None] + np.cumsum(grown, axis=0))[ok] @ _TO_WEIGHTS).reshape(len(pick), -1)
                begin = _start(sy_before[pick], n[ok]) if start is None else np.repeat(start[None], len(pick), axis=0)
                out[pick], settled[pick] = _fit_rows(points, w, sy_before[pick], sxy_before[pick], begin)
                fitted[pick] = True
                start = out[pick[-1]] if settled[pick[-1]] else None
                if not exact:
                    reach[pick] = np.where(settled[pick], np.abs(out[pick, 1]) * half, np.inf)
            np.add.at(base, slot[lo:hi], local[lo:hi])
        result = pd.DataFrame({"_index": index, "_intercept": out[:, 0], "_slope": out[:, 1], "_reach": reach, "converged": settled})
        for place_, name in enumerate(group):
            result.insert(place_, name, key[place_])
        return result[fitted]

    fields = [*[slim.schema[g] for g in group], T.StructField("_index", T.LongType())]
    fields += [T.StructField(n, T.DoubleType()) for n in ("_intercept", "_slope", "_reach")]
    fields.append(T.StructField("converged", T.BooleanType()))
    fits = slim.groupBy(*group, "_block").cogroup(state.groupBy(*group, "_block")).applyInPandas(fit_block, T.StructType(fields))
    return cut_lineage(fits)
