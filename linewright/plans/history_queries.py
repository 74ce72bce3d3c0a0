"""Walk-forward predictions, residual pricing, calibration and exact-line scores."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from linewright import fixed_values as fixed
from linewright.functions.moments import zoned_instant
from linewright.operators import calibration, history, metrics, scoring
from linewright.plans import fitting
from linewright.plans import views as v
from linewright.plans.registry import over, query, r, rounded
from linewright.session import cut_lineage

CONFIG = history.WalkForward(
    min_train_size=20, test_size=10, min_residual_history=20, min_calibration_history=30, minimum_validation_sample=100
)


def series(spark, sf_dir):
    return history.with_position(v.view(spark, sf_dir, v.history(v.SPARK)), ["grp"], ["ts", "event_id"])


def predicted(spark, sf_dir):
    return history.walk_forward_linear(series(spark, sf_dir), ["grp"], ["x"], CONFIG)


def priced(spark, sf_dir):
    return history.priced_history(predicted(spark, sf_dir), ["grp"], CONFIG)


# ---- the same steps as SQL ----------------------------------------------------------------------------

_POS = "SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts, event_id) - 1 AS pos FROM h"
_FOLD = f"""SELECT *, CASE WHEN pos < {CONFIG.min_train_size} THEN -1 ELSE CAST(floor((pos - {CONFIG.min_train_size}) / {CONFIG.test_size}e0) AS BIGINT) END AS fold FROM ({_POS}) p"""
_FITTED = f"""SELECT *, first_value(s) OVER f AS slope, first_value(i) OVER f AS base FROM (
    SELECT *, regr_slope(y, x) OVER w AS s, regr_intercept(y, x) OVER w AS i FROM ({_FOLD}) q
    WINDOW w AS (PARTITION BY grp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) z
    WINDOW f AS (PARTITION BY grp, fold ORDER BY pos)"""
_PREDICTED = f"pred AS (SELECT *, CASE WHEN fold >= 0 THEN base + slope * x END AS prediction FROM ({_FITTED}) t)"
_OOS = f", oos AS (SELECT *, pos - {CONFIG.min_train_size} AS n, y - prediction AS residual, line - prediction AS threshold FROM pred WHERE fold >= 0)"
_COUNTED = f"""
    , counted AS (SELECT a.grp, a.pos, sum(CASE WHEN b.residual > a.threshold + 1e-12 THEN 1 ELSE 0 END) AS o,
        sum(CASE WHEN b.residual < a.threshold - 1e-12 THEN 1 ELSE 0 END) AS u
      FROM oos a JOIN oos b ON a.grp = b.grp AND b.n < a.n WHERE a.n >= {CONFIG.min_residual_history} GROUP BY a.grp, a.pos)
    , priced AS (SELECT oos.grp, oos.pos, oos.n AS residual_n, o / CAST(oos.n AS DOUBLE) AS "over", u / CAST(oos.n AS DOUBLE) AS "under", (oos.n - o - u) / CAST(oos.n AS DOUBLE) AS push,
        CASE WHEN o + u > 0 THEN o / CAST(o + u AS DOUBLE) END AS raw, CASE WHEN y > line THEN 1 ELSE 0 END AS outcome,
        1 / over_odds / (1 / over_odds + 1 / under_odds) AS market_p FROM oos JOIN counted USING (grp, pos) WHERE abs(y - line) > 1e-12)"""


def _newton(source: str, keys: str, name: str, steps: int, data: str = "") -> str:
    """Unrolled Newton steps of a penalised logistic fit; ``source`` has keys, sx, sy."""
    same = " AND ".join(f"d.{k} = c.{k}" for k in keys.split(", "))
    lead = ", ".join(f"d.{k}" for k in keys.split(", "))
    ctes = f", {name}0 AS (SELECT {keys}, ln(avg(sy) / (1 - avg(sy))) AS a, 0e0 AS b FROM {source} GROUP BY {keys} HAVING min(sy) < max(sy))"
    for k in range(steps):
        ctes += f""", {name}{k + 1} AS (
          SELECT {keys}, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM (
            SELECT {lead}, a, b, sum(q - sy) AS g0, sum((q - sy) * sx) + b / {fixed.PLATT_INVERSE_PENALTY:e} AS g1,
              sum(q * (1 - q)) AS h00, sum(q * (1 - q) * sx) AS h01, sum(q * (1 - q) * sx * sx) + 1 / {fixed.PLATT_INVERSE_PENALTY:e} AS h11
            FROM (SELECT d.*, c.a, c.b, 1 / (1 + exp(-(c.a + c.b * d.sx))) AS q FROM {source} d JOIN {name}{k} c ON {same}) d
            GROUP BY {lead}, a, b) s)"""
    return ctes


def _logit(p: str) -> str:
    clipped = f"least(greatest({p}, 1e-6), 1 - 1e-6)"
    return f"ln({clipped} / (1 - {clipped}))"


# ---- queries ------------------------------------------------------------------------------------------


# Times as text, on hours so that there are breaks to find; every 47th event's text has no zone.
_HOUR_TEXT = {d.name: f"concat(substring({d.iso('ts')}, 1, 13), ':00:00', CASE WHEN event_id % 47 = 0 THEN '' ELSE 'Z' END)" for d in (v.SPARK, v.DUCK)}


def timed_by_text(rows):
    """``rows`` with ``instant``, read from the text as the training source reads it."""
    return rows.withColumn("instant", zoned_instant(F.expr(_HOUR_TEXT["spark"])))


@query("chronology_check", over({"h": v.history}, f"""
    SELECT grp, event_id, pos FROM (SELECT *, lag(user_time) OVER (PARTITION BY grp ORDER BY pos) AS previous
      FROM (SELECT *, CASE WHEN event_id % 47 <> 0 THEN date_trunc('hour', ts) END AS user_time FROM ({_POS}) p) a) b WHERE user_time IS NULL OR user_time <= previous"""))
def chronology_check(spark, sf_dir):
    """Hours that do not increase, and times without a zone."""
    return history.chronology_breaks(timed_by_text(series(spark, sf_dir)), ["grp"], ["pos"], "instant").select("grp", "event_id", "pos")


@query("training_faults", over({"h": v.history}, """
    SELECT grp, count(*) AS n, CAST(0 AS BIGINT) AS not_finite, count(*) FILTER (WHERE over_odds <= 1 OR under_odds <= 1) AS bad_odds,
      count(*) FILTER (WHERE event_id % 47 = 0) AS no_instant,
      count(*) >= 3 AND count(*) FILTER (WHERE over_odds <= 1 OR under_odds <= 1 OR event_id % 47 = 0) = 0 AS usable FROM h GROUP BY grp"""))
def training_faults(spark, sf_dir):
    return history.training_faults(timed_by_text(v.view(spark, sf_dir, v.history(v.SPARK))), ["grp"], ["x"], time="instant")


@query("walk_forward_linear", over({"h": v.history}, f"""
    , {_PREDICTED} SELECT grp, event_id, pos, fold, round(prediction, 6) AS prediction FROM pred"""))
def walk_forward_linear(spark, sf_dir):
    return predicted(spark, sf_dir).select("grp", "event_id", "pos", "fold", F.round("prediction", 6).alias("prediction"))


@query("residual_prefix_cdf", over({"h": v.history}, f"""
    , {_PREDICTED}{_OOS}{_COUNTED} SELECT grp, pos, residual_n, {r('"over" AS over_share', '"under" AS under_share', 'push AS push_share', 'raw AS raw', 'market_p AS market_p')}, outcome FROM priced"""))
def residual_prefix_cdf(spark, sf_dir):
    rows = priced(spark, sf_dir).select(
        "grp", "pos", "residual_n", F.col("over").alias("over_share"), F.col("under").alias("under_share"),
        F.col("push").alias("push_share"), "raw", "market_p", "outcome",
    )
    return rounded(rows, "over_share", "under_share", "push_share", "raw", "market_p")


@query("line_probability", over({"h": v.history}, f"""
    , {_PREDICTED}{_OOS}
    SELECT a.grp, a.event_id, count(*) AS residual_n, {r('avg(CASE WHEN b.residual > a.threshold + 1e-12 THEN 1e0 ELSE 0e0 END) AS over_share',
      'avg(CASE WHEN b.residual < a.threshold - 1e-12 THEN 1e0 ELSE 0e0 END) AS under_share')}
    FROM oos a JOIN oos b ON a.grp = b.grp GROUP BY a.grp, a.event_id, a.threshold"""))
def line_probability(spark, sf_dir):
    rows = cut_lineage(predicted(spark, sf_dir).where("prediction IS NOT NULL"))
    residuals = rows.select("grp", (F.col("y") - F.col("prediction")).alias("residual"))
    out = scoring.line_probability(rows.select("grp", "event_id", "prediction", "line"), residuals, ["grp"], "event_id")
    return rounded(
        out.select("grp", "event_id", "residual_n", F.col("over").alias("over_share"), F.col("under").alias("under_share")),
        "over_share", "under_share",
    )


_SCORED = f", d AS (SELECT segment, {_logit('p')} AS sx, CAST(y AS DOUBLE) AS sy FROM s)"


@query("platt_fit", over({"s": v.scored}, f"""
    {_SCORED}{_newton('d', 'segment', 'n', 10)}
    SELECT segment, round(a, 6) AS intercept, round(b, 6) AS coefficient, count(*) AS training_sample_size, round(avg(sy), 6) AS positive_rate
    FROM n10 JOIN d USING (segment) GROUP BY segment, a, b"""))
def platt_fit(spark, sf_dir):
    fits = calibration.platt_fit(v.view(spark, sf_dir, v.scored(v.SPARK)), ["segment"], raw="p", outcome="y")
    return fits.drop("converged").withColumns({c: F.round(c, 6) for c in ("intercept", "coefficient", "positive_rate")})


_WALKED = f"""
    , k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pos) - 1 AS i, {_logit('raw')} AS x1 FROM priced WHERE raw IS NOT NULL)
    , d AS (SELECT a.grp, a.i, b.x1 AS sx, CAST(b.outcome AS DOUBLE) AS sy FROM k a JOIN k b ON a.grp = b.grp AND b.i < a.i WHERE a.i >= {CONFIG.min_calibration_history})
    {_newton('d', 'grp, i', 'n', 10)}
    , walked AS (SELECT k.grp, k.pos, k.market_p, k.outcome, least(greatest(1 / (1 + exp(-(a + b * x1))), 1e-6), 1 - 1e-6) AS calibrated FROM k JOIN n10 USING (grp, i))"""


@query("walk_forward_platt", over({"h": v.history}, f"""
    , {_PREDICTED}{_OOS}{_COUNTED}{_WALKED} SELECT grp, pos, outcome, round(calibrated, 6) AS calibrated FROM walked"""))
def walk_forward_platt(spark, sf_dir):
    rows = calibration.walk_forward_platt(
        priced(spark, sf_dir), ["grp"], ["pos"], minimum_history=CONFIG.min_calibration_history
    )
    return rows.select("grp", "pos", "outcome", F.round("calibrated", 6).alias("calibrated"))


@query("exact_line_scores", over({"h": v.history}, f"""
    , {_PREDICTED}{_OOS}{_COUNTED}
    , d AS (SELECT grp, {_logit('raw')} AS sx, CAST(outcome AS DOUBLE) AS sy FROM priced WHERE raw IS NOT NULL)
    {_newton('d', 'grp', 'n', 10)}
    , final AS (SELECT grp, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM h GROUP BY grp)
    , asked AS (SELECT h.grp, event_id, i + s * x AS point, line, line - (i + s * x) AS threshold, over_odds, under_odds, event_id % 2 = 0 AS is_over FROM h JOIN final ON h.grp = final.grp)
    , shares AS (SELECT q.grp, q.event_id, q.is_over, q.over_odds, q.under_odds, count(*) AS n, sum(CASE WHEN o.residual > q.threshold + 1e-12 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS po,
        sum(CASE WHEN o.residual < q.threshold - 1e-12 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS pu
      FROM asked q JOIN oos o ON q.grp = o.grp GROUP BY 1, 2, 3, 4, 5)
    , calibrated AS (SELECT *, po + pu AS live, least(greatest(1 / (1 + exp(-(a + b * {_logit('po / (po + pu)')}))), 1e-6), 1 - 1e-6) AS c FROM shares JOIN n10 USING (grp))
    , sided AS (SELECT *, CASE WHEN is_over THEN po ELSE pu END AS sr, CASE WHEN is_over THEN live * c ELSE live * (1 - c) END AS sc,
        CASE WHEN is_over THEN over_odds ELSE under_odds END AS o1, CASE WHEN is_over THEN under_odds ELSE over_odds END AS o2 FROM calibrated)
    SELECT grp, event_id, round(sr, 6) AS selected_raw, round(sc, 6) AS selected_calibrated, round(1 - live, 6) AS push,
      round(sc - 1 / o1 / (1 / o1 + 1 / o2), 6) AS edge_probability_points, round(sc * o1 + (1 - live) - 1, 6) AS expected_value_with_push FROM sided"""))
def exact_line_scores(spark, sf_dir):
    rows = cut_lineage(predicted(spark, sf_dir))
    sample = rows.where("prediction IS NOT NULL").select("grp", (F.col("y") - F.col("prediction")).alias("residual"))
    calibrators = calibration.platt_fit(history.priced_history(rows, ["grp"], CONFIG), ["grp"])
    final = history.fit_linear(rows, ["grp"], ["x"])
    even = F.col("event_id") % 2 == 0
    asked = history.predict_linear(v.view(spark, sf_dir, v.history(v.SPARK)), final, ["grp"], ["x"]).select(
        "grp", "event_id", "line", "prediction", F.when(even, "over").otherwise("under").alias("selection"),
        F.when(even, F.col("over_odds")).otherwise(F.col("under_odds")).alias("odds"),
        F.when(even, F.col("under_odds")).otherwise(F.col("over_odds")).alias("opposing_odds"),
    )
    scores = scoring.exact_line_scores(scoring.line_probability(asked, sample, ["grp"], "event_id"), calibrators, ["grp"])
    numbers = ["selected_raw", "selected_calibrated", "push", "edge_probability_points", "expected_value_with_push"]
    return scores.select("grp", "event_id", *[F.round(n, 6).alias(n) for n in numbers])


@query("validation_scorecard", over({"h": v.history}, f"""
    , {_PREDICTED}{_OOS}{_COUNTED}{_WALKED}
    SELECT grp, count(*) AS sample_size, round(avg((calibrated - outcome) * (calibrated - outcome)), 6) AS model_brier_score,
      round(avg((market_p - outcome) * (market_p - outcome)), 6) AS market_brier_score,
      round(avg(-(outcome * ln(calibrated) + (1 - outcome) * ln(1 - calibrated))), 6) AS model_log_loss,
      min(pos) AS first_pos, max(pos) AS last_pos,
      CASE WHEN count(*) < {CONFIG.minimum_validation_sample} THEN 'provisional'
        WHEN avg((calibrated - outcome) * (calibrated - outcome)) < avg((market_p - outcome) * (market_p - outcome))
         AND avg(-(outcome * ln(calibrated) + (1 - outcome) * ln(1 - calibrated))) < avg(-(outcome * ln(market_p) + (1 - outcome) * ln(1 - market_p)))
        THEN 'validated' ELSE 'degraded' END AS calibration_status
    FROM walked GROUP BY grp"""))
def validation_scorecard(spark, sf_dir):
    """Out-of-sample evidence of the whole chain, with the validation window's bounds."""
    rows = cut_lineage(calibration.walk_forward_platt(
        priced(spark, sf_dir), ["grp"], ["pos"], minimum_history=CONFIG.min_calibration_history
    ))
    card = metrics.calibration_status(
        metrics.scorecard(rows, "calibrated", "market_p", "outcome", ["grp"]), CONFIG.minimum_validation_sample
    )
    bounds = rows.groupBy("grp").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    return history.attach(card, bounds, ["grp"]).select(
        "grp", "sample_size", *[F.round(c, 6).alias(c) for c in ("model_brier_score", "market_brier_score", "model_log_loss")],
        "first_pos", "last_pos", "calibration_status",
    )


_EPOCH = v.DUCK.epoch


_HOURLY, _DEAD, _SHORT = "click, hourly", "error, dead prices", "signup, short"
_SHORT_ROWS = 45


@query("fit_report", over({"h": v.history}, f"""
    , {_PREDICTED}{_OOS}{_COUNTED}{_WALKED}
    , card AS (SELECT grp, count(*) AS sample_size, round(avg((calibrated - outcome) * (calibrated - outcome)), 6) AS model_brier_score,
        {_EPOCH('min(ts)')} AS first_validated, {_EPOCH('max(ts)')} AS last_validated FROM walked JOIN pred USING (grp, pos) GROUP BY grp)
    , versions AS (
        SELECT grp, count(*) AS training_rows, {_EPOCH('max(ts)')} AS training_cutoff, CAST(NULL AS VARCHAR) AS fault FROM pred GROUP BY grp
        UNION ALL SELECT '{_HOURLY}', count(*), {_EPOCH("max(date_trunc('hour', ts))")}, 'chronology.not_increasing' FROM pred WHERE grp = 'click'
        UNION ALL SELECT '{_DEAD}', count(*), {_EPOCH('max(ts)')}, 'training.unusable' FROM pred WHERE grp = 'error'
        UNION ALL SELECT '{_SHORT}', count(*), {_EPOCH('max(ts)')}, 'history.too_few_priced' FROM pred WHERE grp = 'signup' AND pos < {_SHORT_ROWS})
    SELECT grp, training_rows, training_cutoff, fault, sample_size, model_brier_score, first_validated, last_validated FROM versions LEFT JOIN card USING (grp)"""))
def fit_report(spark, sf_dir):
    """The whole fit of every series, and of three faulty copies: one on hours, one with dead prices, one that ends early."""
    rows = series(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    copy = lambda grp, name: rows.where(F.col("grp") == grp).withColumn("grp", F.lit(name))
    rows = (
        rows.unionByName(copy("click", _HOURLY).withColumn("ts", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")))
        .unionByName(copy("error", _DEAD).withColumn("over_odds", F.lit(1.0)))
        .unionByName(copy("signup", _SHORT).where(F.col("pos") < _SHORT_ROWS))
    )
    report = fitting.fit_history(rows, ["x"], CONFIG, key="grp", order=("ts", "event_id"), strict=False).report
    return report.select(
        "grp", "training_rows", F.expr(v.SPARK.epoch("training_cutoff_at")).alias("training_cutoff"), "fault", "sample_size",
        F.round("model_brier_score", 6).alias("model_brier_score"), F.expr(v.SPARK.epoch("validation_period_start")).alias("first_validated"),
        F.expr(v.SPARK.epoch("validation_period_end")).alias("last_validated"),
    )


#: Test folds of a series of average length, and how far the trees' squared error may lie over that of the mean of the past.
TREE_FOLDS, TREE_ERROR = 9, 2.0


@query("walk_forward_gbt", over({"h": v.history}, f"""
    , s AS (SELECT greatest(2, CAST(ceil(avg(n) / {TREE_FOLDS + 1}e0) AS BIGINT)) AS size FROM (SELECT count(*) AS n FROM h GROUP BY grp) c)
    , f AS (SELECT p.*, size, CASE WHEN pos < size THEN -1 ELSE CAST(floor((pos - size) / CAST(size AS DOUBLE)) AS BIGINT) END AS fold FROM ({_POS}) p, s)
    SELECT grp, fold, count(*) AS n, CASE WHEN fold >= 0 THEN min(pos) ELSE 0 END AS trained_on, min(pos) AS first_pos, max(pos) AS last_pos, sum(event_id)::BIGINT AS events,
      CASE WHEN fold >= 0 THEN count(*) ELSE 0 END AS predicted, true AS within_bound FROM f GROUP BY grp, fold"""))
def walk_forward_gbt(spark, sf_dir):
    """Boosted trees at their fixed settings over every series: the rows of each fold, what it was fitted on, and whether the
    squared error of the whole series stays within the bound."""
    rows = cut_lineage(series(spark, sf_dir))
    size = max(2, rows.groupBy("grp").count().agg(F.ceil(F.avg("count") / (TREE_FOLDS + 1))).first()[0])
    config = history.WalkForward(min_train_size=size, test_size=size)
    out = history.walk_forward_trees(rows, ["grp"], ["x", "line"], config)
    folds = out.groupBy("grp", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum("event_id").alias("events"),
        F.count("prediction").alias("predicted"), F.sum("y").alias("_y"), F.sum(F.col("y") * F.col("y")).alias("_yy"),
        F.sum((F.col("y") - F.col("prediction")) ** 2).alias("_error"),
    )
    past = Window.partitionBy("grp").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("grp")
    folds = folds.withColumns({"trained_on": F.coalesce(F.sum("n").over(past), F.lit(0)), "_mean": F.sum("_y").over(past) / F.sum("n").over(past)})
    spread = F.when(F.col("fold") >= 0, F.col("_yy") - 2 * F.col("_mean") * F.col("_y") + F.col("n") * F.col("_mean") ** 2)
    return folds.select(
        "grp", "fold", "n", "trained_on", "first_pos", "last_pos", "events", "predicted",
        (F.sum("_error").over(whole) <= TREE_ERROR * F.sum(spread).over(whole)).alias("within_bound"),
    )
