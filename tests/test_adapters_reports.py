from documents import changed
from pyspark.sql import functions as F

from linewright import schemas
from linewright.operators import adapters, contracts, markets, report, snapshots

RICH = {
    "output_schema_version": "prediction-v2", "event_id": " E ", "sport": "NBA",
    "market": {
        "market_type": "game_total", "period": "full", "selection": "over", "line": 224.5, "book": "b", "odds_decimal": 1.95,
        "opposing_odds_decimal": 1.95, "no_vig_probability": 0.5, "snapshot_at": "2026-07-23T15:40:00+03:00",
    },
    "model": {
        "model_name": "m", "model_version": "1", "model_artifact_sha256": "A" * 64, "feature_schema_version": "f", "point_estimate": 220.0,
        "prediction_generated_at": "2026-07-23T15:41:00+03:00", "feature_cutoff_at": "2026-07-23T15:38:00+03:00", "training_cutoff_at": "2026-01-08T01:00:00+00:00",
    },
    "distribution": {
        "method": "m", "residual_distribution_version": "r", "residual_artifact_sha256": "b" * 64, "residual_sample_size": 110, "threshold_residual": 3.0,
        "probability_over_raw": 0.5, "probability_under_raw": 0.5, "probability_push_raw": 0.0, "probability_over_conditional_non_push_raw": 0.5,
    },
    "calibration": {
        "method": "m", "status": "degraded", "calibration_version": "c", "calibration_artifact_sha256": "c" * 64, "training_sample_size": 90,
        "probability_selected_raw": 0.509, "probability_selected_calibrated": 0.576, "probability_opposing_calibrated": 0.424, "probability_push": 0.0,
    },
    "validation": {
        "sample_size": 60, "model_brier_score": 0.2557, "market_brier_score": 0.25, "brier_skill_score": -0.02, "model_log_loss": 0.705,
        "market_log_loss": 0.693, "model_ece": 0.1, "market_ece": 0.02, "method": "w", "validation_period_start": "a", "validation_period_end": "z",
    },
    "decision_inputs": {"edge_probability_points": 0.07, "expected_value_with_push": 0.12},
}
BETTER = {"calibration.status": "validated", "validation.model_brier_score": 0.24, "validation.model_log_loss": 0.68}


def reports(spark, changes):
    docs = [changed(RICH, c) for c in changes]
    df = spark.createDataFrame(docs, schemas.RICH_PREDICTION).withColumn("i", F.monotonically_increasing_id())
    return df.withColumns({"market_id": F.lit("M"), "competition": F.lit("NBA"), "target_market": F.lit("t"), "settlement_rules": F.lit("s")})


def test_adapters_disagree_as_designed(spark):
    changes = [{}, BETTER, {"calibration.status": "validated"}, BETTER | {"validation.model_brier_score": 7.0}, {"calibration.probability_selected_raw": 1.0},
               {"market.selection": " "}, {"validation.sample_size": 0, "calibration.status": "provisional"}]
    df = reports(spark, changes)
    down = adapters.adapt(df, "downgrade").orderBy("i").collect()
    assert [r.calibration_status for r in down] == ["uncalibrated", "validated", "uncalibrated", "uncalibrated", None, None, "uncalibrated"]
    assert [r.probability_calibrated for r in down] == [None, 0.576, None, None, None, None, None]
    assert down[0].event_id == "E" and down[0].model_artifact_sha256 == "a" * 64 and down[3].brier_score is None
    assert down[4].mapping_error == "not_a_probability:calibration.probability_selected_raw" and down[5].mapping_error == "blank:market.selection"
    assert down[6].validation_sample_size is None and down[1].validation_window == "a/z"
    block = adapters.adapt(df, "block").orderBy("i").collect()
    assert [r.calibration_status for r in block] == ["unknown", "validated", "validated", "validated", None, None, None]
    assert block[0].notes == "adapted_from=prediction-v2; rich_status=degraded" and block[0].calibration_method == "other"
    assert block[6].mapping_error == "below_one:sample_size"
    mapped = adapters.adapt(reports(spark, [{}, BETTER]), "downgrade")
    docs = mapped.select("i", F.struct(*[c for c in mapped.columns if c not in ("i", "mapping_error")]).alias("doc"))
    rows = contracts.model_verdict(docs, "doc").orderBy("i").collect()
    assert [(r.decision, [e.code for e in r.errors]) for r in rows] == [("UNCALIBRATED", []), ("VALIDATED", [])]


def test_report_texts_and_audit(spark):
    from test_decision import decided

    df = decided(spark, [{}, {"context.starters.home.status": "projected"}])
    texts = {r.decision: r for r in report.report_text(df).collect()}
    assert "EV: +17.8% | Edge: +7.5 pp | Minimum price: 2.27" in texts["BET"].report
    assert "Stake: CAD 600.00 / 2.5%" in texts["BET"].report and texts["BET"].compact.startswith("PICK\nMLB")
    assert texts["WATCH"].report.endswith("Recheck: MLB_STARTER_UNCONFIRMED") and texts["WATCH"].compact is None
    shown = spark.range(1).select(report.price_up(F.lit(2.0196)).alias("a"), report.price_up(F.lit(2.02)).alias("b"), report.stake_down(F.lit(9.999)).alias("c")).first()
    assert tuple(shown) == ("2.02", "2.02", "9.99")
    answers = [(1, "recency", "FLAG", False), (1, "forced_action", "CLEAR", True), (2, "recency", "FLAG", True), (3, "mood", "MAYBE", False)]
    got = {r.k: (r.audit, r.n_flags, r.n_unknown) for r in report.audit_rollup(spark.createDataFrame(answers, "k int, item string, answer string, invalidates boolean"), "k").collect()}
    assert got == {1: ("PASS", 1, 0), 2: ("BLOCKED", 1, 0), 3: ("PASS", 0, 1)}


def test_scan_summary_exposure(spark):
    rows = [("s", "e1", "m1", "BET", 10.0), ("s", "e1", "m2", "PASS", None), ("s", "e2", "m3", "BLOCKED", None), ("s", "e2", "m3", "BET", 5.0)]
    df = spark.createDataFrame(rows, "sport string, event_id string, market_id string, decision string, stake double")
    r = report.scan_summary(df, ["sport"], exposure=spark.createDataFrame([("s", 100.0)], "sport string, open_before double")).first()
    assert (r.events_scanned, r.markets_scanned, r.bets, r.passes, r.blocked, r.total_stake, r.open_after) == (2, 3, 2, 1, 1, 15.0, 115.0)


def test_markets_with_a_bad_price_are_left_out(spark):
    df = spark.createDataFrame([("a", "x", 2.0), ("a", "y", 2.0), ("b", "x", 2.0), ("c", "x", 1.0), ("c", "y", 3.0)], "m string, s string, decimal_odds double")
    assert sorted((r.m, r.no_vig_probability) for r in markets.no_vig_board(df, ["m"]).collect()) == [("a", 0.5), ("a", 0.5)]


def test_reconciliation_keeps_conflicts(spark):
    rows = [("k", "aggregator", 5, 1, 10), ("k", "official", 1, 2, 20), ("k", "official", 2, 3, 30), ("j", "unknown", 1, 4, 1)]
    df = spark.createDataFrame(rows, "k string, source string, ts int, id int, value int")
    chosen, conflicts = snapshots.reconcile(df, ["k"], value="value", source="source", time="ts", tiebreak="id")
    got = {r.k: (r.chosen_value, r.source_rank, r.n_values, r.conflict) for r in chosen.collect()}
    assert got == {"k": (30, 1, 3, True), "j": (1, 6, 1, False)}
    assert sorted((r.value, r.source) for r in conflicts.collect()) == [(10, "aggregator"), (20, "official"), (30, "official")]
