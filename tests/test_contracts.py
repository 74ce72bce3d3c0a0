import json

import pytest
from documents import BASE, MODEL, changed
from pyspark.sql import functions as F

from linewright import schemas
from linewright.operators import contracts


def parsed(spark, docs):
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "i int, t string").withColumn("doc", F.try_parse_json("t"))


def codes(df, rules):
    rows = contracts.contract_errors(df, "doc", rules).orderBy("i").collect()
    return [[e.code for e in r.errors] for r in rows]


RULES = {
    "model": contracts.model_output, "market": contracts.market_snapshot, "portfolio": contracts.portfolio_state,
    "policy": contracts.risk_policy, "context": contracts.mlb_context,
}
TYPES = {
    "model": schemas.MODEL_OUTPUT, "market": schemas.MARKET_SNAPSHOT, "portfolio": schemas.PORTFOLIO_STATE,
    "policy": schemas.RISK_POLICY, "context": schemas.MLB_CONTEXT,
}


@pytest.mark.parametrize("kind", list(RULES))
def test_complete_documents_are_clean_raw_and_typed(spark, kind):
    raw = parsed(spark, [BASE[kind]])
    assert codes(raw, RULES[kind]) == [[]]
    typed = contracts.typed_document(raw, "doc", TYPES[kind], "typed").select("i", F.col("typed").alias("doc"))
    assert codes(typed, RULES[kind]) == [[]]


CASES = [
    ("model", {"sport": "CHESS"}, ["schema.sport.enum"]),
    ("model", {"line": ...}, ["schema.$.required"]),
    ("model", {"surprise": 1}, ["schema.$.additionalProperties"]),
    ("model", {"probability_raw": "0.5"}, ["schema.probability_raw.type"]),
    ("model", {"probability_raw": 1}, ["schema.probability_raw.exclusiveMaximum"]),
    ("model", {"probability_calibrated": None}, ["schema.probability_calibrated.type"]),
    ("model", {"calibration_method": "none"}, ["schema.calibration_method.not"]),
    ("model", {"calibration_status": "uncalibrated"}, ["schema.calibration_method.const"]),
    ("model", {"validation_sample_size": 1.5}, ["schema.validation_sample_size.type", "schema.validation_sample_size.type"]),
    ("model", {"prediction_generated_at": "2026-07-23T18:00:00"}, ["schema.prediction_generated_at.format"]),
    ("model", {"model_artifact_sha256": "abc"}, ["schema.model_artifact_sha256.pattern"]),
    ("model", {"validation_domain": 3}, ["schema.validation_domain.type"]),
    ("model", {"validation_domain.period": ""}, ["schema.validation_domain.period.minLength"]),
    ("model", {"line": 8.5, "validation_domain.line": "8.5"}, []),
    ("model", {"schema_version": "other.v1"}, ["schema.schema_version.const"]),
    ("market", {"decimal_odds": "2.2"}, ["schema.decimal_odds.type"]),
    ("market", {"outcomes": []}, ["schema.outcomes.minItems"]),
    ("market", {"is_complete": False}, ["schema.is_complete.const"]),
    ("market", {"outcomes": [{"selection": "A", "decimal_odds": 2}] * 2}, ["schema.outcomes.uniqueItems"]),
    ("market", {"outcomes": [{"selection": "A", "decimal_odds": 2}, {"selection": "", "decimal_odds": 1, "x": 1}]},
     ["schema.outcomes.1.additionalProperties", "schema.outcomes.1.decimal_odds.exclusiveMinimum", "schema.outcomes.1.selection.minLength"]),
    ("market", {"market_status": "halted"}, ["schema.market_status.enum"]),
    ("portfolio", {"currency": "eur"}, ["schema.currency.pattern"]),
    ("portfolio", {"open_positions_count": True}, ["schema.open_positions_count.type"]),
    ("portfolio", {"exposures.open_amount": -1}, ["schema.exposures.open_amount.minimum"]),
    ("policy", {"kelly_fraction.unknown": 0.1}, ["schema.kelly_fraction.unknown.const"]),
    ("policy", {"allowed_calibration_statuses": ["unknown"]}, ["schema.allowed_calibration_statuses.items.enum"]),
    ("policy", {"freshness_seconds.market_snapshot": 0}, ["schema.freshness_seconds.market_snapshot.minimum"]),
    ("policy", {"drawdown.warning_fraction": 0.5}, ["drawdown.order"]),
    ("policy", {"human_approval_required": False}, ["schema.human_approval_required.const"]),
    ("context", {"starters.home.status": "late"}, ["schema.starters.home.status.enum"]),
    ("context", {"environment.roof_matches_model": "yes"}, ["schema.environment.roof_matches_model.type"]),
    ("context", {"bullpen": ...}, ["schema.$.required"]),
]


def test_each_fault_reports_its_codes(spark):
    for kind in RULES:
        mine = [c for c in CASES if c[0] == kind]
        got = codes(parsed(spark, [changed(BASE[kind], change) for _, change, _ in mine]), RULES[kind])
        assert got == [expected for _, _, expected in mine]


def test_model_verdicts(spark):
    docs = [
        MODEL,
        changed(MODEL, {"brier_score": None, "log_loss": None, "expected_calibration_error": None, "validation_sample_size": None}),
        changed(MODEL, {"calibration_status": "uncalibrated", "calibration_method": "none", "probability_calibrated": None}),
        changed(MODEL, {"calibration_status": "unknown"}),
        changed(MODEL, {"validation_domain.market_type": "total"}),
        changed(MODEL, {"line": 8, "validation_domain.line": 8.0}),
        changed(MODEL, {"line": 8, "validation_domain.line": "8"}),
    ]
    rows = contracts.model_verdict(parsed(spark, docs), "doc").orderBy("i").collect()
    assert [r.decision for r in rows] == ["VALIDATED", "BLOCKED", "UNCALIBRATED", "BLOCKED", "BLOCKED", "VALIDATED", "BLOCKED"]
    assert [e.path for e in rows[1].errors] == ["brier_score", "expected_calibration_error", "log_loss", "validation_sample_size"]
    assert [e.code for e in rows[3].errors] == ["calibration_status.unknown"]
    assert [e.code for e in rows[4].errors] == ["domain_mismatch.market_type"]
    assert [r.domain_match for r in rows] == [True, True, True, True, False, True, False]
    assert rows[0].valid and rows[2].valid and not rows[3].valid


def test_review_contract(spark):
    review = {
        "review_id": "r", "packet_sha256": "0" * 64, "prediction_id": "p", "model_version": "v", "reviewed_at": "2026-07-23T18:30:00Z",
        "system_decision": "BET", "human_decision": "approved", "model_probability_changed": False, "proposed_stake": 100.0,
        "approved_stake": 50.0, "reason": "x",
    }
    docs = [review, changed(review, {"model_probability_changed": True}), changed(review, {"proposed_stake": -1, "reason": ""})]
    assert codes(parsed(spark, docs), contracts.human_review) == [
        [], ["schema.model_probability_changed.const"], ["schema.proposed_stake.minimum", "schema.reason.minLength"],
    ]


NESTED = {
    "event_id": "E", "event": {
        "event_id": "E", "sport": "MLB", "competition": "MLB", "event_start_at": "2026-07-23T20:00:00Z", "status": "scheduled",
        "participants": ["a", "b"], "source": "s", "retrieved_at": "2026-07-23T18:00:00Z",
    },
    "market": {
        "market_id": "M", "book": "b", "market_type": "ml", "period": "full", "line": None, "selection": "a", "odds_decimal": 2.1,
        "snapshot_at": "2026-07-23T18:00:00", "outcomes": [{"selection": "a", "odds_decimal": 2.1}, {"selection": "b", "odds_decimal": 1.8}],
    },
    "model": {
        "model_name": "m", "model_version": "1", "target_market": "t", "selection": "a", "probability_calibrated": 0.5,
        "prediction_generated_at": "2026-07-23T18:00:00Z",
    },
}


def test_minimum_snapshot_and_packet_checks(spark):
    docs = [
        NESTED,
        changed(NESTED, {"event": ..., "market.odds_decimal": 1, "model.probability_calibrated": "x"}),
        changed(NESTED, {"market.snapshot_at": "soon", "market.outcomes": [1]}),
        changed(NESTED, {"event_id": "F", "event.participants": ["a"]}),
    ]
    df = parsed(spark, docs)
    simple = [list(r.errors) for r in contracts.contract_errors(df, "doc", contracts.minimum_snapshot).orderBy("i").collect()]
    assert simple[0] == []
    assert simple[1] == [
        "missing_event.sport", "missing_event.competition", "missing_event.event_start_at", "missing_event.status",
        "missing_event.participants", "invalid_market.odds_decimal", "invalid_model.probability_calibrated",
    ]
    assert simple[2] == ["invalid_timestamp.market.snapshot_at", "invalid_market.outcomes"]
    packet = [list(r.errors) for r in contracts.contract_errors(df, "doc", contracts.packet_market).orderBy("i").collect()]
    assert packet[0] == [] and packet[1] == ["packet.event.object"]
    assert packet[3] == [
        "packet.participants.two", "packet.event_id.conflict",
    ]


def test_objects_are_opened_once(spark):
    """Fields come from one cast per object, not from a search of the document each; odd documents keep their faults."""
    texts = ['{"a": {"x": 1, "more": null}, "b": null}', '{"a": {"x": "1"}, "b": "t", "c": 2}', '{"a": [1]}', "[1]", "nothing"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string").select("k", F.try_parse_json("t").alias("d"))
    doc = contracts.VariantDoc("d")
    inner = contracts.an_object({"x": contracts.a_number(minimum=2)})
    rules = contracts.an_object({"a": inner, "b": contracts.a_string()})(doc, "", "true")
    staged = doc.stage(df)
    assert [c for c in staged.columns if "_part_" in c] == ["_d_part_", "_d_part_a"]
    rows = staged.withColumn("e", F.expr(contracts.collect(doc, rules))).orderBy("k").collect()
    assert [[e.code.removeprefix("schema.") for e in r.e] for r in rows] == [
        ["a.additionalProperties", "a.x.minimum", "b.type"], ["$.additionalProperties", "a.x.type"],
        ["$.required", "a.type"], ["$.required", "$.required"], ["$.required", "$.required"],
    ]
