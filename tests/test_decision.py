import json
import uuid

import pytest
from documents import BASE, EVALUATED_AT, changed
from pyspark.sql import functions as F

from linewright import schemas
from linewright.operators import contracts, decision
from linewright.plans import catalog as decision_queries
from linewright.plans import views
from linewright.session import cut_lineage

TYPES = {
    "model": schemas.MODEL_OUTPUT, "market": schemas.MARKET_SNAPSHOT, "portfolio": schemas.PORTFOLIO_STATE,
    "policy": schemas.RISK_POLICY, "context": schemas.MLB_CONTEXT,
}


def decided(spark, cases):
    """cases: list of {document.path: value}; ``context: None`` removes the context."""
    rows = []
    for i, case in enumerate(cases):
        docs = {}
        for kind, base in BASE.items():
            change = {p.split(".", 1)[1]: v for p, v in case.items() if p.startswith(kind + ".")}
            docs[kind] = json.dumps(changed(base, change)) if case.get(kind, 0) is not None else None
        rows.append((i, case.get("evaluated_at", EVALUATED_AT), *[docs[k] for k in TYPES]))
    df = spark.createDataFrame(rows, "i int, evaluated_at string, " + ", ".join(f"{k}_t string" for k in TYPES))
    for kind, dtype in TYPES.items():
        df = df.withColumn(f"{kind}_v", F.try_parse_json(f"{kind}_t"))
        df = contracts.typed_document(df, f"{kind}_v", dtype, kind)
        df = df.withColumn(kind, F.when(F.col(f"{kind}_t").isNotNull(), F.col(kind))).drop(f"{kind}_t", f"{kind}_v")
    table = cut_lineage(decision.decide(decision.with_contract_gate(df)))
    assert table.where(F.expr(decision.output_violation())).isEmpty()
    return table


def decide(spark, cases):
    return decided(spark, cases).orderBy("i").collect()


UNCALIBRATED = {"model.calibration_status": "uncalibrated", "model.calibration_method": "none", "model.probability_calibrated": None}


def test_hashes_come_with_shared_documents(spark):
    """Assembled candidates carry the hashes of their shared documents; decisions are those of candidates without them."""
    sf = "/root/testdata/sf0.001"
    rows = cut_lineage(decision.with_contract_gate(decision_queries.decision_queries.assembled(spark, sf)))
    carried = [c for c in rows.columns if c.startswith("_sha_")]
    assert sorted(carried) == ["_sha_context", "_sha_policy", "_sha_portfolio"]
    kept, taken_anew = cut_lineage(decision.decide(rows)), cut_lineage(decision.decide(rows.drop(*carried)))
    assert kept.columns == taken_anew.columns and kept.exceptAll(taken_anew).isEmpty() and kept.count() == taken_anew.count() > 100
    assert not rows.where("portfolio IS NULL").isEmpty() and not rows.where("context IS NULL").isEmpty()


def test_golden_candidate_both_tiers(spark):
    done, loose = decide(spark, [{}, UNCALIBRATED])
    assert (done.decision, list(done.reason_codes)) == ("BET", ["QUALIFIED"])
    odds, p, fair = 2.56, 0.46, 5 / 13
    assert done.market.market_sum == 65 / 64 and done.market.no_vig_probability == round(fair, 12)
    assert done.economics.ev == pytest.approx(p * odds - 1, abs=1e-12) and done.economics.edge_vs_market_pp == round(p - fair, 12)
    assert done.economics.minimum_qualifying_odds == round(1.04 / p, 12)
    for row, weight, fraction in ((done, 0.8, 0.3), (loose, 0.4, 0.12)):
        sized = weight * p + (1 - weight) * fair
        kelly = (sized * odds - 1) / (odds - 1)
        assert row.model.sizing_probability == round(sized, 12) and row.economics.full_kelly == round(kelly, 12)
        assert row.staking.provisional_stake == pytest.approx(24000 * fraction * kelly, abs=1e-7)
    assert done.staking.caps.asDict() == pytest.approx({
        "kelly": done.staking.provisional_stake, "per_bet": 600, "open": 2880 - 1100, "daily": 7200 - 1500, "league": 4320 - 900,
        "rolling_3d": 10800 - 4200, "correlation": 1200 - 150, "available_balance": 15500,
    })
    assert (done.staking.final_stake, done.staking.binding_cap) == (600.0, "per_bet")
    assert (loose.staking.final_stake, loose.staking.binding_cap) == (114.0, "kelly")
    assert done.human_approval_required and len(done.decision_id) == 64 and done.decision_id != loose.decision_id


CASES = [
    ({"market.period": "first_five"}, "BLOCKED", ["DOMAIN_MISMATCH"]),
    ({"model.probability_calibrated": 0.39}, "PASS", ["EV_BELOW_MINIMUM", "PRICE_BELOW_MINIMUM", "EDGE_BELOW_MINIMUM"]),
    ({"market.captured_at": "2025-04-11T13:15:59-05:00"}, "BLOCKED", ["MARKET_SNAPSHOT_STALE"]),
    ({"market.captured_at": "2025-04-11T13:20:01-05:00"}, "BLOCKED", ["TIMESTAMP_IN_FUTURE"]),
    ({"portfolio.exposures.open_amount": 2950.0}, "BLOCKED", ["NO_RISK_CAPACITY"]),
    ({"context.starters.home.status": "changed"}, "BLOCKED", ["MLB_STARTER_CHANGED"]),
    ({"context.starters.home.status": "projected"}, "WATCH", ["MLB_STARTER_UNCONFIRMED"]),
    ({"context": None}, "BLOCKED", ["MLB_CONTEXT_MISSING"]),
    ({"market.decimal_odds": "2.2"}, "BLOCKED", ["INPUT_SCHEMA_INVALID"]),
    ({"evaluated_at": "yesterday"}, "BLOCKED", ["INPUT_SCHEMA_INVALID"]),
    ({"model.event_id": "X", "model.market_id": "X", "model.selection": "X"}, "BLOCKED",
     ["EVENT_ID_MISMATCH", "MARKET_ID_MISMATCH", "SELECTION_MISMATCH"]),
    ({"portfolio.league": "X"}, "BLOCKED", ["DOMAIN_MISMATCH"]),
    ({"market.correlation_group": None, "portfolio.correlation_group": None}, "BLOCKED", ["UNKNOWN_CORRELATION"]),
    ({"market.market_status": "suspended", "market.event_start_at": "2025-04-11T13:20:00-05:00"}, "BLOCKED",
     ["MARKET_NOT_OPEN", "EVENT_ALREADY_STARTED"]),
    ({"market.selection": "Draw", "model.selection": "Draw"}, "BLOCKED", ["MARKET_INCOMPLETE"]),
    ({"market.decimal_odds": 2.6}, "BLOCKED", ["SELECTED_PRICE_MISMATCH"]),
    ({"model.feature_cutoff_at": "2025-04-11T13:12:01-05:00"}, "BLOCKED", ["FEATURE_CUTOFF_AFTER_PREDICTION"]),
    ({"model.training_cutoff_at": "2025-04-11T13:08:00-05:00"}, "BLOCKED", ["TRAINING_CUTOFF_AFTER_FEATURES"]),
    ({"model.calibration_status": "unknown"}, "BLOCKED", ["CALIBRATION_STATUS_NOT_ALLOWED", "CALIBRATION_PROVENANCE_UNKNOWN"]),
    # A failed threshold outranks the context.
    ({"model.probability_calibrated": 0.39, "context": None}, "PASS", ["EV_BELOW_MINIMUM", "PRICE_BELOW_MINIMUM", "EDGE_BELOW_MINIMUM"]),
    ({"portfolio.drawdown_fraction": 0.18}, "BLOCKED", ["DRAWDOWN_PAUSE"]),
    ({"portfolio.drawdown_fraction": 0.12}, "WATCH", ["DRAWDOWN_REVIEW"]),
    ({"portfolio.drawdown_fraction": 0.08}, "BET", ["QUALIFIED", "DRAWDOWN_WARNING"]),
    ({"portfolio.stake_increment": 5000.0}, "PASS", ["STAKE_BELOW_MINIMUM"]),
    ({"context.environment.roof_matches_model": False, "context.bullpen.home": "stale"}, "BLOCKED", ["MLB_ENVIRONMENT_MISMATCH"]),
    ({"context.environment.roof_matches_model": None, "context.bullpen.home": "stale"}, "WATCH",
     ["MLB_BULLPEN_UNAVAILABLE", "MLB_ENVIRONMENT_UNCONFIRMED"]),
    ({"context.captured_at": "2025-04-11T12:59:00-05:00"}, "WATCH", ["MLB_CONTEXT_STALE"]),
    ({"context.settlement.pitcher_rule": "listed"}, "BLOCKED", ["MLB_LISTED_PITCHER_MISMATCH"]),
    ({"context.event_id": "X"}, "BLOCKED", ["MLB_CONTEXT_EVENT_MISMATCH"]),
    ({"context.lineups.away": "late"}, "BLOCKED", ["INPUT_SCHEMA_INVALID"]),
]


def test_every_gate(spark):
    rows = decide(spark, [case for case, _, _ in CASES])
    got = [(r.decision, list(r.reason_codes)) for r in rows]
    assert got == [(d, c) for _, d, c in CASES]
    by_case = dict(zip([json.dumps(c, sort_keys=True) for c, _, _ in CASES], rows))
    text_odds = by_case[json.dumps({"market.decimal_odds": "2.2"})]
    assert text_odds.decimal_odds is None and text_odds.market.market_sum is None
    assert by_case[json.dumps({"evaluated_at": "yesterday"})].evaluated_at == "1970-01-01T00:00:00+00:00"
    low = by_case[json.dumps({"model.probability_calibrated": 0.39})]
    assert low.staking.final_stake is None and low.context.status == "VALID"


def test_doubling_the_bankroll_doubles_a_kelly_stake(spark):
    one, two = decide(spark, [
        UNCALIBRATED | {"portfolio.stake_increment": 0.01},
        UNCALIBRATED | {"portfolio.stake_increment": 0.01, "portfolio.bankroll": 48000.0},
    ])
    assert two.staking.provisional_stake == pytest.approx(2 * one.staking.provisional_stake, rel=1e-12)


def test_same_input_same_identity(spark):
    first, second = decide(spark, [{}, {}])
    assert first.decision_id == second.decision_id and first.audit == second.audit


SF = "/root/testdata/sf0.001"


def nodes(plan):
    out, waiting = [], [plan]
    while waiting:
        node = waiting.pop()
        out.append(node)
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return out


def test_no_document_in_a_sort_or_window_of_the_asof_joins(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        known = decision.as_of(
            cut_lineage(views.market_documents(spark, SF)), views.portfolio_documents(spark, SF), views.context_documents(spark, SF).drop("k"),
        )
        assert {"portfolio", "context", "market"} <= set(known.columns)
        seen = nodes(known._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    kinds = [n.getClass().getSimpleName() for n in seen]
    assert "WindowExec" in kinds and "ShuffledHashJoinExec" in kinds and "SortMergeJoinExec" not in kinds
    for node, kind in zip(seen, kinds):
        if kind in ("SortExec", "WindowExec"):
            output = node.output()
            types = [output.apply(i).dataType().simpleString() for i in range(output.size())]
            assert not any("struct" in t or "map" in t for t in types), types


@pytest.mark.parametrize("block_rows", [None, 37])
def test_documents_as_of_the_evaluation(spark, block_rows):
    """Against a plain search: the newest portfolio and context of the key, ties by text, none for null or unreadable times."""
    at = "2026-01-01T00:00:{:02d}Z"
    markets = [(i, (f"e{i % 4}" if i % 9 else None,), at.format(i % 60) if i % 11 else "soon", f"p{i % 3}", "g" if i % 7 else None) for i in range(120)]
    books = [(f"p{n % 3}", "g", (n, n % 5), at.format(n * 3 % 60)) for n in range(40)] + [("p0", "g", (99, 0), None), (None, "g", (98, 0), at.format(1))]
    sports = [(f"e{n % 4}", (n,), at.format(n * 7 % 60)) for n in range(25)]
    market_rows = spark.createDataFrame(markets, "candidate_id int, market struct<event_id:string>, evaluated_at string, portfolio_id string, correlation_key string")
    book_rows = spark.createDataFrame(books, "portfolio_id string, correlation_key string, portfolio struct<n:int,m:int>, t string").select("portfolio_id", "correlation_key", "portfolio", F.expr("try_to_timestamp(t)").alias("portfolio_at"))
    sport_rows = spark.createDataFrame(sports, "event_id string, context struct<n:int>, t string").select("event_id", "context", F.expr("try_to_timestamp(t)").alias("context_at"))
    got = {r.candidate_id: (tuple(r.portfolio) if r.portfolio else None, tuple(r.context) if r.context else None) for r in decision.as_of(market_rows, book_rows, sport_rows, block_rows=block_rows).collect()}
    text = lambda names, values: json.dumps(dict(zip(names, values)), separators=(",", ":"))
    for i, (event,), when, book, group in markets:
        fits = [(t, text("nm", p), p) for b, g, p, t in books if t and when != "soon" and (b, g) == (book, group) and t <= when]
        plays = [(t, text("n", c), c) for e, c, t in sports if when != "soon" and e == event and t <= when]
        assert got[i] == (max(fits)[2] if fits else None, max(plays)[2] if plays else None)


def test_decision_queries_read_one_table(spark, monkeypatch):
    """The table is built for a state of its inputs and a formula, and not again."""
    built = []
    plain = decision.decide
    monkeypatch.setattr(decision, "decide", lambda df, **more: built.append(1) or plain(df, **more))
    monkeypatch.setattr(decision, "FORMULA", f"test-{uuid.uuid4().hex}")
    for name in ("stake_caps", "scan_summary", "decision_report"):
        assert decision_queries.QUERIES[name](spark, SF).count() > 0
    assert len(built) == 1


def test_models_and_markets_are_shuffled_once(spark):
    """Pairing moves each model and market once, whatever comes beside them; repeated keys and missing documents keep their rows."""
    at = "2026-01-01T00:00:{:02d}Z"
    models = spark.createDataFrame([(i % 50 if i % 13 else None, (f"m{i}",)) for i in range(60)], "candidate_id int, model struct<name:string>")
    rows = [(i % 45 if i % 17 else None, (f"e{i % 4}" if i % 9 else None,), at.format(i % 60) if i % 11 else "soon", f"p{i % 3}", "g" if i % 7 else None, f"r{i % 2}") for i in range(70)]
    markets = spark.createDataFrame([*rows, *rows[:5]], "candidate_id int, market struct<event_id:string>, evaluated_at string, portfolio_id string, correlation_key string, policy_id string")
    moment = lambda df, name: df.withColumn(name, F.expr(f"try_to_timestamp({name})"))
    books = moment(spark.createDataFrame([(f"p{n % 3}", "g", (n,), at.format(n * 3 % 60)) for n in range(40)], "portfolio_id string, correlation_key string, portfolio struct<n:int>, portfolio_at string"), "portfolio_at")
    sports = moment(spark.createDataFrame([(f"e{n % 4}", (n,), at.format(n * 7 % 60)) for n in range(25)], "event_id string, context struct<n:int>, context_at string"), "context_at")
    policies = spark.createDataFrame([("r0", (1,)), ("r2", (2,))], "policy_id string, policy struct<n:int>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = decision.assemble_candidates(cut_lineage(models), cut_lineage(markets), books, policies, sports)
        seen = nodes(out._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [n.output().mkString(",") for n in seen if n.getClass().getSimpleName() == "ShuffleExchangeExec"]
    assert sum("market#" in m for m in moved) == 1 and sum("model#" in m for m in moved) == 1
    known = decision.as_of(markets, books, sports).collect()
    want = [(r.candidate_id, m.name, r.market.event_id, r.evaluated_at, r.portfolio, r.context, r.policy_id) for r in known for k, m in models.collect() if k is not None and k == r.candidate_id]
    got = out.collect()
    assert sorted(map(str, want)) == sorted(str((r.candidate_id, r.model.name, r.market.event_id, r.evaluated_at, r.portfolio, r.context, r.policy_id)) for r in got)
    assert {(r.policy_id, r.policy) for r in got} == {("r0", (1,)), ("r1", None)} and len(want) > 70
    assert all((r._sha_portfolio is None) == (r.portfolio is None) and (r._sha_context is None) == (r.context is None) for r in got)
