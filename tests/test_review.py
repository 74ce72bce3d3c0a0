import hashlib
import json
import math
import os
import random
import re

import duckdb
from documents import changed
from pyspark.sql import functions as F

from linewright.functions.canonical import canonical_text, number_text
from linewright.operators import artifacts, review
from linewright.plans import views
from linewright.schemas import HUMAN_REVIEW
from linewright.sources import stores

REVIEW = {
    "review_id": "r1", "packet_sha256": "0" * 64, "prediction_id": "p", "model_version": "v", "reviewed_at": "2026-07-23T18:30:00Z",
    "system_decision": "BET", "human_decision": "approved", "model_probability_changed": False, "proposed_stake": 100.0,
    "approved_stake": 50.0, "reason": "x", "notes": None,
}
COLUMNS = "log_id string, arrival long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in HUMAN_REVIEW)


def table(spark, reviews):
    rows = [(log, n, *[r[f] for f in HUMAN_REVIEW.names]) for n, (log, r) in enumerate(reviews)]
    return spark.createDataFrame(rows, COLUMNS)


def test_policy_messages(spark):
    cases = [
        ({}, None),
        ({"approved_stake": 125.0}, "stake.above_proposed"),
        ({"system_decision": "BLOCKED"}, "approval.of_blocked"),
        ({"system_decision": "WATCH"}, "approval.needs_bet"),
        ({"approved_stake": 0.0}, "approval.needs_stake"),
        ({"human_decision": "rejected"}, "stake.without_approval"),
        ({"human_decision": "watch", "approved_stake": 0.0}, None),
    ]
    df = table(spark, [("L", changed(REVIEW, c)) for c, _ in cases])
    assert [r.fault for r in df.orderBy("arrival").select(review.policy_fault().alias("fault")).collect()] == [m for _, m in cases]


def text_of(record):
    record = {k: int(x) if isinstance(x, float) and x.is_integer() else x for k, x in record.items()}
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_intake_chains_rejects_and_continues(spark, folder, small_blocks):
    first = [("A", changed(REVIEW, {"review_id": f"a{i}", "reason": 'say "previous_record_sha256":null é'})) for i in range(60)]
    first += [("B", changed(REVIEW, {"review_id": "b0"})), ("A", changed(REVIEW, {"review_id": "a3"})), ("B", changed(REVIEW, {"review_id": "b1", "approved_stake": 125.0}))]
    accepted, rejected = review.intake(table(spark, first), None, arrival="arrival")
    assert {r.rejection for r in rejected.collect()} == {"review_id.repeated: a3", "stake.above_proposed"}
    _, faulty = review.intake(table(spark, [("A", changed(REVIEW, {"model_probability_changed": True, "reason": ""}))]), None, arrival="arrival")
    assert faulty.first().rejection == "contract: schema.model_probability_changed.const, schema.reason.minLength"
    path = f"{folder}/log"
    keep = ["log_id", "seq", *HUMAN_REVIEW.names, review.PREVIOUS, review.RECORD]
    stores.append_review_log(accepted.select(*keep), path)
    schema = accepted.select(*keep).schema
    log = stores.read_review_log(spark, path, schema)
    rows = log.where("log_id = 'A'").orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(60))
    last = None
    for r in rows:
        body = {f: r[f] for f in HUMAN_REVIEW.names} | {review.PREVIOUS: last}
        assert r[review.PREVIOUS] == last
        last = hashlib.sha256(text_of(body).encode()).hexdigest()
        assert r[review.RECORD] == last
    more = table(spark, [("A", changed(REVIEW, {"review_id": "a60"})), ("A", changed(REVIEW, {"review_id": "a5"})), ("C", changed(REVIEW, {"review_id": "c"}))])
    added, refused = review.intake(more, log, arrival="arrival")
    assert [r.rejection for r in refused.collect()] == ["review_id.repeated: a5"]
    added = {r.review_id: r for r in added.collect()}
    assert (added["a60"].seq, added["a60"][review.PREVIOUS]) == (60, last) and added["c"][review.PREVIOUS] is None
    stores.append_review_log(spark.createDataFrame([tuple(r[k] for k in keep) for r in added.values()], schema), path)
    whole = stores.read_review_log(spark, path, schema)
    fields = HUMAN_REVIEW.names
    checked = review.verify_chain(whole, "log_id", "seq", fields)
    assert checked.where("NOT (hash_ok AND link_ok)").isEmpty()
    tampered = whole.withColumn("approved_stake", F.when((F.col("log_id") == "A") & (F.col("seq") == 7), 49.0).otherwise(F.col("approved_stake")))
    bad = review.verify_chain(tampered, "log_id", "seq", fields).where("NOT (hash_ok AND link_ok)").collect()
    assert [(r.log_id, r.seq, r.hash_ok, r.link_ok) for r in bad] == [("A", 7, False, True)]
    _, broken = review.intake(table(spark, [("A", changed(REVIEW, {"review_id": "new"}))]), tampered, arrival="arrival")
    assert [r.rejection for r in broken.collect()] == ["log.chain_broken"]


def test_chain_check_scans_no_review_fields(spark, monkeypatch, small_blocks):
    """The log's reviews are hashed before the scan; only keys and hashes go through its shuffle, and the verdicts stay."""
    log, _ = review.intake(table(spark, [("AB"[i % 2], changed(REVIEW, {"review_id": f"r{i}"})) for i in range(90)]), None, arrival="arrival")
    log = log.withColumn(review.RECORD, F.when((F.col("log_id") == "B") & (F.col("seq") == 0), F.sha2("reason", 256)).otherwise(F.col(review.RECORD)))
    scanned, plain = [], review.ordered_scan
    monkeypatch.setattr(review, "ordered_scan", lambda df, *a, **k: scanned.append(df.columns) or plain(df, *a, **k))
    accepted, rejected = review.intake(table(spark, [("A", changed(REVIEW, {"review_id": "x"})), ("B", changed(REVIEW, {"review_id": "y"}))]), log, arrival="arrival")
    assert [(r.review_id, r.seq) for r in accepted.collect()] == [("x", 45)] and [r.rejection for r in rejected.collect()] == ["log.chain_broken"]
    assert set(scanned[0]) == {"log_id", "seq", review.PREVIOUS, review.RECORD, "hash_ok"}


def test_sample_hash_depends_on_values_and_order(spark):
    base = [("v", i, float(i % 7)) for i in range(300)]
    h = lambda rows, fan: artifacts.sample_hash(spark.createDataFrame(rows, "k string, pos long, x double"), ["k"], "pos", "x", fan=fan).first().artifact_sha256
    assert h(base, 4) == h(list(reversed(base)), 4)
    swapped = [("v", 299 - i, x) for _, i, x in base]
    assert h(swapped, 4) != h(base, 4) and h(base[:-1], 4) != h(base, 4)
    short = [("u", i, float(i)) for i in range(5)]
    both = artifacts.sample_hash(spark.createDataFrame(base + short, "k string, pos long, x double"), ["k"], "pos", "x", fan=8)
    assert {r.k: r.artifact_sha256 for r in both.collect()} == {"v": h(base, 8), "u": h(short, 8)}
    assert h(base[:3], 4096) == hashlib.sha256(b"0.0,1.0,2.0").hexdigest()


def test_packets(spark):
    from documents import MODEL
    from test_contracts import NESTED

    docs = [(1, NESTED, MODEL), (2, changed(NESTED, {"event.participants": ["a"]}), MODEL), (3, NESTED, changed(MODEL, {"calibration_status": "unknown"}))]
    df = spark.createDataFrame([(k, json.dumps(m), json.dumps(o)) for k, m, o in docs], "k int, m string, o string")
    markets = df.select("k", F.try_parse_json("m").alias("market_snapshot"))
    models = df.select("k", F.try_parse_json("o").alias("model_output"))
    notes = spark.createDataFrame([(1, "look")], "k int, notes string")
    rows = {r.k: r for r in review.review_packets(markets, models, notes, "k", created_at="2026-07-23T18:30:00Z").collect()}
    assert [rows[k].gate for k in (1, 2, 3)] == ["HUMAN_REVIEW_REQUIRED", "BLOCKED", "BLOCKED"]
    assert rows[1].analysis.notes == "look" and rows[2].analysis.notes is None
    assert rows[1].market_snapshot_sha256 == hashlib.sha256(text_of(NESTED).encode()).hexdigest()
    assert len({r.packet_sha256 for r in rows.values()}) == 3 and rows[1].human_review.status == "pending"


def test_packets_meet_once_and_as_texts(spark):
    """Pairs and notes share one shuffle of each side, and no parsed document goes through it; repeated keys still meet crosswise."""
    from documents import MODEL
    from test_contracts import NESTED

    df = spark.createDataFrame([(k, json.dumps(NESTED), json.dumps(MODEL)) for k in (1, 1, 2, None)], "k int, m string, o string")
    markets = df.select("k", F.try_parse_json("m").alias("market_snapshot"))
    models = df.select("k", F.try_parse_json("o").alias("model_output"))
    notes = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, notes string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        packets = review.review_packets(markets, models, notes, "k", created_at="2026-07-23T18:30:00Z")
        plan = packets._jdf.queryExecution().executedPlan()
        assert plan.toString().count("Exchange hashpartitioning") == 3
        found = packets.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert sorted((r.k, r.analysis.notes or "") for r in found) == [(1, "a")] * 4 + [(1, "b")] * 4 + [(2, "")]
    assert {r.gate for r in found} == {"HUMAN_REVIEW_REQUIRED"}
    assert {r.market_snapshot_sha256 for r in found} == {hashlib.sha256(r.market_snapshot.encode()).hexdigest() for r in found}


def test_number_texts_read_back_and_are_the_same_in_other_engines(spark):
    rnd = random.Random(1)
    known = {0.0: "0", -0.0: "0", 8.0: "8", -12345678.0: "-12345678", 0.1: "1e-01", 0.46: "4.6e-01", 1e15: "1e+15", 123456789012345.0: "123456789012345", 2.5: "2.5e+00", 1e23: "1e+23", 2e-3: "2e-03", 0.1 + 0.2: "5404319552844596p-54", -1 / 3: "-6004799503160661p-54", float("inf"): "Infinity"}
    drawn = [rnd.uniform(-1, 1) * 10 ** rnd.randrange(-320, 300) for _ in range(3000)] + [round(rnd.uniform(0, 1000), 4) for _ in range(2000)] + [2.0**e * f for e in range(-1060, 1000, 97) for f in (1, 1 - 2.0**-53, 1 + 2.0**-52)] + [5e-324, 2.2250738585072014e-308]
    df = spark.createDataFrame([(x,) for x in [*known, *drawn]], "x double").select("x", number_text(F.col("x")).alias("t"))
    rows = {x: t for x, t in df.collect()}
    for x, t in rows.items():
        assert x not in known or t == known[x]
        if "p" in t:
            mantissa, power = t.split("p")
            assert math.ldexp(int(mantissa), int(power)) == x and (float(f"{x:.14e}") != x or abs(x) < 1e-300)
        else:
            assert float(t) == x and (x.is_integer() and abs(x) < 1e15 or x == math.inf or t == re.sub(r"\.?0+e", "e", f"{x:.14e}"))
    values = ", ".join(f"({x!r}::DOUBLE)" for x in rows if x != math.inf)
    assert all(rows[x] == t for x, t in duckdb.sql(f"SELECT x, {views.number_sql('x')} FROM (VALUES {values}) t(x)").fetchall())
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) AS x").select(number_text(F.col("x"))).first()[0] is None


def test_canonical_text_keeps_texts_and_numbers_apart(spark):
    df = spark.createDataFrame([(1.5, "1.5e+00", "\x021.5e+00", [2.0, None], ["\x02"], (0.25, None))], "a double, b string, c string, d array<double>, e array<string>, f struct<y:double,x:string>")
    text = df.select(canonical_text(df, df.columns)).first()[0]
    assert text == '{"a":1.5e+00,"b":"1.5e+00","c":"\\u0002\\u00021.5e+00","d":[2,null],"e":["\\u0002\\u0002"],"f":{"x":null,"y":2.5e-01}}'


def test_many_logs_lie_in_few_folders(spark, folder):
    """Buckets bound the folders; a reading for some logs opens their buckets alone; compaction keeps every record."""
    schema = "log_id string, seq long, reason string, previous_record_sha256 string, record_sha256 string"
    records = lambda low, high, seq: spark.range(low, high).select(F.concat(F.lit("L"), "id").alias("log_id"), F.lit(seq).cast("long").alias("seq"), F.lit("x").alias("reason"), F.lit(None).cast("string").alias("previous_record_sha256"), F.lit("h").alias("record_sha256"))
    path = f"{folder}/many"
    stores.append_review_log(records(0, 5000, 0).coalesce(1), path)
    stores.append_review_log(records(100, 120, 1).coalesce(1), path)
    folders = [f for f in os.listdir(path) if f.startswith("_bucket=")]
    assert len(folders) <= stores.LOG_BUCKETS
    typed = spark.createDataFrame([], schema).schema
    wanted = spark.createDataFrame([("L105",), ("L7",), ("none",)], "log_id string")
    some = stores.read_review_log(spark, path, typed, logs=wanted)
    assert sorted((r.log_id, r.seq) for r in some.collect()) == [("L105", 0), ("L105", 1), ("L7", 0)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan
    stores.compact_review_log(spark, path, typed, f"{folder}/compact")
    whole = stores.read_review_log(spark, f"{folder}/compact", typed)
    assert whole.count() == 5020 and whole.exceptAll(stores.read_review_log(spark, path, typed)).isEmpty()
    assert len(spark.read.json(f"{folder}/compact").inputFiles()) <= stores.LOG_BUCKETS
