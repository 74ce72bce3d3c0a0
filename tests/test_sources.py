import csv
import gzip
import json
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from documents import MODEL
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from linewright import fixed_values as fixed
from linewright.operators import contracts, history, performance
from linewright.sources import csv_tables, documents, stores
from linewright.streaming import gates as stream

MARKET = {
    "event_id": "E", "sport": "mlb", "competition": "MLB", "event_start_at": "2026-07-23T20:00:00Z", "status": "scheduled",
    "participant_1": "a", "participant_2": "b", "source": "s", "retrieved_at": "2026-07-23T18:00:00Z", "market_id": "M", "book": "k",
    "market_type": "ml", "period": "full", "line": " ", "selection": "a", "odds_decimal": "2.1", "snapshot_at": "2026-07-23T18:00:00Z",
    "outcome_1_selection": "a", "outcome_1_odds_decimal": "2.1", "outcome_2_selection": "b", "outcome_2_odds_decimal": "1.8", "venue": "",
}


def write(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, list(rows[0]))
        out.writeheader()
        out.writerows(rows)
    return str(path)


def test_market_csv(spark, tmp_path):
    rows = [MARKET, MARKET | {"line": "8.5", "venue": "V"}, MARKET | {"odds_decimal": "1"}, MARKET | {"book": " "}, MARKET | {"outcome_2_odds_decimal": "x"}, MARKET | {"line": "high"}]
    good, bad = csv_tables.read_market_csv(spark, write(tmp_path / "m.csv", rows))
    got = sorted(good.collect(), key=lambda r: r.market.line or 0)
    assert [r.market.line for r in got] == [None, 8.5] and got[0].event.sport == "MLB" and got[0].event.venue is None
    assert list(got[0].event.participants) == ["a", "b"] and got[0].market.outcomes[1].odds_decimal == 1.8
    assert sorted(r.rejection for r in bad.collect()) == [
        "blank:book", "not_a_number:line", "not_a_number:outcome_2_odds_decimal", "odds.not_above_one",
    ]
    flat = documents.flatten_snapshots(good, target_market="t", settlement_rules="s", namespace=fixed.NAMESPACE)
    assert contracts.contract_errors(flat, "market", contracts.market_snapshot).where("size(errors) > 0").isEmpty()
    with pytest.raises(ValueError, match="columns.missing.*book"):
        csv_tables.read_market_csv(spark, write(tmp_path / "n.csv", [{k: v for k, v in MARKET.items() if k != "book"}]))


def test_training_csv(spark, tmp_path):
    rows = [{"a": "1", "t": "2.5", "l": "2", "o": "1.9", "u": "1.95", "when": "2026-01-01T00:00:00Z"}]
    names = dict(features=["a"], target="t", line="l", over_odds="o", under_odds="u", timestamp="when")
    r = csv_tables.read_training_csv(spark, write(tmp_path / "t.csv", rows), **names).first()
    assert (r.a, r.y, r.line, r.over_odds, r.under_odds) == (1.0, 2.5, 2.0, 1.9, 1.95) and r.ts is not None
    with pytest.raises(ValueError, match="columns.missing.*zz"):
        csv_tables.read_training_csv(spark, str(tmp_path / "t.csv"), **(names | {"features": ["zz"]}))
    (tmp_path / "e.csv").write_text("a,t,l,o,u,when\n")
    with pytest.raises(ValueError, match="rows.none"):
        csv_tables.read_training_csv(spark, str(tmp_path / "e.csv"), **names)


def test_bet_log_metrics(spark, tmp_path):
    base = dict.fromkeys(fixed.BET_LOG_COLUMNS, "")
    win = base | {
        "result": "WIN", "stake_eur": "500", "profit_loss_eur": "550.00", "model_probability": "0.5100", "odds_taken_decimal": "2.10",
        "closing_odds_decimal": "2.02", "model_version": "1",
    }
    bets = csv_tables.read_bet_log(spark, write(tmp_path / "b.csv", [win, base | {"result": "VOID", "stake_eur": "9"}]))
    r = performance.settled_summary(bets).first()
    assert (r.bets, r.stake, r.profit, r.roi) == (1, 500.0, 550.0, 1.1)
    assert (r.brier, r.log_loss, r.avg_price_clv) == pytest.approx((0.2401, 0.6733445532637656, 0.03960396039603964), abs=1e-12)
    odd = [win | {"stake_eur": "", "model_probability": "1.5", "closing_odds_decimal": "0"}, win | {"stake_eur": "0", "closing_odds_decimal": "n/a", "model_probability": ""}]
    r = performance.settled_summary(csv_tables.read_bet_log(spark, write(tmp_path / "c.csv", odd))).first()
    assert (r.bets, r.stake, r.roi, r.brier, r.log_loss, r.avg_price_clv) == (2, 0.0, None, None, None, None)
    plain = [{"result": "LOSS", "stake": "10", "profit_loss": "-10"}]
    r = performance.settled_summary(csv_tables.read_bet_log(spark, write(tmp_path / "d.csv", plain))).first()
    assert (r.stake, r.profit, r.roi) == (10.0, -10.0, -1.0)


@pytest.mark.parametrize("multi_line", [True, False])
def test_files_of_one_folder_may_differ_in_their_headers(spark, tmp_path, multi_line):
    """Reordered and widened files are read by name; files that lack a column, are empty or repeat a name are listed, and end no job."""
    folder = tmp_path / "bets"
    folder.mkdir()
    write(folder / "a.csv", [{"result": "WIN", "stake_eur": "10", "profit_loss_eur": "9"}] * 3)
    write(folder / "b.csv", [{"profit_loss_eur": "9", "result": "WIN", "stake_eur": "10"}] * 2)
    write(folder / "c.csv", [{"extra, one": "x", "result": "WIN", "stake_eur": "10", "profit_loss_eur": "9", "odds_taken_decimal": "2.5"}])
    write(folder / "d.csv", [{"result": "LOSS", "stake": "4", "profit_loss": "-4"}])
    (folder / "e.csv").write_bytes(b"\xef\xbb\xbfresult,stake_eur,profit_loss_eur\nWIN,10,9\n")
    write(folder / "f.csv", [{"outcome": "WIN", "stake_eur": "99", "profit_loss_eur": "9"}])
    (folder / "g.csv").write_text("")
    with gzip.open(folder / "h.csv.gz", "wt") as f:
        f.write("stake_eur,result,profit_loss_eur\n10,WIN,9\n")
    rows = csv_tables.read_bet_log(spark, str(folder), multi_line=multi_line).collect()
    assert sorted((r.result, float(r.stake), float(r.profit), r.odds_taken) for r in rows if r.odds_taken is None) == [("LOSS", 4.0, -4.0, None)] + [("WIN", 10.0, 9.0, None)] * 7
    assert [(float(r.stake), r.odds_taken, r["extra, one"]) for r in rows if r.odds_taken is not None] == [(10.0, 2.5, "x")]
    faults = {r.file.rsplit("/", 1)[1]: r.missing for r in csv_tables.header_faults(spark, str(folder), ["result", "stake_eur"]).collect()}
    assert faults == {"d.csv": ["stake_eur"], "f.csv": ["result"], "g.csv": ["result", "stake_eur"]}


def test_market_files_in_any_order(spark, tmp_path):
    folder = tmp_path / "markets"
    folder.mkdir()
    write(folder / "a.csv", [MARKET])
    write(folder / "b.csv", [dict(reversed(list((MARKET | {"market_id": "N", "note": "n"}).items())))])
    write(folder / "c.csv", [{k: v for k, v in MARKET.items() if k != "venue"} | {"market_id": "O"}])
    write(folder / "d.csv", [{k: v for k, v in MARKET.items() if k != "book"}])
    good, bad = csv_tables.read_market_csv(spark, str(folder))
    assert sorted(r.market.market_id for r in good.collect()) == ["M", "N", "O"] and bad.isEmpty()
    assert [r.missing for r in csv_tables.header_faults(spark, str(folder), fixed.MARKET_CSV_REQUIRED).collect()] == [["book"]]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_training_times_need_a_zone(spark, tmp_path, zone):
    """Whatever the session's zone, a time without one is no instant and a fault of its version."""
    texts = ["2024-01-01T10:00:00Z", "2024-01-01T12:30:00+02:00", "2024-01-01 10:45:00", "2024-01-01T11:00:00", "soon", ""]
    rows = [{"model_version": "v" if n < 2 else "w", "a": str(n), "t": "1", "l": "1", "o": "1.9", "u": "1.9", "when": t} for n, t in enumerate(texts)]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        read = csv_tables.read_training_csv(spark, write(tmp_path / "t.csv", rows), features=["a"], target="t", line="l", over_odds="o", under_odds="u", timestamp="when")
        got = {r.ts_text or "": r.at for r in read.select("ts_text", F.unix_seconds("ts").alias("at")).collect()}
        assert got == dict(zip(texts, [1704103200, 1704105000, None, None, None, None]))
        faults = {r.model_version: (r.no_instant, r.usable) for r in history.training_faults(read, ["model_version"], ["a"], time="ts").collect()}
        assert faults == {"v": (0, False), "w": (4, False)}
        assert {r.ts_text for r in history.chronology_breaks(read, ["model_version"], ["a"], "ts").collect()} == set(read.where("ts IS NULL").toPandas()["ts_text"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_json_documents_and_stream(spark, tmp_path):
    lines = tmp_path / "in"
    lines.mkdir()
    (lines / "a.json").write_text("\n".join([json.dumps(MODEL), "", "[1]", "{bad", json.dumps(MODEL | {"sport": "X"})]))
    good, bad = documents.read_documents(spark, str(lines))
    assert good.count() == 2
    assert sorted(r.rejection for r in bad.collect()) == ["invalid_json", "top-level JSON value must be an object"]
    (tmp_path / "one.json").write_text(json.dumps(MODEL, indent=2))
    whole, none = documents.read_documents(spark, str(tmp_path / "one.json"), whole_files=True)
    assert whole.count() == 1 and none.isEmpty()
    checked = stream.check_stream(stream.stream_documents(spark, str(lines)), contracts.model_output)
    stream.append_checked(checked, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = sorted([e.code for e in r.errors][:1] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [] in got and ["invalid_json"] in got and ["schema.sport.enum"] in got and len(got) == 4


def test_write_once_hashes_content_not_layout(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") / 3).alias("x"))
    first = stores.write_once(df, str(tmp_path / "a"))
    assert first == stores.write_once(df.orderBy(F.desc("id")).repartition(7), str(tmp_path / "b"))
    assert first != stores.content_hash(df.where("id > 0"))
    with pytest.raises(Exception, match="(?i)exists"):
        stores.write_once(df, str(tmp_path / "a"))


def test_hash_comes_from_the_pass_that_writes(spark, tmp_path):
    """The same hash as over the stored rows, one job, also for no rows."""
    df = spark.range(1000).select("id", (F.col("id") / 7).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("t"))
    for n, table in enumerate((df, df.where("id < 0"))):
        at = str(tmp_path / f"t{n}")
        group = f"write-{n}"
        spark.sparkContext.setJobGroup(group, group)
        found = stores.write_once(table, at)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert found == stores.content_hash(spark.read.schema(table.schema).parquet(at)) and len(found) == 64
        assert len(jobs) <= 1


def test_model_entry_of_the_manifest_is_hashed(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.5).alias("y"))
    ready = VectorAssembler(inputCols=["a"], outputCol="features").transform(rows)
    fit = lambda depth: Pipeline(stages=[GBTRegressor(labelCol="y", maxIter=3, maxDepth=depth, seed=1)]).fit(ready)
    hashes = []
    for n, depth in enumerate((2, 2, 3)):
        manifest = stores.write_bundle({"rows": rows}, str(tmp_path / f"v{n}"), model=fit(depth)).collect()
        assert all(r.content_sha256 for r in manifest) and [r.name for r in manifest] == ["rows", "model"]
        hashes.append(manifest[1].content_sha256)
    assert hashes[0] == hashes[1] != hashes[2]


def test_built_once(spark, tmp_path):
    """One build however many ask, also at the same time; a build that died leaves the next one free; other inputs, other tables."""
    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)
    folder, built = str(tmp_path / "store"), []

    def build():
        built.append(1)
        time.sleep(0.5)
        return spark.read.parquet(source).select((F.col("id") * 2).alias("x"))

    key = stores.content_key("formula", stores.input_version(spark.read.parquet(source)))
    with pytest.raises(RuntimeError):
        stores.built_once(spark, folder, key, lambda: (_ for _ in ()).throw(RuntimeError("died")))
    with ThreadPoolExecutor(4) as pool:
        tables = list(pool.map(lambda _: stores.built_once(spark, folder, key, build), range(4)))
    assert all(sorted(r.x for r in t.collect()) == [0, 2, 4, 6, 8] for t in tables)
    assert len({t.inputFiles()[0].rsplit("/", 2)[1] for t in tables}) == 1
    before = len(built)
    assert stores.built_once(spark, folder, key, build).count() == 5 and len(built) == before
    spark.range(7).write.mode("overwrite").parquet(source)
    other = stores.content_key("formula", stores.input_version(spark.read.parquet(source)))
    assert other != key and stores.built_once(spark, folder, other, build).count() == 7
