import random

import pytest
from pyspark.sql import functions as F

from linewright.functions.ordered import asof_ids, asof_join, latest_per_key, ordered_scan, with_row_ids
from linewright.operators import performance


def rows(n=900, hot=0.6, seed=3):
    """One group holds most rows; times tie across groups, values repeat."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        group = "hot" if rnd.random() < hot else rnd.choice(["a", "b", None])
        out.append((group, rnd.randrange(300), i, rnd.choice([None, rnd.randrange(-5, 9)])))
    rnd.shuffle(out)
    return out


def brute(data):
    """Running sum, maximum, last value, previous value and position per row id."""
    result, by_group = {}, {}
    for g, t, i, v in data:
        by_group.setdefault(g, []).append((t, i, v))
    for g, items in by_group.items():
        total, top, last, previous = 0, None, None, None
        for place, (t, i, v) in enumerate(sorted(items, key=lambda x: (x[0], x[1]))):
            before = total
            if v is not None:
                total, top, last = total + v, v if top is None else max(top, v), v
            result[i] = (total, before, top, last, previous, place)
            previous = v
    return result


@pytest.mark.parametrize("block_rows", [10_000, 37])
def test_ordered_scan_equals_brute_force(spark, block_rows):
    data = rows()
    df = spark.createDataFrame(data, "g string, t int, id int, v int")
    scan = ordered_scan(
        df, ["g"], ["t", "id"], sums={"s": F.col("v")}, maxima={"m": F.col("v")}, latest={"l": F.col("v")},
        previous={"p": F.col("v")}, position="pos", block_rows=block_rows,
    )
    before = ordered_scan(df, ["g"], ["t", "id"], sums={"b": F.col("v")}, before=True, block_rows=block_rows)
    earlier = {r["id"]: r["b"] for r in before.collect()}
    got = {r["id"]: (r["s"], earlier[r["id"]], r["m"], r["l"], r["p"], r["pos"]) for r in scan.collect()}
    assert got == brute(data)


@pytest.mark.parametrize("block_rows", [10_000, 37])
def test_running_peaks_of_a_sum_in_one_scan(spark, block_rows):
    data = rows(seed=9)
    df = spark.createDataFrame(data, "g string, t int, id int, v int").repartition(6)
    scan = ordered_scan(df, ["g"], ["t", "id"], sums={"s": F.col("v")}, peaks={"peak": "s"}, block_rows=block_rows, rows=len(data))
    want, high = {}, {}
    for g, t, i, v in sorted(data, key=lambda r: (str(r[0]), r[1], r[2])):
        total, top = high.get(g, (0, None))
        total += v or 0
        top = total if top is None else max(top, total)
        high[g] = want[i] = total, top
    assert {r["id"]: (r["s"], r["peak"]) for r in scan.collect()} == want
    with pytest.raises(ValueError):
        ordered_scan(df, ["g"], ["t"], sums={"s": F.col("v")}, peaks={"p": "s"}, before=True)


def test_drawdown_path_shuffles_its_rows_once(spark):
    """In one block: a single exchange and a single sort of the rows for sum and peak together."""
    bets = spark.createDataFrame([("p", i, "WIN", i % 7 - 3, 1000) for i in range(50)], "k string, i int, result string, profit int, opening int")
    path = performance.drawdown_path(bets, ["k"], ["i"], starting="opening", block_rows=1000)
    plan = path._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [") + plan.count("Window(") >= 1
    executed = path._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") == 1 and executed.count("+- Sort [") + executed.count("- *(1) Sort [") <= 1


@pytest.mark.parametrize("block_rows", [10_000, 37])
def test_asof_ids_choose_as_the_join_of_whole_rows(spark, block_rows):
    """The same right rows as ``asof_join``, ties by text; wide columns stay out of the scan."""
    rnd = random.Random(6)
    left = [(i, rnd.choice(["x", "y", "z", None]), rnd.randrange(60)) for i in range(300)] + [(900, "x", None)]
    right = [(rnd.choice(["x", "y", None]), rnd.choice([None, *range(60)]), rnd.randrange(1000)) for _ in range(200)]
    ldf = spark.createDataFrame(left, "id int, k string, t int")
    rdf = spark.createDataFrame(right, "k string, at int, n int")
    want = {r["id"]: r["m"]["n"] if r["m"] else None for r in asof_join(ldf, rdf, ["k"], "t", "at", payload="m", tiebreak=["n"], block_rows=block_rows).collect()}
    whole, slim = with_row_ids(rdf, ["k"], "at", "row", tiebreak=["n"])
    assert slim.columns == ["k", "at", "row"] and whole.count() == 200
    found = asof_ids(ldf, slim, ["k"], "t", "at", row_id="row", block_rows=block_rows)
    assert {r["id"]: r["n"] for r in found.join(whole.select("row", "n"), "row", "left").collect()} == want


@pytest.mark.parametrize("block_rows", [10_000, 37])
def test_asof_join_takes_the_newest_not_later(spark, block_rows):
    rnd = random.Random(5)
    left = [(i, rnd.choice("xyz"), rnd.randrange(100)) for i in range(400)]
    right = [(rnd.choice("xy"), rnd.randrange(100), n) for n in range(300)]
    ldf = spark.createDataFrame(left, "id int, k string, t int")
    rdf = spark.createDataFrame(right, "k string, at int, n int")
    got = {r["id"]: (r["m"]["at"] if r["m"] else None) for r in asof_join(ldf, rdf, ["k"], "t", "at", payload="m", tiebreak=["n"], block_rows=block_rows).collect()}
    assert got == {i: max((at for kk, at, _ in right if kk == k and at <= t), default=None) for i, k, t in left}


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, "w")], "k string, t int, v string")
    assert sorted(map(tuple, latest_per_key(df, ["k"], [F.col("t")]).collect())) == [("a", 3, "y"), ("b", 1, "w")]


@pytest.mark.parametrize("blocks", ["one", "many"])
def test_drawdown_and_turnover_equal_brute_force(spark, blocks, request):
    if blocks == "many":
        request.getfixturevalue("small_blocks")
    rnd = random.Random(11)
    data = [("hot" if rnd.random() < 0.7 else "b", f"2024-01-{rnd.randrange(1, 29):02d} {rnd.randrange(24):02d}:00:00", i, rnd.randrange(1, 50),
             rnd.choice(["WIN", "LOSS", "OPEN"])) for i in range(500)]
    df = spark.createDataFrame(data, "g string, at string, id int, amount int, result string").select(
        "g", F.col("at").cast("timestamp").alias("at"), "at", "id", F.col("amount").cast("decimal(12,2)").alias("stake"), "result",
        F.when(F.col("result") == "WIN", F.col("amount")).otherwise(-F.col("amount")).cast("decimal(12,2)").alias("profit"),
        F.lit(1000).cast("decimal(12,2)").alias("opening"),
    ).toDF("g", "ts", "at", "id", "stake", "result", "profit", "opening")
    got = {r["g"]: r["maximum_drawdown"] for r in performance.maximum_drawdown(df, ["g"], ["ts", "id"], starting="opening").collect()}
    for g in ("hot", "b"):
        bank = peak = 1000
        worst = 0.0
        for _, at, i, amount, result in sorted((x for x in data if x[0] == g and x[4] != "OPEN"), key=lambda x: (x[1], x[2])):
            bank += amount if result == "WIN" else -amount
            peak = max(peak, bank)
            worst = max(worst, (peak - bank) / peak)
        assert got[g] == pytest.approx(worst, abs=1e-12)
    from datetime import datetime, timedelta

    rolled = performance.rolling_turnover(df, ["g"], "ts", "stake").collect()
    when = [(g, datetime.fromisoformat(at), amount) for g, at, _, amount, _ in data]
    assert len(rolled) == len({(g, t) for g, t, _ in when})
    for r in rolled:
        low = r["ts"] - timedelta(days=3)
        assert float(r["rolling_turnover"]) == sum(a for g, t, a in when if g == r["g"] and low <= t <= r["ts"])
