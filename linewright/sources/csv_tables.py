"""CSV sources: declared columns, headers checked file by file, bad rows and files kept apart."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright import fixed_values as fixed
from linewright.functions.moments import zoned_instant

#: A header is looked for in so many first characters of a file.
HEADER_CHARACTERS = 1 << 20


def _header(spark: SparkSession, name: str) -> tuple[str, ...]:
    """The names in a file's first record; Hadoop opens the file, so it may lie where Spark reads, compressed or not."""
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark._jsc.hadoopConfiguration()
    at = hadoop.fs.Path(name)
    stream = at.getFileSystem(conf).open(at)
    try:
        codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
        java = spark._jvm.java.io
        lines = java.BufferedReader(java.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        text = ""
        while len(text) < HEADER_CHARACTERS:
            line = lines.readLine()
            if line is None:
                break
            text += line + "\n"
            if text.strip() and text.count('"') % 2 == 0:
                break
    finally:
        stream.close()
    return tuple(next(csv.reader(io.StringIO(text.lstrip("\ufeff").lstrip("\n"))), ()))


def headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Header -> the files that carry it. The driver reads a first record per file, several files at a time."""
    files = sorted(spark.read.option("recursiveFileLookup", "false").text(path).inputFiles())
    with ThreadPoolExecutor(16) as pool:
        found = list(pool.map(lambda name: _header(spark, name), files))
    out: dict[tuple[str, ...], list[str]] = {}
    for name, header in zip(files, found):
        out.setdefault(header, []).append(name)
    return out


def header_faults(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """file, missing: the files that lack required columns, and which; no data row is read."""
    rows = [(name, sorted(set(required) - set(h))) for h, names in headers(spark, path).items() if set(required) - set(h) for name in names]
    return spark.createDataFrame(rows, "file string, missing array<string>")


def _read_text_columns(spark: SparkSession, path: str, required: Sequence[str], multi_line: bool) -> DataFrame:
    """All columns as text, of all files that have the required ones, in any order and among any others.

    Files are read together by header and united by name; a column that a file lacks is
    NULL in its rows. ``header_faults`` lists the files left out; if that would be all, the job ends.
    ``multi_line`` allows line breaks inside quotes and makes each file one task;
    without it large files are split.
    """
    found = headers(spark, path)
    sound = {h: names for h, names in found.items() if not set(required) - set(h) and len(set(h)) == len(h)}
    if not sound:
        raise ValueError(f"columns.missing: {sorted(set(required) - set(next(iter(found), ())))}")
    parts = []
    for header, names in sound.items():
        reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("enforceSchema", False)
        parts.append(reader.schema(", ".join(f"`{c.replace('`', '``')}` string" for c in header)).csv(names))
    return reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), parts)


def _filled(name: str):
    return F.nullif(F.trim(F.coalesce(F.col(name), F.lit(""))), F.lit(""))


def read_market_csv(spark: SparkSession, path: str, *, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Two-outcome market rows as nested snapshots, and the rejected rows with a reason (a code, after ``:`` the column).

    Sport is upper-cased; a blank line or venue is NULL; all three odds must
    exceed one.
    """
    rows = _read_text_columns(spark, path, fixed.MARKET_CSV_REQUIRED, multi_line)
    if "venue" not in rows.columns:
        rows = rows.withColumn("venue", F.lit(None).cast("string"))
    must = [c for c in fixed.MARKET_CSV_REQUIRED if c != "line"]
    odds = ["odds_decimal", "outcome_1_odds_decimal", "outcome_2_odds_decimal"]
    clean = rows.withColumns({c: _filled(c) for c in [*fixed.MARKET_CSV_REQUIRED, "venue"]})
    price = {c: F.col(c).try_cast("double") for c in odds}
    reason = F.lit(None).cast("string")
    reason = F.when(F.col("line").isNotNull() & F.col("line").try_cast("double").isNull(), "not_a_number:line").otherwise(reason)
    low = F.lit(False)
    for c in odds:
        low = low | F.coalesce(price[c] <= 1, F.lit(False))
        reason = F.when(price[c].isNull(), f"not_a_number:{c}").otherwise(reason)
    reason = F.when(low, "odds.not_above_one").otherwise(reason)
    for c in reversed(must):
        reason = F.when(F.col(c).isNull(), f"blank:{c}").otherwise(reason)
    checked = clean.withColumn("rejection", reason)
    outcome = lambda n: F.struct(F.col(f"outcome_{n}_selection").alias("selection"), price[f"outcome_{n}_odds_decimal"].alias("odds_decimal"))
    event = F.struct(
        "event_id", F.upper("sport").alias("sport"), "competition", "event_start_at", "status",
        F.array("participant_1", "participant_2").alias("participants"), "venue", "source", "retrieved_at",
    )
    market = F.struct(
        "market_id", "book", "market_type", "period", F.col("line").try_cast("double").alias("line"), "selection",
        price["odds_decimal"].alias("odds_decimal"), "snapshot_at", F.array(outcome(1), outcome(2)).alias("outcomes"),
    )
    good = checked.where(F.col("rejection").isNull()).select("event_id", event.alias("event"), market.alias("market"))
    return good, checked.where(F.col("rejection").isNotNull())


def read_training_csv(
    spark: SparkSession, path: str, *, features: Sequence[str], target: str, line: str, over_odds: str, under_odds: str, timestamp: str,
    multi_line: bool = True,
) -> DataFrame:
    """Features as doubles, target, line, two odds, timestamp text and its instant.

    Text that does not parse is NULL here, and so is the instant of a timestamp that
    names no zone; ``training_faults`` reports both.
    """
    if not features:
        raise ValueError("features.none")
    rows = _read_text_columns(spark, path, [*features, target, line, over_odds, under_odds, timestamp], multi_line)
    if rows.isEmpty():
        raise ValueError("rows.none")
    number = lambda c, n: F.col(c).try_cast("double").alias(n)
    keep = [c for c in rows.columns if c in ("model_version", "grp")]
    return rows.select(
        *keep, *[number(f, f) for f in features], number(target, "y"), number(line, "line"), number(over_odds, "over_odds"),
        number(under_odds, "under_odds"), F.col(timestamp).alias("ts_text"), zoned_instant(F.col(timestamp)).alias("ts"),
    )


def read_bet_log(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Bet log with exact money; ``stake_eur`` / ``profit_loss_eur`` fall back to the plain names."""
    rows = _read_text_columns(spark, path, ["result"], multi_line)
    have = set(rows.columns)

    def money(*names: str):
        options = [_filled(n).try_cast("decimal(20,4)") for n in names if n in have]
        return F.coalesce(*options, F.lit(0).cast("decimal(20,4)"))

    def number(name: str):
        return _filled(name).try_cast("double") if name in have else F.lit(None).cast("double")

    return rows.withColumns({
        "stake": money("stake_eur", "stake"),
        "profit": money("profit_loss_eur", "profit_loss"),
        "p": number("model_probability"),
        "odds_taken": number("odds_taken_decimal"),
        "closing_odds": number("closing_odds_decimal"),
        "entry_no_vig": number("market_no_vig_probability"),
        "closing_no_vig": number("closing_market_no_vig_probability"),
    })
