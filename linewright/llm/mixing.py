"""Mixing sources to target weights along a time-varying curriculum.

Every source has a schedule: a piecewise linear weight over training time 0..1,
scaled so that its integral is 1. A source's demand for words up to time t is
its target times the integral of its schedule. The words it gives stand in a
fixed order (documents by hash, pass after pass), and a document is needed at
the time at which the demand has reached its first word: the inverse of the
integral, a square root inside each piece. Documents are range-sorted by it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions.ordered import attach
from linewright.llm.common import BLANK, free_name, stored, text_of

WEIGHTS = (5.0, 2.0, 1.0)
CEILING = 3.0
#: (time, weight) knots by weight class: the first grows over time, the second stays level, the third fades.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
#: Documents of a source that one window holds, on average.
ROWS_PER_BUCKET = 50_000


def word_count(text: Column) -> Column:
    """Number of runs of characters that are not blank."""
    trimmed = F.regexp_replace(text, rf"^{BLANK}|{BLANK}\z", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, BLANK))).cast("long")


def water_fill(sources: DataFrame, ceiling: float) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``.

    Targets share the sum of all sizes by weight, but none is above ``ceiling``
    times its source's size; the excess is shared again by weight among the
    others until none is above. One small aggregation a round, no rows on the driver.
    """
    state = stored(sources.withColumn("full", F.col("source_size") == 0), "sources")
    total = state.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        capped, open_ = state.agg(F.sum(F.expr(f"if(full, source_size * {ceiling!r}D, 0D)")), F.sum(F.expr("if(full, 0D, weight)"))).first()
        if not open_:
            break
        level = (total - capped) / open_
        over = (~F.col("full")) & (F.col("weight") * F.lit(level) > F.col("source_size") * F.lit(ceiling))
        if state.where(over).isEmpty():
            break
        state = stored(state.withColumn("full", F.col("full") | over), "sources")
    target = F.when(F.col("full"), F.col("source_size") * F.lit(ceiling)).otherwise(F.col("weight") * F.lit(level))
    return state.withColumn("target", target.cast("double")).drop("full")


def needed_at(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of the schedule, scaled to 1 at its end, reaches ``share``."""
    pieces, reached = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area = (t1 - t0) * (w0 + w1) / 2
        pieces.append((t0, t1, w0, w1, reached, reached + area))
        reached += area
    if reached <= 0 or min(w for _, w in knots) < 0:
        raise ValueError("a schedule needs weights of at least 0 and a positive integral")
    out = None
    for t0, t1, w0, w1, low, high in reversed(pieces):
        x = F.greatest(share * reached - low, F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * x, F.lit(0.0)))
        # x = w0 u + slope u^2 / 2, in the form that holds for slope 0 as well
        u = F.when(x <= 0, F.lit(0.0)).otherwise(2 * x / (F.lit(w0) + root))
        at = F.least(F.lit(t0) + u, F.lit(t1))
        out = at if out is None else F.when(share * reached < high, at).otherwise(out)
    return out


def curriculum_plan(docs: DataFrame, *, keep: list[str], text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, ceiling: float = CEILING, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> DataFrame:
    """One row per document: ``keep``, size, source_size, target, taken, position, takes.

    Sources in code-point order, null last, get the weights in turn. ``takes`` has
    an entry (pass, position, words) for each time the document is read; the last
    one of a source may be cut, so that its words meet the target. position is
    the first one's (null: not taken). Size counts blank-separated words; a null
    text has none. Order within a source is by hash of the kept columns and the
    text, so reruns agree; repeated rows are documents of their own.
    """
    size = word_count(text_of(text))
    # The order of repeated rows is settled by writing the row numbers down.
    slim = docs.select(*keep, F.col(source).alias("_source"), size.alias("size"), F.xxhash64(*keep, F.col(text)).alias("_order"))
    slim = stored(slim.withColumn("_row", F.monotonically_increasing_id()), "sizes")
    totals = slim.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    ranked = Window.orderBy(F.col("_source").isNull(), F.col("_source"))
    numbered = totals.withColumn("_class", (F.row_number().over(ranked) - 1) % len(weights))
    named = stored(numbered.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[F.col("_class")]), "weights")
    filled = stored(water_fill(named, ceiling), "targets")

    # Running sums in two steps: inside buckets of the hash order, and over the buckets of a source.
    count = slim.count()
    buckets = 1 << max(4, math.ceil(math.log2(max(1, count / ROWS_PER_BUCKET))))
    bits = buckets.bit_length() - 1
    bucketed = slim.withColumn("_bucket", F.shiftright("_order", 64 - bits))
    sums = bucketed.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_order", "_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = attach(bucketed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))), starts, ["_source", "_bucket"])
    placed = attach(placed, filled.drop("weight", "_rows"), ["_source"]).withColumn("_from", F.col("_start") + F.col("_in"))

    passes = F.expr(f"sequence(0, {math.ceil(ceiling) - 1})")
    takes = F.filter(
        F.transform(
            passes,
            lambda p: F.struct(
                p.alias("pass"),
                ((p * F.col("source_size") + F.col("_from")) / F.greatest("target", F.lit(1.0))).alias("share"),
                F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.floor("target") - p * F.col("source_size") - F.col("_from"))).alias("words"),
            ),
        ),
        lambda x: x["words"] > 0,
    )

    def at(share: Column) -> Column:
        out = None
        for i in range(len(weights)):
            here = needed_at(share, schedules[i % len(schedules)])
            out = F.when(F.col("_class") == i, here) if out is None else out.when(F.col("_class") == i, here)
        return out

    timed = placed.withColumn("_takes", takes).withColumn(
        "takes", F.transform("_takes", lambda x: F.struct(x["pass"].alias("pass"), at(x["share"]).alias("position"), x["words"].alias("words")))
    )
    return timed.select(
        *keep,
        "size",
        "source_size",
        "target",
        F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("taken"),
        F.get("takes", F.lit(0))["position"].alias("position"),
        "takes",
        F.col("_order").alias("order_hash"),
    )


def by_position(df: DataFrame, *ties: str) -> DataFrame:
    """Range-sorted by training position, rows without one last."""
    order = [F.col("position").asc_nulls_last(), *[F.col(c) for c in ties]]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def training_order(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The mix: a row for each time a document is read, with all columns of ``docs``.

    Adds pass, position and words (those to read), range-sorted by position.
    """
    key, copy = free_name("mix_key", docs.columns), free_name("mix_copy", docs.columns)
    own = docs.withColumn(key, F.xxhash64(id_column, source, text))
    plan = stored(curriculum_plan(own, keep=[key], text=text, source=source, **settings).select(key, "position", "taken", "takes"), "plan")
    # Only rows that repeat id, source and text need numbers to tell them apart.
    if plan.groupBy(key).count().where("count > 1").isEmpty():
        own, plan = own.withColumn(copy, F.lit(1)), plan.withColumn(copy, F.lit(1))
    else:
        own = own.withColumn(copy, F.row_number().over(Window.partitionBy(key).orderBy(key)))
        plan = plan.withColumn(copy, F.row_number().over(Window.partitionBy(key).orderBy(F.col("position").asc_nulls_last(), F.col("taken").desc())))
    rows = plan.where("taken > 0").select(key, copy, F.explode("takes").alias("_take"))
    added = {n: free_name(n, docs.columns) for n in ("pass", "position", "words")}
    out = own.join(rows, [key, copy]).select(*docs.columns, *[F.col(f"_take.{n}").alias(a) for n, a in added.items()], key)
    order = [F.col(added["position"]), F.col(key), F.col(added["pass"])]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).drop(key)
