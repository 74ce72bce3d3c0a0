"""Running totals, positions and carried values over ordered groups of any size.

A plain window puts a whole group in one task. Here the rows are range-shuffled
on (group, order), so every task holds one bounded block whatever the group
sizes are; blocks are summarised to one row each, the summaries are scanned,
and the carry is joined back. Results equal the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewright.session import cut_lineage, written

BLOCK = "_block"
ROWS_PER_BLOCK_CONF = "spark.linewright.rowsPerBlock"
DEFAULT_ROWS_PER_BLOCK = 500_000


def rows_per_block(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_BLOCK_CONF, str(DEFAULT_ROWS_PER_BLOCK)))


def range_blocks(df: DataFrame, keys: Sequence[str], blocks: int, block_rows: int) -> DataFrame:
    """Number blocks of at most ``block_rows`` rows in key order.

    The range shuffle has no more partitions than ``spark.sql.shuffle.partitions``,
    so its bounds stay small on the driver; a partition holds several blocks, cut
    from its sorted rows. Numbers grow with the keys and have gaps.
    """
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(max(1, min(blocks, most)), *keys).sortWithinPartitions(*keys)
    row = F.monotonically_increasing_id()
    in_partition = row.bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(BLOCK, row - in_partition + F.floor(in_partition / block_rows))


def attach(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join ``side`` (one row per key) on null-safe keys, keeping df's keys."""
    renamed = side.select(
        *[F.col(k).alias(f"_side_{k}") for k in keys],
        *[c for c in side.columns if c not in keys],
    )
    condition = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"_side_{k}"))
        condition = term if condition is None else condition & term
    return df.join(renamed, condition, "left").drop(*[f"_side_{k}" for k in keys])


def small_side(side: DataFrame, *, most: int = 10_000) -> DataFrame:
    """Ask for a broadcast only when a bounded look shows at most ``most`` rows.

    For sides whose key may be the same on most rows (a policy, a model version);
    a larger side stays a shuffled join, split on hot keys by adaptive execution.
    """
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def ordered_scan(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    *,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    latest: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    peaks: Mapping[str, str] | None = None,
    position: str | None = None,
    before: bool = False,
    block_rows: int | None = None,
    rows: int | None = None,
    as_table: bool = False,
) -> DataFrame:
    """Add ordered running columns to ``df``.

    ``sums`` / ``maxima`` / ``latest`` are running sum, running maximum and last
    non-null value up to the row (``before=True``: strictly before it).
    ``previous`` is the value on the preceding row; ``position`` a dense 0-based
    index. ``peaks`` are running maxima of named ``sums``, from the same scan: a block's
    state is its total and its highest prefix, and two states in a row merge into
    (a + b, max(peak a, a + peak b)). ``order`` must be a total order within a group. ``rows`` is an upper
    bound on the row count when the caller knows one cheaply; otherwise the rows
    are counted. ``as_table``: blocks are kept as a compressed table, for columns of plain types.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    latest, previous, peaks = dict(latest or {}), dict(previous or {}), dict(peaks or {})
    if peaks and (before or not set(peaks.values()) <= set(sums)):
        raise ValueError("peaks need a named sum up to the row itself")
    group, order = list(group), list(order)
    limit = block_rows or rows_per_block(df.sparkSession)
    blocks = max(1, math.ceil((df.count() if rows is None else rows) / limit))

    inputs = {**sums, **maxima, **latest, **previous}
    base = df.withColumns({f"_in_{name}": expr for name, expr in inputs.items()})
    # One block holds everything that exists, so the plain window is already bounded.
    single = blocks == 1
    if not single:
        base = range_blocks(base, [*group, *order], blocks, limit)
    within = Window.partitionBy(*group, *([] if single else [BLOCK])).orderBy(*order)
    frame = within.rowsBetween(Window.unboundedPreceding, -1 if before else 0)

    local = {}
    for name in sums:
        local[f"_at_{name}"] = F.sum(f"_in_{name}").over(frame)
    for name in maxima:
        local[f"_at_{name}"] = F.max(f"_in_{name}").over(frame)
    for name in latest:
        local[f"_at_{name}"] = F.last(f"_in_{name}", ignorenulls=True).over(frame)
    for name in previous:
        local[f"_at_{name}"] = F.lag(F.struct(f"_in_{name}")).over(within)
    if position:
        local["_at_position"] = F.row_number().over(within).cast("long") - 1
    scanned = base.withColumns(local)
    # The same partitions in the same order: no shuffle or sort of its own.
    scanned = scanned.withColumns({f"_at_{n}": F.max(F.coalesce(F.col(f"_at_{of}"), F.lit(0))).over(frame) for n, of in peaks.items()})

    if single:
        final = {name: F.coalesce(F.col(f"_at_{name}"), F.lit(0)) for name in sums}
        final |= {name: F.col(f"_at_{name}") for name in [*maxima, *latest, *peaks]}
        final |= {name: F.col(f"_at_{name}")[f"_in_{name}"] for name in previous}
        if position:
            final[position] = F.col("_at_position")
        return scanned.select(*_untouched(df, final), *[e.alias(n) for n, e in final.items()])

    scanned = written(scanned, "scan") if as_table else cut_lineage(scanned)
    place = F.struct(*order)
    summary = []
    for name in sums:
        summary.append(F.sum(f"_in_{name}").alias(f"_tot_{name}"))
    for name in maxima:
        summary.append(F.max(f"_in_{name}").alias(f"_tot_{name}"))
    for name in peaks:
        summary.append(F.max(f"_at_{name}").alias(f"_tot_{name}"))
    for name in latest:
        seen = F.when(F.col(f"_in_{name}").isNotNull(), place)
        summary.append(F.max_by(f"_in_{name}", seen).alias(f"_tot_{name}"))
    for name in previous:
        summary.append(F.max_by(F.struct(f"_in_{name}"), place).alias(f"_tot_{name}"))
    if position:
        summary.append(F.count(F.lit(1)).alias("_tot_position"))
    totals = scanned.groupBy(*group, BLOCK).agg(*summary)

    across = Window.partitionBy(*group).orderBy(BLOCK)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.sum(f"_tot_{n}").over(earlier).alias(f"_carry_{n}") for n in sums]
    carry += [F.max(f"_tot_{n}").over(earlier).alias(f"_carry_{n}") for n in maxima]
    carry += [F.last(f"_tot_{n}", ignorenulls=True).over(earlier).alias(f"_carry_{n}") for n in latest]
    carry += [F.lag(f"_tot_{n}").over(across).alias(f"_carry_{n}") for n in previous]
    if position:
        carry.append(F.sum("_tot_position").over(earlier).alias("_carry_position"))
    carried = totals.select(*group, BLOCK, *carry, *[f"_tot_{n}" for n in peaks])
    high = {n: F.coalesce(F.col(f"_carry_{of}"), F.lit(0)) + F.col(f"_tot_{n}") for n, of in peaks.items()}
    carried = carried.withColumns({f"_carry_{n}": F.max(e).over(earlier) for n, e in high.items()}).drop(*[f"_tot_{n}" for n in peaks])
    joined = attach(scanned, carried, [*group, BLOCK])

    final = {}
    for name in sums:
        final[name] = F.coalesce(f"_carry_{name}", F.lit(0)) + F.coalesce(f"_at_{name}", F.lit(0))
    for name in maxima:
        final[name] = F.greatest(f"_carry_{name}", f"_at_{name}")
    for name, of in peaks.items():
        final[name] = F.greatest(F.col(f"_carry_{name}"), F.coalesce(F.col(f"_carry_{of}"), F.lit(0)) + F.col(f"_at_{name}"))
    for name in latest:
        final[name] = F.coalesce(f"_at_{name}", f"_carry_{name}")
    for name in previous:
        final[name] = F.coalesce(f"_at_{name}", f"_carry_{name}")[f"_in_{name}"]
    if position:
        final[position] = F.coalesce(F.col("_carry_position"), F.lit(0)) + F.col("_at_position")
    return joined.select(*_untouched(df, final), *[e.alias(n) for n, e in final.items()])


def _untouched(df: DataFrame, final: Mapping[str, Column]) -> list[str]:
    return [c for c in df.columns if c not in final]


def latest_per_key(df: DataFrame, keys: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    """The row with the greatest ``newest`` per key, by a pre-aggregated maximum."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*newest)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    *,
    payload: str,
    tiebreak: Sequence[str] = (),
    block_rows: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Attach to each left row the newest right row of its key not after it.

    The right row arrives as one struct column ``payload`` (null if none). Both
    sides are merged in time order and the last right row is carried forward, so
    no pairs of rows are formed. Right rows without a time or with a NULL key
    match nothing, and neither do left rows with a NULL key.
    """
    usable = F.col(right_time).isNotNull()
    for key in keys:
        usable = usable & F.col(key).isNotNull()
    right = right.where(usable)
    moment = F.col(left_time)
    left_rows = left.select(
        *keys, moment.alias("_when"), F.lit(1).alias("_side"),
        F.struct(*left.columns).alias("_left"), F.lit(None).cast(_struct_ddl(right)).alias("_right"),
        F.lit(None).cast("string").alias("_tie"), F.xxhash64(*[F.col(c) for c in left.columns if _hashable(left, c)]).alias("_row_key"),
    )
    tie = F.to_json(F.struct(*tiebreak)) if tiebreak else F.lit("")
    right_rows = right.select(
        *keys, F.col(right_time).alias("_when"), F.lit(0).alias("_side"),
        F.lit(None).cast(_struct_ddl(left)).alias("_left"), F.struct(*right.columns).alias("_right"),
        tie.alias("_tie"), F.lit(0).cast("long").alias("_row_key"),
    )
    merged = left_rows.unionByName(right_rows)
    carried = ordered_scan(
        merged, keys, ["_when", "_side", "_tie", "_row_key"],
        latest={payload: F.col("_right")}, block_rows=block_rows, rows=rows,
    )
    return carried.where(F.col("_side") == 1).select("_left.*", payload)


def asof_ids(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    *,
    row_id: str,
    block_rows: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """``left`` with ``row_id`` of the newest right row of its key not after it (null if none).

    ``asof_join`` for wide rows: only keys, times and ids go through the shuffle,
    the sort and the scan; the caller joins whatever it needs by id afterwards. Give
    ``left`` as the few columns that tell its rows apart. Of right rows of one key
    and time the greatest id counts.
    """
    usable = F.col(right_time).isNotNull()
    for key in keys:
        usable = usable & F.col(key).isNotNull()
    others = [c for c in left.columns if c not in keys]
    types = {c: left.schema[c].dataType for c in others}
    left_rows = left.select(*keys, *[F.col(c).alias(f"_l_{c}") for c in others], F.col(left_time).alias("_when"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_r_id"))
    right_rows = right.where(usable).groupBy(*keys, F.col(right_time).alias("_when")).agg(F.max(row_id).alias("_r_id")).select(
        *keys, *[F.lit(None).cast(t).alias(f"_l_{c}") for c, t in types.items()], "_when", F.lit(0).alias("_side"), "_r_id"
    )
    merged = left_rows.unionByName(right_rows)
    carried = ordered_scan(
        merged, keys, ["_when", "_side", *[f"_l_{c}" for c in others]], latest={row_id: F.col("_r_id")}, block_rows=block_rows, rows=rows, as_table=True,
    )
    return carried.where(F.col("_side") == 1).select(*[F.col(c) if c in keys else F.col(f"_l_{c}").alias(c) for c in left.columns], row_id)


def with_row_ids(df: DataFrame, keys: Sequence[str], time: str, row_id: str, *, tiebreak: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(``df`` with ``row_id``, written once; its keys, time and id, one row per key and time).

    Of rows of one key and time the one with the greatest text of ``tiebreak`` is
    in the second table. Only such rows have their text looked at.
    """
    whole = written(df.withColumn(row_id, F.monotonically_increasing_id()), "rows")
    slim = whole.select(*keys, time, row_id)
    moment = [*keys, time]
    tied = slim.groupBy(*moment).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*moment)
    if not tiebreak or tied.isEmpty():
        return whole, slim
    among = attach(whole, tied.withColumn("_tied", F.lit(True)), moment).where("_tied")
    best = among.groupBy(*moment).agg(F.max_by(row_id, F.struct(F.to_json(F.struct(*tiebreak)), row_id)).alias("_best"))
    return whole, attach(slim, best, moment).where(F.col("_best").isNull() | (F.col("_best") == F.col(row_id))).drop("_best")


def _struct_ddl(df: DataFrame):
    return df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType


def _hashable(df: DataFrame, name: str) -> bool:
    return "map" not in df.schema[name].dataType.simpleString() and "variant" not in df.schema[name].dataType.simpleString()
