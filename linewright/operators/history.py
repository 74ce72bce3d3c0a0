"""Leakage-safe walk-forward history: checks, folds, and pricing by earlier residuals."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright import fixed_values as fixed
from linewright.functions import pricing
from linewright.functions.ordered import BLOCK, attach, ordered_scan, range_blocks
from linewright.functions.trees import SLOTS, BoostedTrees, TreeSettings
from linewright.session import cut_lineage, new_folder, written

POSITION = "pos"


@dataclass(frozen=True)
class WalkForward:
    min_train_size: int
    test_size: int = fixed.WALK_FORWARD_DEFAULTS["test_size"]
    min_residual_history: int = fixed.WALK_FORWARD_DEFAULTS["min_residual_history"]
    min_calibration_history: int = fixed.WALK_FORWARD_DEFAULTS["min_calibration_history"]
    minimum_validation_sample: int = fixed.WALK_FORWARD_DEFAULTS["minimum_validation_sample"]
    push_tolerance: float = fixed.PUSH_TOLERANCE

    def __post_init__(self):
        if self.min_train_size < 2:
            raise ValueError("walk_forward.min_train_size: below 2")
        if self.test_size < 1:
            raise ValueError("walk_forward.test_size: below 1")
        if min(self.min_residual_history, self.min_calibration_history) < 2:
            raise ValueError("walk_forward.history: below 2")
        if self.minimum_validation_sample < 1:
            raise ValueError("walk_forward.minimum_validation_sample: below 1")


# ---- checks ---------------------------------------------------------------------------------------


def with_position(df: DataFrame, group: Sequence[str], order: Sequence[str], *, block_rows: int | None = None) -> DataFrame:
    """Dense 0-based position by time within each group."""
    return ordered_scan(df, group, order, position=POSITION, block_rows=block_rows)


def chronology_breaks(
    df: DataFrame, group: Sequence[str], order: Sequence[str], time: str, *, block_rows: int | None = None
) -> DataFrame:
    """Rows without a time, or whose time is not strictly after the row before it; must be empty."""
    seen = ordered_scan(df, group, order, previous={"previous_time": F.col(time)}, block_rows=block_rows)
    return seen.where(F.col(time).isNull() | (F.col(time) <= F.col("previous_time")))


def training_faults(
    df: DataFrame, group: Sequence[str], features: Sequence[str], *, target="y", line="line", odds=("over_odds", "under_odds"),
    time: str | None = None,
) -> DataFrame:
    """Per group: rows, non-finite inputs, odds not above one; ``usable`` says whether fitting may start.

    With ``time``, an instant, also ``no_instant``: rows without one (their text has no zone or is no time).
    """
    finite = pricing.finite(F.col(target)) & pricing.finite(F.col(line))
    for f in features:
        finite = finite & pricing.finite(F.col(f))
    priced = pricing.valid_odds(F.col(odds[0])) & pricing.valid_odds(F.col(odds[1]))
    counts = [F.count(F.lit(1)).alias("n"), F.count_if(~finite).alias("not_finite"), F.count_if(~priced).alias("bad_odds")]
    sound = (F.col("n") >= 3) & (F.col("not_finite") == 0) & (F.col("bad_odds") == 0)
    if time:
        counts.append(F.count_if(F.col(time).isNull()).alias("no_instant"))
        sound = sound & (F.col("no_instant") == 0)
    return df.groupBy(*group).agg(*counts).withColumn("usable", sound)


def require_usable(faults: DataFrame) -> None:
    """Stop the job when any group may not be fitted."""
    bad = faults.where(~F.col("usable")).limit(1).collect()
    if bad:
        raise ValueError(f"training.unusable: {bad[0].asDict()}")


# ---- walk-forward predictions ---------------------------------------------------------------------


def fold_of(config: WalkForward):
    """-1 for rows that are only ever trained on, else the number of the test fold."""
    pos = F.col(POSITION)
    fold = F.floor((pos - config.min_train_size) / config.test_size)
    return F.when(pos < config.min_train_size, F.lit(-1).cast("long")).otherwise(fold.cast("long"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _least_squares(grams: pd.Series, moments: pd.Series) -> pd.Series:
    """Normal equations of many folds at once; scaled first, least-norm when singular."""
    width = len(moments.iloc[0]) if len(moments) else 0
    if not width:
        return pd.Series([], dtype=object)
    g = np.array(grams.tolist(), dtype=float).reshape(-1, width, width)
    b = np.array(moments.tolist(), dtype=float)
    scale = np.sqrt(np.maximum(np.diagonal(g, axis1=1, axis2=2), 1e-300))
    inverse = np.linalg.pinv(g / (scale[:, :, None] * scale[:, None, :]), rcond=1e-13, hermitian=True)
    solution = np.einsum("nij,nj->ni", inverse, b / scale) / scale
    return pd.Series(list(solution))


def _products(features: Sequence[str], target: str) -> tuple[list, list, list[str]]:
    """Sums of products behind a least-squares fit, and their names."""
    design = [F.lit(1.0), *[F.col(f) for f in features]]
    upper = [(i, j) for i in range(len(design)) for j in range(i, len(design))]
    gram = [F.sum(design[i] * design[j]).alias(f"g_{i}_{j}") for i, j in upper]
    moments = [F.sum(d * F.col(target)).alias(f"m_{i}") for i, d in enumerate(design)]
    return gram, moments, [f"g_{i}_{j}" for i, j in upper] + [f"m_{i}" for i in range(len(design))]


def _coefficients(width: int, prefix: str = ""):
    gram = F.array(*[F.col(f"{prefix}g_{min(i, j)}_{max(i, j)}") for i in range(width) for j in range(width)])
    return _least_squares(gram, F.array(*[F.col(f"{prefix}m_{i}") for i in range(width)]))


def _linear(features: Sequence[str], beta: str):
    value = F.col(beta)[0]
    for place, name in enumerate(features, start=1):
        value = value + F.col(beta)[place] * F.col(name)
    return value


def fit_linear(df: DataFrame, group: Sequence[str], features: Sequence[str], *, target: str = "y") -> DataFrame:
    """Final least-squares coefficients ``beta`` (intercept first) per group, on every row."""
    gram, moments, _ = _products(features, target)
    return df.groupBy(*group).agg(*gram, *moments).select(*group, _coefficients(len(features) + 1).alias("beta"))


def predict_linear(df: DataFrame, fits: DataFrame, group: Sequence[str], features: Sequence[str]) -> DataFrame:
    return attach(df, fits, group).withColumn("prediction", _linear(features, "beta")).drop("beta")


def walk_forward_linear(
    df: DataFrame, group: Sequence[str], features: Sequence[str], config: WalkForward, *, target: str = "y",
    block_rows: int | None = None,
) -> DataFrame:
    """Out-of-sample least-squares predictions, one fit per fold on all rows before it.

    A fold's fit needs only the running sums of products, so all folds of all
    groups are fitted from one aggregation and one running total over folds.
    Adds ``fold`` and ``prediction`` (NULL on rows never predicted).
    """
    gram, moments, names = _products(features, target)
    numbered = df.withColumn("fold", fold_of(config))
    per_fold = numbered.groupBy(*group, "fold").agg(*gram, *moments)
    trained = ordered_scan(
        per_fold, group, ["fold"], sums={f"t_{n}": F.col(n) for n in names}, before=True, block_rows=block_rows
    ).where(F.col("fold") >= 0)
    fits = trained.select(*group, "fold", _coefficients(len(features) + 1, "t_").alias("_beta"))
    return attach(numbered, fits, [*group, "fold"]).withColumn("prediction", _linear(features, "_beta")).drop("_beta")


def _with_labels(estimator: Estimator, target: str) -> Estimator:
    return estimator.copy({estimator.labelCol: target}) if hasattr(estimator, "labelCol") else estimator


def walk_forward_estimator(
    df: DataFrame, features: Sequence[str], config: WalkForward, estimator: Estimator, *, target: str = "y"
) -> DataFrame:
    """``walk_forward_estimators`` for one series."""
    key = next(k for k in ("_series", "_series_", "_series__") if k not in df.columns)
    return walk_forward_estimators(df.withColumn(key, F.lit(0)), [key], features, config, estimator, target=target).drop(key)


#: Training rows for each task of a fit; a short series is fitted in one task.
ROWS_PER_FIT_TASK = 50_000


def walk_forward_estimators(
    df: DataFrame, group: Sequence[str], features: Sequence[str], config: WalkForward, estimator: Estimator, *,
    target: str = "y", parallel: int = 4,
) -> DataFrame:
    """The same for any estimator with a prediction column and many series: a distributed fit per (series, fold).

    The rows are written once, partitioned by series and fold, so a fit reads its
    own past and nothing else; predictions are written per fold. ``parallel`` fits
    are under way at a time, each on a thread and in a scheduler pool of its own
    (fair scheduling, where the session has it, keeps a long series from holding up the
    others). The driver holds one row per fit. Choose ``test_size`` with the length of the
    series. Adds ``fold`` and ``prediction`` (NULL on rows never predicted, and in
    folds without a past).
    """
    spark = df.sparkSession
    numbered = df.withColumn("fold", fold_of(config))
    names = numbered.select(*group).distinct().withColumn("_number", F.monotonically_increasing_id())
    names = written(names, "series")
    store = written(
        attach(numbered, names, group), "walk-forward", partition_by=["_number", "fold"],
        spread=[F.col("_number"), F.col("fold"), F.floor(F.col(POSITION) / ROWS_PER_FIT_TASK)],
    )
    sizes = store.groupBy("_number", "fold").agg(F.count(F.lit(1)).alias("n")).collect()
    count = {(s["_number"], s["fold"]): s["n"] for s in sizes}
    fits = sorted((number, fold) for number, fold in count if fold >= 0 and any((number, f) in count for f in range(-1, fold)))
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    learner = _with_labels(estimator, target)
    folder = new_folder(spark, "predictions")

    def fit(job: tuple[int, int]) -> None:
        number, fold = job
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"walk-forward-{number}-{fold}")
        mine = store.where(F.col("_number") == number)
        past = sum(n for (s, f), n in count.items() if s == number and f < fold)
        rows = assembler.transform(mine.where(F.col("fold") < fold)).select("features", target)
        model = learner.fit(rows.coalesce(max(1, -(-past // ROWS_PER_FIT_TASK))))
        found = model.transform(assembler.transform(mine.where(F.col("fold") == fold)))
        found.select(*kept, "prediction").write.parquet(f"{folder}/_number={number}/fold={fold}")

    kept = [c for c in store.columns if c not in ("_number", "fold")]
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        # Threads start with the properties of this one; the first failure is raised once all are through.
        for done in [pool.submit(inheritable_thread_target(spark)(fit), job) for job in fits]:
            done.result()
    if not fits:
        return store.select(*df.columns, "fold", F.lit(None).cast("double").alias("prediction"))
    predicted = spark.createDataFrame(fits, "_number long, fold long")
    rest = store.join(F.broadcast(predicted), ["_number", "fold"], "left_anti").select(*df.columns, "fold", F.lit(None).cast("double").alias("prediction"))
    schema = store.withColumn("prediction", F.lit(0.0)).schema
    return rest.unionByName(spark.read.schema(schema).parquet(folder).select(*df.columns, "fold", "prediction"))


#: Rows of a series up to which its folds are fitted inside tasks, and folds that share one copy of their past.
ROWS_PER_SERIES, FOLDS_PER_TASK = 1_000_000, 8


def walk_forward_trees(
    df: DataFrame, group: Sequence[str], features: Sequence[str], config: WalkForward, *, target: str = "y",
    settings: Mapping[str, object] = fixed.BOOSTED_TREES, most_rows: int = ROWS_PER_SERIES, parallel: int = 4,
) -> DataFrame:
    """The same with boosted trees, any number of series and folds at once.

    A series of at most ``most_rows`` rows is fitted inside tasks: a task gets a few
    folds of one series and, once for all of them, the rows before. All such fits of all
    series are one job. A longer series is summed first (``_summed_trees``): squared error
    needs of rows of equal features only their number and the sum of their targets. What
    has more than ``most_rows`` sums goes to MLlib's trees with the same settings, a
    distributed fit per fold (``walk_forward_estimators``). Adds ``fold`` and
    ``prediction`` (NULL on rows never predicted, and in folds without a past).
    """
    numbered = df.withColumn("fold", fold_of(config))
    sizes = numbered.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.max("fold").alias("_last"))
    sized = cut_lineage(attach(numbered, sizes, group))
    short = sized.where(F.col("_n") <= most_rows)
    chunk = _chunks()
    trees = BoostedTrees(TreeSettings(
        trees=settings["maxIter"], rate=settings["stepSize"], depth=settings["maxDepth"], least_rows=settings["minInstancesPerNode"],
        row_share=settings["subsamplingRate"], column_share=float(settings["featureSubsetStrategy"]), seed=settings["seed"],
    ))
    names = list(features)

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(POSITION, kind="stable")
        own = np.maximum(rows["fold"].to_numpy(), 0) // FOLDS_PER_TASK == key[-1]
        x, y, fold = rows[names].to_numpy(float), rows[target].to_numpy(float), rows["fold"].to_numpy()
        found = []
        for f in np.unique(fold[own & (fold >= 0)]):
            past, now = fold < f, fold == f
            if past.any():
                made = BoostedTrees(trees.settings).fit(x[past], y[past]).predict(x[now])
                found.append(rows.loc[now, [*group, POSITION]].assign(prediction=made))
        return pd.concat(found) if found else rows.iloc[:0][[*group, POSITION]].assign(prediction=np.zeros(0))

    schema = T.StructType([*[sized.schema[g] for g in group], sized.schema[POSITION], T.StructField("prediction", T.DoubleType())])
    shipped = short.select(*group, POSITION, "fold", *names, target, chunk.alias("_chunk"))
    made = shipped.groupBy(*group, "_chunk").applyInPandas(fit, schema)
    out = attach(short.drop("_n", "_last"), made, [*group, POSITION])
    long = sized.where(F.col("_n") > most_rows)
    if long.isEmpty():
        return out
    summed, longest = _summed_trees(long, group, names, target, trees.settings, most_rows)
    out = out.unionByName(summed)
    if longest.isEmpty():
        return out
    distributed = walk_forward_estimators(longest.select(*df.columns), group, features, config, GBTRegressor(**settings), target=target, parallel=parallel)
    return out.unionByName(distributed)


def _chunks():
    """The chunks of folds that need a row, of its own fold on."""
    return F.explode(F.expr(f"sequence(cast(greatest(fold, 0) div {FOLDS_PER_TASK} as int), cast(greatest(_last, 0) div {FOLDS_PER_TASK} as int))"))


def _summed_trees(long: DataFrame, group: Sequence[str], names: Sequence[str], target: str, settings: TreeSettings, most_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows with predictions, rows of series that have more than ``most_rows`` sums).

    Rows of one series, fold, slot (by hash of the position) and equal features become one
    entry: their number and sum of targets. A task fits on the entries of earlier folds alone.
    """
    keys = [f"_f{i}" for i in range(len(names))]
    values = [F.col(n).cast("double") for n in names]
    placed = long.withColumns({k: F.when(~F.isnan(x), x) for k, x in zip(keys, values)})
    number = F.coalesce(F.col(target).cast("double"), F.lit(float("nan")))
    slot = F.pmod(F.xxhash64(POSITION), F.lit(SLOTS)).cast("int").alias("_slot")
    sums = cut_lineage(placed.groupBy(*group, "fold", "_last", slot, *keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(number).alias("_sum")))
    entries = sums.groupBy(*group).agg(F.count(F.lit(1)).alias("_entries"))
    placed, sums = attach(placed, entries, group), attach(sums, entries, group)

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fold = rows["fold"].to_numpy()
        own = np.maximum(fold, 0) // FOLDS_PER_TASK == key[-1]
        rows["_sum"] = rows["_sum"].astype(float)
        found = []
        for f in np.unique(fold[own & (fold >= 0)]):
            past = rows[fold < f].groupby(["_slot", *keys], dropna=False, as_index=False)[["_n", "_sum"]].sum(min_count=1)
            if len(past):
                now = rows.loc[fold == f, [*group, "fold", *keys]].drop_duplicates()
                trees = BoostedTrees(settings).fit(
                    past[keys].to_numpy(float), past["_sum"].to_numpy(float), past["_n"].to_numpy(float), past["_slot"].to_numpy(int)
                )
                found.append(now.assign(prediction=trees.predict(now[keys].to_numpy(float))))
        return pd.concat(found) if found else rows.iloc[:0][[*group, "fold", *keys]].assign(prediction=np.zeros(0))

    here = [*group, "fold", *keys]
    schema = T.StructType([*[sums.schema[c] for c in here], T.StructField("prediction", T.DoubleType())])
    fitting = sums.where(F.col("_entries") <= most_rows)
    made = fitting.select(*here, "_slot", "_n", "_sum", _chunks().alias("_chunk")).groupBy(*group, "_chunk").applyInPandas(fit, schema)
    kept = [c for c in long.columns if c not in ("_n", "_last")]
    done = attach(placed.where(F.col("_entries") <= most_rows), made, here).select(*kept, "prediction")
    return done, placed.where(F.col("_entries") > most_rows).select(*kept)


def final_models(
    df: DataFrame, key: str, features: Sequence[str], estimator: Estimator, *, target: str = "y", parallel: int = 4
) -> dict[str, object]:
    """The estimator fitted on all rows of each series, several at a time; the driver holds one model per series."""
    spark = df.sparkSession
    names = written(df.select(key).distinct().withColumn("_number", F.monotonically_increasing_id()), "series")
    store = written(
        attach(df, names, [key]).select("_number", POSITION, *features, target), "training", partition_by=["_number"],
        spread=[F.col("_number"), F.floor(F.col(POSITION) / ROWS_PER_FIT_TASK)],
    )
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    learner = _with_labels(estimator, target)

    def fit(number: int):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"final-{number}")
        return learner.fit(assembler.transform(store.where(F.col("_number") == number)).select("features", target))

    known = names.collect()
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        done = [pool.submit(inheritable_thread_target(spark)(fit), r["_number"]) for r in known]
        return {r[key]: d.result() for r, d in zip(known, done)}


# ---- pricing by earlier residuals -----------------------------------------------------------------


def earlier_and_smaller(times: np.ndarray, is_point: np.ndarray) -> np.ndarray:
    """For every probe: points before it in array order with a smaller time.

    Bottom-up halves: at each width the points of a left half are counted
    against the probes of its right half by one sort and two searches.
    """
    size = len(times)
    index = np.arange(size)
    span = int(times.max()) + 1 if size else 1
    found = np.zeros(size, dtype=np.int64)
    width = 1
    while width < size:
        half, pair = index // width, index // (2 * width)
        left = is_point & (half % 2 == 0)
        right = ~is_point & (half % 2 == 1)
        keys = np.sort(pair[left] * span + times[left])
        found[right] += np.searchsorted(keys, pair[right] * span + times[right]) - np.searchsorted(keys, pair[right] * span)
        width *= 2
    return found


def _local_counter(time: str, out: str):
    def count(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_v", "_kind", POSITION], kind="stable")
        rows[out] = earlier_and_smaller(rows[time].to_numpy(np.int64), rows["_kind"].to_numpy() == 1)
        return rows

    return count


def _whole_blocks(cut: DataFrame, group: Sequence[str]) -> DataFrame:
    """``_whole`` per occupied pair of value and position block that holds probes: the
    points of its group in whole value blocks below and whole position blocks before it.

    The value blocks below a probe's are one node of a binary tree per set bit of
    its block number, and a point block lies in one node per level. So only occupied
    cells are written, each once per level: cells times the logarithm of the blocks
    of the group, never all value blocks times all position blocks. A node's running
    sum over position blocks has at most one row per position block.
    """
    here = [*group, BLOCK, "_pb"]
    cells = cut.groupBy(*here).agg(
        F.sum((F.col("_kind") == 1).cast("long")).alias("_n"), F.max(F.col("_kind") != 1).alias("_asked")
    )
    numbers = cut.select(*group, BLOCK).distinct().withColumn(
        "_vb", F.row_number().over(Window.partitionBy(*group).orderBy(BLOCK)).cast("long") - 1
    )
    # Levels up to the highest bit of the group's last block; a group in one block has none.
    top = numbers.groupBy(*group).agg(F.length(F.bin(F.max("_vb"))).alias("_bits"), F.max("_vb").alias("_last")).where("_last > 0")
    tree = attach(attach(cells, numbers, [*group, BLOCK]), top, group).where(F.col("_bits").isNotNull())
    tree = tree.withColumn("_level", F.explode(F.expr("sequence(0, _bits - 1)")))
    points = tree.where("_n > 0").select(*group, "_level", F.expr("shiftright(_vb, _level)").alias("_node"), "_pb", "_n")
    probes = tree.where("_asked AND shiftright(_vb, _level) % 2 = 1").select(
        *here, "_level", F.expr("shiftright(_vb, _level) - 1").alias("_node")
    )
    place = [*group, "_level", "_node"]
    asked = probes.select(*place, "_pb", F.lit(0).cast("long").alias("_n"))
    earlier = Window.partitionBy(*place).orderBy("_pb").rowsBetween(Window.unboundedPreceding, -1)
    running = points.unionByName(asked).groupBy(*place, "_pb").agg(F.sum("_n").alias("_n")).withColumn("_n", F.sum("_n").over(earlier))
    return attach(probes, running, [*place, "_pb"]).groupBy(*here).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_whole"))


def earlier_residual_counts(
    df: DataFrame, group: Sequence[str], *, value: str, threshold: str, tolerance: float, block_rows: int
) -> DataFrame:
    """Per row, among rows of its group at smaller positions: how many values lie
    below ``threshold - tolerance`` (``_under``) and at most ``threshold + tolerance`` (``_upto``).

    Exact two-dimensional counting without forming pairs. Points and probes are
    cut into value blocks (a range shuffle) and position blocks. Whole blocks
    below and before a probe come from dyadic counts (``_whole_blocks``); the rest
    is counted inside one value block and one position block, both of bounded
    size whatever the group sizes or ties are.
    """
    tol = F.lit(tolerance)
    kinds = F.explode(F.array(
        F.struct(F.lit(0).alias("_kind"), (F.col(threshold) - tol).alias("_v")),
        F.struct(F.lit(1).alias("_kind"), F.col(value).alias("_v")),
        F.struct(F.lit(2).alias("_kind"), (F.col(threshold) + tol).alias("_v")),
    ))
    items = df.select(*group, POSITION, kinds.alias("_i")).select(*group, POSITION, "_i.*").where(F.col("_v").isNotNull())
    items = items.withColumn("_pb", F.floor(F.col(POSITION) / block_rows).cast("long"))
    blocks = max(1, math.ceil(3 * df.count() / block_rows))
    group_fields = [df.schema[g] for g in group]
    if blocks == 1:
        placed = items.withColumn("_before", F.lit(0).cast("long"))
    else:
        cut = cut_lineage(range_blocks(items, [*group, "_v", "_kind", POSITION], blocks, block_rows))
        whole = _whole_blocks(cut, group)
        in_value_block = cut.groupBy(*group, BLOCK).applyInPandas(
            _local_counter("_pb", "_same"), T.StructType([*cut.schema.fields, T.StructField("_same", T.LongType())])
        )
        placed = attach(in_value_block, whole, [*group, BLOCK, "_pb"]).withColumn(
            "_before", F.col("_same") + F.coalesce("_whole", F.lit(0))
        ).select(*items.columns, "_before")

    def per_position(rows: pd.DataFrame) -> pd.DataFrame:
        rows = _local_counter(POSITION, "_here")(rows)
        rows["_count"] = rows["_here"] + rows["_before"]
        wide = rows[rows["_kind"] == 0][[*group, POSITION, "_count"]].rename(columns={"_count": "_under"})
        upto = rows[rows["_kind"] == 2].set_index(POSITION)["_count"]
        wide["_upto"] = wide[POSITION].map(upto)
        return wide

    schema = T.StructType([*group_fields, *[T.StructField(n, T.LongType()) for n in (POSITION, "_under", "_upto")]])
    return placed.groupBy(*group, "_pb").applyInPandas(per_position, schema)


def priced_history(
    predicted: DataFrame, group: Sequence[str], config: WalkForward, *, target: str = "y", line: str = "line",
    over_odds: str = "over_odds", under_odds: str = "under_odds", block_rows: int = 200_000,
) -> DataFrame:
    """Each out-of-sample row priced by the residuals strictly before it.

    Rows before ``min_residual_history`` residuals exist are not priced; pushed
    outcomes are dropped after pricing. Adds over / under / push shares, ``raw``
    (over share of the non-pushes), ``outcome`` and ``market_p``.
    """
    oos = predicted.where(F.col("prediction").isNotNull()).withColumn(POSITION, F.col(POSITION) - config.min_train_size)
    oos = cut_lineage(
        oos.withColumn("_residual", F.col(target) - F.col("prediction")).withColumn("_threshold", F.col(line) - F.col("prediction"))
    )
    counts = earlier_residual_counts(
        oos, group, value="_residual", threshold="_threshold", tolerance=config.push_tolerance, block_rows=block_rows
    )
    n = F.col(POSITION)
    over, under = n - F.col("_upto"), F.col("_under")
    difference = F.col(target) - F.col(line)
    return (
        attach(oos, counts, [*group, POSITION])
        .where((n >= config.min_residual_history) & (F.abs(difference) > config.push_tolerance))
        .withColumns({
            "residual_n": n, "over": over / n, "under": under / n, "push": (n - over - under) / n,
            "raw": F.when(over + under > 0, over / (over + under)),
            "outcome": F.when(difference > 0, 1).otherwise(0),
            "market_p": pricing.binary_no_vig(F.col(over_odds), F.col(under_odds)),
        })
        .withColumn(POSITION, n + config.min_train_size)
        .drop("_under", "_upto", "_threshold")
    )
