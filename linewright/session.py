"""Session settings and lineage cuts."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession


def local_session(cores: int | str = "*", *, partitions: int = 8, app: str = "linewright") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="linewright-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared checkpoint folder."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/linewright-{name}-{uuid.uuid4().hex}"


def code_version() -> str:
    """A hash of the engine's own source, for keys of tables that outlive a session: other code, other tables."""
    found = hashlib.sha256()
    folder = os.path.dirname(os.path.abspath(__file__))
    for place, folders, names in os.walk(folder):
        folders[:] = sorted(f for f in folders if f not in ("__pycache__", "llm"))
        for name in sorted(names):
            if name.endswith(".py"):
                with open(os.path.join(place, name), "rb") as source:
                    found.update(name.encode() + b"\x00" + source.read())
    return found.hexdigest()


def store_folder(spark: SparkSession, name: str) -> str:
    """A folder that later queries, and later sessions with the same ``spark.checkpoint.dir``, find again.

    Without that setting (a local master only) it lasts as long as the session.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared}/linewright-{name}"
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/linewright-{name}"


def written(df: DataFrame, name: str, *, partition_by: Sequence[str] = (), spread: Sequence[Column | str] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it from there.

    ``partition_by``: columns that become folders, so that filters on them read no
    other rows. ``spread``: what to shuffle by first, so that a folder gets few files.
    """
    path = new_folder(df.sparkSession, name)
    (df.repartition(*spread) if spread else df).write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and read it from there.

    Used where two branches must see the very same rows (block numbers come
    from the range shuffle) and where redoing the work after a lost executor
    would be costly.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
