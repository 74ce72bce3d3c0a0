"""Content hashes of ordered samples and fitted coefficients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.functions.canonical import canonical_text, digest
from linewright.session import cut_lineage


def artifact_hash(df: DataFrame, key: str, position: str, value: str, *, method: str, fan: int = 4096) -> DataFrame:
    """One hash per key (a model version) over the whole artifact: version, method, and the values in position order.

    The values count by their ``sample_hash``, so the payload is short whatever the sample.
    """
    values = sample_hash(df, [key], position, value, fan=fan).withColumnRenamed("artifact_sha256", "values_sha256")
    payload = values.select(F.col(key).alias("_key"), F.col(key).cast("string").alias("model_version"), F.lit(method).alias("method"), "values_sha256")
    text = canonical_text(payload, ["model_version", "method", "values_sha256"])
    return payload.select(F.col("_key").alias(key), digest(text).alias("artifact_sha256"))


def sample_hash(df: DataFrame, key: Sequence[str], position: str, value: str, *, fan: int = 4096) -> DataFrame:
    """One hash per key over its values in position order.

    A tree of hashes: ``fan`` neighbouring texts are joined and hashed per node,
    level by level, so no key's sample is ever gathered in one place. A key that is
    down to its one node keeps that hash while longer samples go on, so its hash
    depends on its own values alone. Positions count from 0 without gaps.
    """
    key = list(key)
    level = df.select(*key, F.col(position).cast("long").alias("_p"), F.col(value).cast("string").alias("_t"))
    top = df.agg(F.max(F.col(position))).first()[0]
    top = int(top) if top is not None else 0
    hashed = False
    while True:
        node = F.floor(F.col("_p") / fan).cast("long")
        texts = F.transform(F.array_sort(F.collect_list(F.struct("_p", "_t"))), lambda s: s["_t"])
        joined = digest(F.array_join(texts, ","))
        if hashed:
            joined = F.when((F.count(F.lit(1)) == 1) & (F.min("_p") == 0), F.min("_t")).otherwise(joined)
        level = level.groupBy(*key, node.alias("_n")).agg(joined.alias("_t"))
        hashed = True
        level = level.withColumnRenamed("_n", "_p")
        top //= fan
        if top == 0:
            return level.select(*key, F.col("_t").alias("artifact_sha256"))
        level = cut_lineage(level)


def versioned(df: DataFrame, columns: Sequence[str], model_version: str, kind: str) -> DataFrame:
    """Add ``artifact_sha256`` over ``columns`` and ``version`` = model-kind-12 hex."""
    hashed = df.withColumn("artifact_sha256", digest(canonical_text(df, columns)))
    return hashed.withColumn(
        "version", F.concat(F.col(model_version), F.lit(f"-{kind}-"), F.substring("artifact_sha256", 1, 12))
    )
