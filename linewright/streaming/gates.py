"""The document gates on arriving files.

The gates are pure expressions, so the batch functions run unchanged on a
streaming DataFrame; nothing here keeps state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linewright.operators import contracts


def stream_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as VARIANT documents while files arrive; unreadable lines have a NULL document."""
    return spark.readStream.text(path).where(F.trim("value") != "").withColumn("document", F.try_parse_json("value"))


def check_stream(documents: DataFrame, rules: Callable[..., str], **options) -> DataFrame:
    """Errors per document; an unreadable one reports ``invalid_json``."""
    checked = contracts.contract_errors(documents, "document", rules, **options)
    bad = F.expr("CAST(array(named_struct('code', 'invalid_json', 'path', '$', 'message', 'text is not JSON')) AS " + contracts.ERRORS_TYPE + ")")
    return checked.withColumn("errors", F.when(F.col("document").isNull(), bad).otherwise(F.col("errors")))


def append_checked(checked: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived and stop; exactly once per document through the checkpoint."""
    out = checked.select("value", "errors")
    return (
        out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
