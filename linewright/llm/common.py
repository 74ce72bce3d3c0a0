"""What several operators share: shared-folder tables, text expressions, Arrow access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of everything that is no word character once A-Z are lower case.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Runs of blank characters.
BLANK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Unset is accepted only where everything is one process (a local master).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="linewright-shared-"))
    return _local_folder[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it from there.

    Cuts the lineage: a lost executor repeats nothing before the table.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/linewright-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of ASCII alone take the faster built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def spaced_words(text: Column) -> Column:
    """The words of ``text`` with single blanks between them."""
    return F.btrim(F.regexp_replace(ascii_lower(text), WORD_GAP, " "))


def text_key(column: str = "text") -> Column:
    """128 bits of SHA-256 of the text: rows of equal text share the key."""
    return F.unhex(F.substring(F.sha2(text_of(column), 256), 1, 32))


def byte_views(column: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of every string of an Arrow array without nulls, uncopied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    for start, end in zip(at, at[1:]):
        yield view[start:end]


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, with underscores in front until no column has it (case aside)."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted = "_" + wanted
    return wanted
