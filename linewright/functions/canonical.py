"""Canonical text of rows and content addresses.

Canonical form: one JSON object, keys sorted at every level, no spaces, nulls
kept. Doubles are written the same way by any engine, whatever its printer makes of
the last digits: whole numbers below 10**15 without a point, numbers of up to 15
digits (from 1e-300 on) as the shortest ``d.ddde-dd``, all others as whole mantissa ``p`` power of two.
NaN is refused. Numbers inside a VARIANT are written as Spark holds them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: In front of number texts until they are unquoted; doubled where a text has it, so that no text passes for a number.
MARK = "\x02"


def number_text(number: Column) -> Column:
    """The text of a double that reads back as it, NULL for NULL."""
    size = F.abs(number)
    decimal = F.format_string("%.14e", number)
    whole = (size < 1e15) & (F.floor(number).cast("double") == number)
    two = F.lit(2.0)
    power = F.floor(F.log2(size)).cast("double")
    power = F.when(F.pow(two, power) > size, power - 1).when(F.pow(two, power + 1) <= size, power + 1).otherwise(power)
    # Both factors are powers of two, so the products are exact; one alone would be infinite for the smallest numbers.
    half = F.floor((52 - power) / 2).cast("double")
    mantissa = (size * F.pow(two, half) * F.pow(two, 52 - power - half)).cast("long")
    binary = F.concat(F.when(number < 0, "-").otherwise(""), mantissa, F.lit("p"), (power - 52).cast("long"))
    return (
        F.when(number.isNull(), F.lit(None).cast("string"))
        .when(whole, number.cast("long").cast("string"))
        .when(size == float("inf"), F.when(number > 0, "Infinity").otherwise("-Infinity"))
        .when((size >= 1e-300) & (decimal.cast("double") == number), F.regexp_replace(decimal, r"\.?0+e", "e"))
        .otherwise(binary)
    )


def _sorted_value(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        inner = F.struct(*[_sorted_value(column[n], dtype[n].dataType).alias(n) for n in sorted(dtype.names)])
        return F.when(column.isNotNull(), inner)
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda x: _sorted_value(x, dtype.elementType))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        number = column.cast("double")
        marked = F.concat(F.lit(MARK), number_text(number))
        return F.when(F.isnan(column), F.raise_error(F.lit("NaN has no canonical text"))).otherwise(marked)
    if isinstance(dtype, T.StringType):
        return F.replace(column, F.lit(MARK), F.lit(MARK * 2))
    return column


def _plain_numbers(text: Column) -> Column:
    return F.regexp_replace(text, r'"\\u0002(-?[0-9][^"]*)"', "$1")


def canonical_text(df: DataFrame, columns: Sequence[str]) -> Column:
    parts = [_sorted_value(F.col(c), df.schema[c].dataType).alias(c) for c in sorted(columns)]
    return _plain_numbers(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}))


def document_text(df: DataFrame, column: str) -> Column:
    """Canonical text of one struct (NULL for a null struct) or VARIANT column."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.VariantType):
        return F.to_json(column)
    return _plain_numbers(F.to_json(_sorted_value(F.col(column), dtype), {"ignoreNullFields": "false"}))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def content_addressed(df: DataFrame, columns: Sequence[str], *, prefix: str = "record_") -> DataFrame:
    """Add the content hash, an id of 24 hex digits and the immutability stamp."""
    hashed = df.withColumn("content_sha256", digest(canonical_text(df, columns)))
    return hashed.withColumn(
        "prediction_id", F.concat(F.lit(prefix), F.substring("content_sha256", 1, 24))
    ).withColumn(
        "immutability",
        F.struct(
            F.lit("json-sort-keys-utf8").alias("canonicalization"),
            F.lit("create-only-no-overwrite").alias("write_policy"),
        ),
    )
