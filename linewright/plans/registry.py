"""Registered queries: a Spark job each, with the equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.plans.views import DUCK, Dialect, duck

# Sums of doubles differ in the last bits with row order; nine places hide that
# and lie below the exact halves that prices with two places produce.
DIGITS = 9

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(job):
        QUERIES[name] = job
        if sql is not None:
            ORACLES[name] = sql
        return job

    return keep


def over(views: dict[str, Callable[[Dialect], str]], body: str) -> str:
    """Oracle text: the input views as common tables, then ``body``."""
    ctes = ", ".join(f"{name} AS ({duck(view(DUCK))})" for name, view in views.items())
    return f"WITH {ctes} {body}"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


def r(*pairs: str) -> str:
    """``expr AS name`` items rounded as ``rounded`` does."""
    out = []
    for pair in pairs:
        expr, name = pair.rsplit(" AS ", 1)
        out.append(f"round({expr}, {DIGITS}) AS {name}")
    return ", ".join(out)
