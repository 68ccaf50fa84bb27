"""The registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)``, reads the driver tables in full and returns a DataFrame.
Column names and types are the same on both sides.  Values that depend on summation order or on
libm (sums of logarithms, square roots) are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, "Query"] = {}


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple[str, ...] = field(default_factory=tuple)


def query(name: str, sql: str | None, covers: tuple[str, ...] = ()):
    def deco(fn):
        QUERIES[name] = Query(name, fn, sql, covers)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    """Import every query module so their ``@query`` registrations run."""
    from . import q_corpus, q_features, q_interact, q_matching, q_stats, q_store, q_text, q_udf  # noqa: F401
    return QUERIES
