"""Registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from recohort.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_WIDE = {T.ByteType: "bigint", T.ShortType: "bigint", T.IntegerType: "bigint", T.FloatType: "double",
         T.DecimalType: "double"}


def plain(rows: DataFrame) -> DataFrame:
    """Whole numbers as bigint and other numbers as double, as the SQL side returns them."""
    columns = [F.col(f"`{f.name}`").cast(_WIDE[type(f.dataType)]).alias(f.name) if type(f.dataType) in _WIDE
               else F.col(f"`{f.name}`") for f in rows.schema.fields]
    return rows.select(*columns)


def rounded(rows: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    """Round ratios, whose last digits depend on the order of floating-point steps."""
    return rows.withColumns({name: F.round(F.col(name), digits) for name in names})


def query(name: str, sql: str | None = None):
    def register(build):
        @wraps(build)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain(build(prepare(spark), folder))

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register
