"""Named queries over the driver tables, each with its check in plain SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Two engines add doubles in different orders, so compared values are rounded.
# The offset moves exact ties (k / 32 of a cent and the like) off the rounding edge.
_OFFSET = "1e-9D"


def tidy(df: DataFrame, maybe: Iterable[str] = ()) -> DataFrame:
    """Output form of a compared query: bigint, double at 6 digits, text.

    ``maybe`` names integer columns with NULLs. They come out as doubles, because
    clients disagree on how to carry a missing integer.
    """
    maybe = set(maybe)

    def one(f: T.StructField) -> str:
        c = f"`{f.name}`"
        if f.name in maybe:
            e = f"CAST({c} AS DOUBLE)"
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            e = f"round(CAST({c} AS DOUBLE) + {_OFFSET}, 6)"
        elif isinstance(f.dataType, T.BooleanType):
            e = f"CAST(CAST({c} AS INT) AS BIGINT)"
        elif isinstance(f.dataType, T.IntegralType):
            e = f"CAST({c} AS BIGINT)"
        elif isinstance(f.dataType, T.DateType):
            e = f"CAST({c} AS STRING)"
        elif isinstance(f.dataType, T.ArrayType):
            e = f"array_join(CAST({c} AS ARRAY<STRING>), ',')"
        else:
            e = c
        return f"{e} AS {c}"

    return df.selectExpr(*[one(f) for f in df.schema.fields])


def r6(expression: str) -> str:
    """The same rounding in SQL text."""
    return f"ROUND(CAST({expression} AS DOUBLE) + 1e-9, 6)"
