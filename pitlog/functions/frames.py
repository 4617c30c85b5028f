"""Column housekeeping on whole frames: casts, fills, selection by name."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Listed columns that exist, in list order."""
    present = set(df.columns)
    return df.select([c for c in columns if c in present])


def strict(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly the listed columns; a missing one is an error, before any job runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns)


def conform(df: DataFrame, schema: T.StructType, lenient: bool = False) -> DataFrame:
    """Cast to ``schema``; columns the input lacks become typed NULLs.

    ``lenient`` turns values that do not fit into NULLs instead of failing.
    """
    present = set(df.columns)

    def one(f: T.StructField) -> Column:
        if f.name not in present:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f.name)
        return (c.try_cast(f.dataType) if lenient else c.cast(f.dataType)).alias(f.name)

    return df.select([one(f) for f in schema.fields])


def downcast(df: DataFrame) -> DataFrame:
    """Doubles to floats, for storage only."""
    return df.select(
        [F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def to_number(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Text to double; text that is no number becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Fill NULLs; a column the frame lacks is added as the constant."""
    present = set(df.columns)
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) if c in present else F.lit(v) for c, v in values.items()}
    )


def align(df: DataFrame, features: Sequence[str], missing: object = 0.0) -> DataFrame:
    """Columns in training order; absent ones as a constant."""
    present = set(df.columns)
    return df.select(
        [F.col(c) if c in present else F.lit(missing).alias(c) for c in features]
    )


def named(df: DataFrame, test: Callable[[str], bool]) -> list[str]:
    return [c for c in df.columns if test(c)]


def by_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    return named(df, lambda c: c.startswith(prefixes))


def by_suffix(df: DataFrame, *suffixes: str) -> list[str]:
    return named(df, lambda c: c.endswith(suffixes))


def by_part(df: DataFrame, *parts: str) -> list[str]:
    return named(df, lambda c: any(p in c for p in parts))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def row_sum(columns: Sequence[Column]) -> Column:
    """Horizontal sum that skips NULLs; 0 becomes NULL, so it can be a divisor."""
    acc = F.lit(0)
    for c in columns:
        acc = acc + F.coalesce(c, F.lit(0))
    return F.nullif(acc, F.lit(0))


def unpivot_row(row: DataFrame, names: Mapping[str, str], key: str, value: str) -> DataFrame:
    """A one-row frame of measures to (key, value) rows. ``names``: column -> key text."""
    pairs = F.array(
        *[
            F.struct(F.lit(text).alias(key), F.col(c).cast("double").alias(value))
            for c, text in names.items()
        ]
    )
    return row.select(F.inline(pairs))
