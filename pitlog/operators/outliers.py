"""Outliers of measurements: robust fences per group from quantile sketches, flags and blanking.

A group's fences lie ``width`` interquartile ranges outside its quartiles. Quartiles come from
mergeable sketches, which may be stored by season and united (see ``operators.sketches``), so a new
season's fences need no older rows. The fences are a small table; rows meet it in a left join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlog.operators import sketches as K
from pitlog.operators.joins import attach_features

WIDTH = 3.0
LEAST_ROWS = 20


def fences(
    stored: DataFrame, by: Sequence[str], columns: Sequence[str], width: float = WIDTH, least: int = LEAST_ROWS
) -> DataFrame:
    """(by..., n_rows, <column>_low, <column>_high) from sketches with those groups.

    Groups with fewer than ``least`` values of a column have no fences for it.
    """
    out = [F.col("n_rows")]
    for c in columns:
        low, high = K.quantile(c, 0.25), K.quantile(c, 0.75)
        enough = F.kll_sketch_get_n_double(f"q_{c}") >= least
        out.append(F.when(enough, low - width * (high - low)).alias(f"{c}_low"))
        out.append(F.when(enough, high + width * (high - low)).alias(f"{c}_high"))
    return stored.select(*by, *out)


def mark_outliers(
    df: DataFrame,
    limits: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    flags: bool = True,
    blank: bool = False,
) -> DataFrame:
    """``df`` with ``<column>_outlier`` flags and, with ``blank``, outlying values as NULL.

    A value on a fence is none; rows of groups without fences, or with a NULL group, have none.
    """
    named = limits.select(
        *by,
        *[F.col(f"{c}_{side}").alias(f"_{side}_{c}") for c in columns for side in ("low", "high")],
    )
    at = attach_features(df, named, list(by))
    outside = {
        c: F.coalesce((F.col(c) < F.col(f"_low_{c}")) | (F.col(c) > F.col(f"_high_{c}")), F.lit(False))
        for c in columns
    }
    values = {c: F.when(~outside[c], F.col(c)) for c in columns} if blank else {}
    kept = [values[c].alias(c) if c in values else F.col(f"`{c}`") for c in df.columns]
    return at.select(*kept, *[o.alias(f"{c}_outlier") for c, o in outside.items() if flags])


def without_outliers(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], width: float = WIDTH, least: int = LEAST_ROWS
) -> DataFrame:
    """``df`` with outlying values as NULL, the fences from its own rows."""
    limits = fences(K.sketches(df, by, columns), by, columns, width, least)
    return mark_outliers(df, limits, by, columns, flags=False, blank=True)
