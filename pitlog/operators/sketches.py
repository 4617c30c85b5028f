"""Stored sketches of distinct counts and quantiles, united without rereading rows.

A season's rows are read once into one small row per group with a HyperLogLog sketch for each
counted column and a KLL sketch for each measured one. Sketches of any seasons or groups then
unite into those of their union, so a question over ten seasons reads ten seasons' sketches. Both
kinds are mergeable aggregates, combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KLL_K = 1024
HLL_LG = 12

# The published rank error of KLL sketches is KLL_ERROR[0] / k ** KLL_ERROR[1], and
# the relative standard error of HyperLogLog sketches is HLL_ERROR / sqrt(2 ** lg).
KLL_ERROR = (2.296, 0.9021)
HLL_ERROR = 1.04


def rank_error(k: int = KLL_K) -> float:
    """How far a quantile's true rank may lie from the asked one, with 99 % confidence."""
    return KLL_ERROR[0] / k ** KLL_ERROR[1]


def count_error(lg: int = HLL_LG, deviations: float = 3.0) -> float:
    """The relative error that distinct counts keep within so many standard deviations."""
    return deviations * HLL_ERROR / 2 ** (lg / 2)


def sketches(
    df: DataFrame,
    by: Sequence[str],
    measured: Sequence[str] = (),
    counted: Sequence[str] = (),
    k: int = KLL_K,
    lg: int = HLL_LG,
) -> DataFrame:
    """(by..., n_rows, q_<measured>, d_<counted>): one row per group. NULLs enter no sketch."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.kll_sketch_agg_double(F.col(c).cast("double"), k).alias(f"q_{c}") for c in measured]
    aggs += [F.hll_sketch_agg(F.col(c).cast("string"), lg).alias(f"d_{c}") for c in counted]
    return df.groupBy(*by).agg(*aggs)


def united(stored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of coarser groups: those of ``stored`` that share ``by``, or all, as one."""
    aggs = [F.sum("n_rows").alias("n_rows")]
    aggs += [F.kll_merge_agg_double(c).alias(c) for c in stored.columns if c.startswith("q_")]
    aggs += [F.hll_union_agg(c).alias(c) for c in stored.columns if c.startswith("d_")]
    return stored.groupBy(*by).agg(*aggs)


def quantile(column: str, share: float) -> Column:
    """The smallest value whose rank reaches ``share``, within ``rank_error``; NULL without values."""
    sketch = F.col(f"q_{column}")
    some = F.kll_sketch_get_n_double(sketch) > 0
    return F.when(some, F.kll_sketch_get_quantile_double(sketch, F.lit(float(share))))


def distinct(column: str) -> Column:
    """Distinct values, within ``count_error``."""
    return F.hll_sketch_estimate(f"d_{column}")
